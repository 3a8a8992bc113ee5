"""Tables keyed by (source, external_id), kept as versions of bucketed Parquet.

A row's bucket is a hash of its key, so an upsert reads and rewrites only the buckets its
keys fall into. Merged buckets are written to a new folder, once; then one small file, the
manifest of the next version, says which folder each bucket lies in. A version appears
whole or not at all:

* a reader keeps the folders of the version it started with, whatever is written meanwhile;
* a writer that fails leaves folders that no manifest names, and the table as it was;
* of two writers that prepared the same version one wins, since a manifest is renamed into
  place only where none is. The other keeps its merged buckets if the winner touched none
  of them, and merges those again that it did.

The number of buckets is part of the manifest; the argument counts only for a new table.
Renaming without overwriting must be atomic, as it is on HDFS.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairrank.operators.keyed import KEY, last_wins, merge_payload
from pairrank.session import shared_dir
from pairrank.sources.files import delete, entries, publish, read_text

# For large tables pass more, so that one bucket stays at some gigabytes.
BUCKETS = 64
#: Times a writer that lost a race starts again.
TRIES = 50


def _schema(spark: SparkSession, ddl: str) -> StructType:
    return spark.createDataFrame([], ddl).schema


def _read_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows at the path; no rows only where the path does not exist yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


@dataclass(frozen=True)
class Snapshot:
    """One version: the folder of each bucket, relative to the table. Version -1 is the table before its first upsert."""

    version: int
    buckets: int
    folders: dict[int, str]


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, payload: list[str], buckets: int = BUCKETS) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = _schema(spark, schema)
        self.payload = payload
        self.buckets = buckets

    # ------------------------------------------------------------------ versions

    def _manifest(self, version: int) -> str:
        return f"{self.path}/_versions/{version:020d}.json"

    def versions(self) -> list[int]:
        found = entries(self.spark, f"{self.path}/_versions")
        return sorted(int(name.removesuffix(".json")) for name, _ in found if name.endswith(".json") and not name.startswith("."))

    def snapshot(self, version: int | None = None) -> Snapshot:
        """A version by its number, or the newest."""
        known = self.versions()
        if version is None and not known:
            return Snapshot(-1, self.buckets, {})
        if version is not None and version not in known:
            raise ValueError(f"{self.path} has no version {version}; known: {known}")
        text = read_text(self.spark, self._manifest(known[-1] if version is None else version))
        stored = json.loads(text)
        return Snapshot(stored["version"], stored["buckets"], {int(b): f for b, f in stored["folders"].items()})

    def _commit(self, snapshot: Snapshot) -> bool:
        """Makes the version visible; False if another writer has made it first."""
        text = json.dumps({"version": snapshot.version, "buckets": snapshot.buckets, "folders": snapshot.folders})
        return publish(self.spark, self._manifest(snapshot.version), text)

    # ---------------------------------------------------------------------- rows

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/{folder}" for folder in sorted(folders)]
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(list(self.snapshot(version).folders.values()))

    def bucket_of(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")

    def upsert(self, rows: DataFrame, order: list[str] | None = None) -> int:
        """Inserts new keys and replaces the payload of known ones; ids are kept. Returns the version.

        With ``order`` the last row of a repeated key wins; without it keys must be unique.
        """
        wanted = [c for c in rows.columns if c in self.schema.names or c in (order or [])]
        rows = rows.select(*wanted)
        if order:
            rows = last_wins(rows, order)
        staged = f"{shared_dir(self.spark)}/staging/{uuid.uuid4().hex}"
        updates = rows.select("id", *KEY, *self.payload)
        updates.write.parquet(staged)
        try:
            return self._apply(self.spark.read.schema(updates.schema).parquet(staged))
        finally:
            delete(self.spark, staged)

    def _apply(self, updates: DataFrame) -> int:
        base = self.snapshot()
        for _ in range(TRIES):
            made = self._merge(updates, base)
            if not made:
                return base.version
            while not self._commit(Snapshot(base.version + 1, base.buckets, {**base.folders, **made})):
                newer = self.snapshot()
                untouched = all(newer.folders.get(b) == base.folders.get(b) for b in made)
                rebased = newer.buckets == base.buckets and untouched
                base = newer
                if not rebased:
                    break
            else:
                return base.version + 1
        raise RuntimeError(f"{self.path}: other writers were faster {TRIES} times")

    def _merge(self, updates: DataFrame, base: Snapshot) -> dict[int, str]:
        """Writes the buckets that the updates touch, merged with their rows of ``base``; their folders."""
        bucket = self.bucket_of(base.buckets)
        # At most ``buckets`` values: the bound that makes this list safe on the driver.
        touched = [r[0] for r in updates.select(bucket.alias("b")).distinct().collect()]
        current = self._rows([base.folders[b] for b in touched if b in base.folders])
        merged = merge_payload(current, updates, self.payload).select(*self.schema.names, bucket.alias("key_bucket"))
        folder = f"data/{uuid.uuid4().hex}"
        if touched:
            # Rebalancing gives each bucket as many files as its size needs, and no more.
            merged.hint("rebalance", "key_bucket").write.partitionBy("key_bucket").parquet(f"{self.path}/{folder}")
        return {b: f"{folder}/key_bucket={b}" for b in touched}

    def vacuum(self, keep: int = 1, older_than_hours: float = 24) -> int:
        """Deletes what none of the newest ``keep`` versions names; the number of folders that went.

        Readers of older versions and writers at work need their folders, so nothing younger
        than ``older_than_hours`` goes.
        """
        known = self.versions()
        kept = known[-max(1, keep):]
        named = {f for v in kept for f in self.snapshot(v).folders.values()}
        before = (time.time() - 3600 * older_than_hours) * 1000
        for version in known:
            if version not in kept:
                delete(self.spark, self._manifest(version))
        gone = 0
        for folder, _ in entries(self.spark, f"{self.path}/data"):
            for part, changed in entries(self.spark, f"{self.path}/data/{folder}"):
                if part.startswith("key_bucket=") and f"data/{folder}/{part}" not in named and changed <= before:
                    delete(self.spark, f"{self.path}/data/{folder}/{part}")
                    gone += 1
        return gone


class AppendTable:
    """Rows that are only ever added: run log, quarantine, raw file manifest."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark = spark
        self.path = path
        self.schema = _schema(spark, schema)

    def replace(self, rows: DataFrame, column: str) -> None:
        """Rows under the values of ``column``, in place of what was there under them: a repeated run adds nothing."""
        rows.select(*self.schema.names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        rows.select(*self.schema.names).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return _read_or_empty(self.spark, self.path, self.schema).select(*self.schema.names)
