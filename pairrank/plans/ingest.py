"""Ingest run: files of a registered source into its keyed table, with an audit trail."""

from __future__ import annotations

import json
import time
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairrank import schemas
from pairrank.operators.keyed import resolve_interactions, unresolved_reason
from pairrank.operators.records import quarantine, to_rows
from pairrank.session import cut_lineage, shared_dir
from pairrank.sources.catalog import Source, get_registered_source
from pairrank.sources.files import delete
from pairrank.sources.raw_files import hash_files, new_artifacts, store_raw
from pairrank.sources.readers import POSITION, read
from pairrank.sources.tables import BUCKETS, AppendTable, KeyedTable

RAW_FILES = "source string, version string, sha256 string, bytes long, path string, key string"
REJECTED = "source string, entity_type string, external_id string, reason string, record string, run_id string"
REQUIRED = {
    "compound": ["external_id", "smiles"],
    "protein": ["external_id", "sequence"],
    "interaction": ["external_id"],
}


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


class Ingestion:
    """Tables and raw files below ``root``, and the runs that fill them."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        tables = f"{self.root}/tables"
        self.tables = {
            kind: KeyedTable(spark, f"{tables}/{kind}s", schema, schemas.PAYLOAD[kind], buckets)
            for kind, schema in schemas.TABLES.items()
        }
        self.run_log = AppendTable(spark, f"{tables}/ingestion_runs", schemas.RUNS)
        self.raw_files = AppendTable(spark, f"{tables}/raw_files", RAW_FILES)
        self.rejected = AppendTable(spark, f"{tables}/rejected", REJECTED)

    def runs(self) -> DataFrame:
        """One row per run, in its last state."""
        log = self.run_log.read()
        state = F.struct(F.col("status") != "STARTED", F.col("ended_at"))
        rest = [c for c in log.columns if c != "run_id"]
        return log.groupBy("run_id").agg(F.max_by(F.struct(*rest), state).alias("_r")).select("run_id", "_r.*")

    def run_pipeline(self, name: str, **reader_options) -> dict:
        """Discover, store, parse, normalise, upsert. A failed run is logged and raised."""
        run = {"run_id": uuid.uuid4().hex, "status": "STARTED", "source": name, "started_at": _now()}
        self._log(run)
        try:
            source = get_registered_source(name)
            run |= {
                "stats": json.dumps(source.discover()["stats"]), "entity_type": source.entity_type,
                "format": source.format.lower(),
            }
            started = time.monotonic()
            run["checksums"] = self._store(source)
            stored = time.monotonic()
            records = read(self.spark, source.format, source.url, **reader_options)
            run |= self.load(records, name, source.entity_type, run["run_id"])
            run["stages"] = {"store": stored - started, **run["stages"]}
        except Exception as error:
            self._log({**run, "status": "FAILED", "error": str(error), "ended_at": _now()})
            raise
        run |= {"status": "COMPLETED", "ended_at": _now()}
        self._log(run)
        return run

    def load(self, records: DataFrame, source: str, entity_type: str, run_id: str) -> dict:
        """Normalises parsed records (with their position) and upserts them, all or nothing.

        Returns rows_in, rows_upserted (before the last of a key wins), rows_rejected and the
        seconds of its stages. A run that is repeated under its id replaces its rejected rows.
        """
        clock = [time.monotonic()]
        rows = to_rows(records, source, entity_type, keep=POSITION)
        if entity_type == "interaction":
            rows = self._with_parents(rows)
        staged = f"{shared_dir(self.spark)}/staging/{run_id}-{uuid.uuid4().hex}"
        rows.write.parquet(staged)
        clock.append(time.monotonic())
        rows = self.spark.read.schema(rows.schema).parquet(staged)
        required = REQUIRED[entity_type]
        good, bad = quarantine(rows, required)
        if entity_type == "interaction":
            lost = good.withColumn("reason", unresolved_reason())
            bad = bad.unionByName(lost.filter(F.col("reason").isNotNull()))
            good = lost.filter(F.col("reason").isNull()).drop("reason")
        self.tables[entity_type].upsert(good, order=POSITION)
        clock.append(time.monotonic())
        rejected = bad.select(
            "source", F.lit(entity_type).alias("entity_type"), "external_id", "reason",
            F.to_json(F.struct(*[F.col(c) for c in rows.columns if c not in POSITION])).alias("record"),
            F.lit(run_id).alias("run_id"),
        )
        n_in, n_bad = rows.count(), bad.count()
        if n_bad:
            self.rejected.replace(rejected, "run_id")
        clock.append(time.monotonic())
        delete(self.spark, staged)
        stages = {name: b - a for name, a, b in zip(("parse", "upsert", "reject"), clock, clock[1:])}
        return {"rows_in": n_in, "rows_upserted": n_in - n_bad, "rows_rejected": n_bad, "stages": stages}

    def _with_parents(self, rows: DataFrame) -> DataFrame:
        resolved = resolve_interactions(
            rows, self.tables["compound"].read(), self.tables["protein"].read()
        )
        return resolved.withColumn("ingested_at", F.current_timestamp())

    def _store(self, source: Source) -> dict[str, str]:
        """Copies files that are not stored yet; returns the checksums of this run's files."""
        hashed = cut_lineage(hash_files(self.spark, source.url))
        artifacts = hashed.select(
            F.lit(source.source).alias("source"), F.lit(source.version).alias("version"), *hashed.columns
        )
        fresh = new_artifacts(artifacts, self.raw_files.read()).select(*hashed.columns)
        stored = store_raw(fresh, source.source, source.version, f"{self.root}/raw")
        self.raw_files.append(stored)
        total = hashed.agg(
            F.count(F.lit(1)).alias("n"), F.max("sha256").alias("sha"),
            F.bit_xor(F.xxhash64("filename", "sha256")).alias("xor"),
        ).first()
        if total["n"] == 1:
            return {"sha256": total["sha"]}
        return {"files": str(total["n"]), "xxhash64": str(total["xor"])}

    def _log(self, run: dict) -> None:
        fields = self.run_log.schema.names
        self.run_log.append(
            self.spark.createDataFrame([tuple(run.get(f) for f in fields)], self.run_log.schema)
        )
