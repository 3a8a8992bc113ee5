"""Helpers shared by the operators of this package."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairrank.session import shared_dir

# The characters that end a word or are stripped from a line: blank, tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a task turns into Python objects at a time.
SLICE_ROWS = 1024
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW = {
    "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
    "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()),
    "array<string>": pa.list_(pa.string()),
}


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Sets one session value for the length of a block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


class Held:
    """A table written to the shared folder, and what reads it."""

    def __init__(self, df: DataFrame, path: str):
        self.df, self.path = df, path

    def release(self) -> None:
        """Deletes the files; for tables that no later plan reads."""
        files, where = _files(self.df.sparkSession, self.path)
        files.delete(where, True)


def held(df: DataFrame) -> Held:
    """Writes the rows to the shared folder and reads them back, which cuts the lineage.

    A lost executor costs a re-read. The shuffle files of the plan that made the rows go as
    soon as they are written, and the table itself goes with the session.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/held/{uuid.uuid4().hex}"
    with setting(spark, CLEANUP, "true"):
        df.write.parquet(path)
    files, where = _files(spark, path)
    files.deleteOnExit(where)
    return Held(spark.read.schema(df.schema).parquet(path), path)


def hold(df: DataFrame) -> DataFrame:
    return held(df).df


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other letters as they are."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def fold(identifier: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in no fold."""
    return F.crc32(identifier.cast("string").cast("binary")) % folds


def map_texts(docs: DataFrame, text: str, columns: str, make: Callable[[], Callable], also: tuple[str, ...] = ()) -> DataFrame:
    """Appends columns computed from the texts, batch by batch, inside the scan's tasks.

    ``make()`` runs once in a task and returns a function from a list of texts to one value
    list for each column of ``columns`` (DDL); columns ``also`` go in after the texts. All other columns pass through Arrow unread;
    columns of ``docs`` that have the name of a new one are replaced.
    """
    fields = StructType.fromDDL(columns).fields
    docs = docs.drop(*(f.name for f in fields))
    names = [*docs.columns, *(f.name for f in fields)]
    kinds = [ARROW.get(f.dataType.simpleString()) for f in fields]
    at = [docs.columns.index(c) for c in (text, *also)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                made = work(*(part.column(k).to_pylist() for k in at))
                new = [c if isinstance(c, pa.Array) else pa.array(c, kind) for c, kind in zip(made, kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=names)

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *fields]))


def replace_text(docs: DataFrame, text: str, value: Column) -> DataFrame:
    """``docs`` with another text; a column ``n_chars`` follows it."""
    docs = docs.withColumn(text, value)
    return docs.withColumn("n_chars", F.length(text).cast("long")) if "n_chars" in docs.columns else docs


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node ties its larger neighbours to the least of itself and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("of")).agg(F.least("of", F.min("b")).alias("to"))
    tied = both.where("b > a").join(least, F.col("a") == F.col("of"))
    return tied.select(F.col("b").alias("a"), F.col("to").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node ties itself and its smaller neighbours (``b`` of ``a``) to the least of them."""
    least = edges.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("to"))
    tied = edges.join(least, F.col("a") == F.col("of")).where("b > to").select(F.col("b").alias("a"), F.col("to").alias("b"))
    return tied.union(least.select(F.col("of").alias("a"), F.col("to").alias("b"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every ``a`` has one ``b`` and no ``b`` is tied further."""
    if not edges.groupBy("a").count().where("count > 1").isEmpty():
        return False
    return edges.select("b").distinct().join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()


def components(edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): rows (node, label), label the least id.

    Large and small stars in turn (Kiveris et al. 2014): the edges never grow in number, and a
    chain halves in each round, so a chain of n nodes settles in about log2(n) rounds. Least
    neighbours are combined before the shuffle, and the joins read held tables, so AQE can
    split a hot hub. Loops are dropped. The number of rounds is appended to ``rounds``.
    """
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    tied, taken = held(down), 0
    while not _are_stars(tied.df):
        for star in (_large_star, _small_star):
            before, tied = tied, held(star(tied.df))
            before.release()
        taken += 1
    if rounds is not None:
        rounds.append(taken)
    hubs = tied.df.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return tied.df.select(F.col("a").alias("node"), F.col("b").alias("label")).union(hubs)
