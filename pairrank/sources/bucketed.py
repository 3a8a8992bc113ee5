"""Tables in hash buckets of a key: joins on it between equal bucket counts move no rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

#: Buckets that a task may write a file each for; rows of more buckets are moved to them first.
FILES = 64
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


def _name(path: str) -> str:
    return "bucketed_" + hashlib.md5(path.encode()).hexdigest()


def write_bucketed(df: DataFrame, path: str, key: list[str], buckets: int) -> DataFrame:
    """Writes ``df`` anew under ``path``, one sorted file for each bucket, and reads it back.

    Rows move once, here. The rows of a key share a file, so hot keys belong elsewhere
    (:class:`pairrank.operators.colocated.PairLayout`).
    """
    return _write(df.repartition(_checked(buckets), *key), path, key, buckets)


def write_in_place(df: DataFrame, path: str, key: list[str], buckets: int) -> DataFrame:
    """Writes ``df`` anew under ``path``, in buckets, by the tasks that compute it, and reads it back.

    A task keeps a file open for each bucket that it has rows of. No row is moved or sorted, so the
    table is all that takes disk, and the rows of a hot key stay with their tasks. Past :data:`FILES`
    buckets the files would be small: rows are then moved once, in a shuffle whose large partitions AQE splits.
    """
    conf, spread = df.sparkSession.conf, _checked(buckets) > FILES
    before = conf.get(OPEN_FILES, None)
    conf.set(OPEN_FILES, str(FILES))
    try:
        return _write(df.hint("rebalance", buckets, *key) if spread else df, path, key, buckets, False)
    finally:
        conf.unset(OPEN_FILES) if before is None else conf.set(OPEN_FILES, before)


def _checked(buckets: int) -> int:
    if buckets < 1:
        raise ValueError(f"the number of buckets must be positive, got {buckets}")
    return buckets


def _write(df: DataFrame, path: str, key: list[str], buckets: int, ordered: bool = True) -> DataFrame:
    writer = df.write.mode("overwrite").option("path", path).bucketBy(buckets, *key)
    if ordered:
        writer = writer.sortBy(*key)
    else:
        # Unsorted keys repeat out of sight of snappy.
        writer = writer.option("compression", "zstd")
    writer.saveAsTable(_name(path))
    return df.sparkSession.table(_name(path))


def read_bucketed(spark: SparkSession, path: str, key: list[str], buckets: int) -> DataFrame:
    """What :func:`write_bucketed` wrote, in this session or another.

    Key and bucket count must be those of the write; whoever writes stores them.
    """
    name = _name(path)
    if not spark.catalog.tableExists(name):
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        by = ", ".join(f"`{k}`" for k in key)
        spark.sql(
            f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) "
            f"INTO {buckets} BUCKETS LOCATION '{path}'"
        )
    return spark.table(name)
