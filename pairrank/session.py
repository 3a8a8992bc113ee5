"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE splits hot join keys at run time and sizes reduce tasks, so no plan here needs a
# hand-picked shuffle width.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def get_session(app: str = "pairrank", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the package defaults; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and held tables that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session that names none
    (tests) gets a temporary folder, kept for the rest of the session.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        # MLlib checkpoints its boosting rounds below this folder.
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="pairrank-"))
    return named or context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes the rows to a table in the shared folder and reads them back.

    Lost executors cost a re-read, not a recomputation; and unlike an RDD checkpoint the
    table is columnar, so later scans read only the columns they use.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/held/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """Spreads a small file scan over all cores before heavy per-row work.

    A table of few row groups is read by few tasks. Such a table is small, so moving it is
    cheap; a scan with enough tasks is returned as it is and never shuffled. Only for plain
    scans: on other plans the task count is not known before they run.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < 2 * cores else scan
