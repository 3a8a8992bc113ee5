"""Run-log aggregates and vector pooling."""

from __future__ import annotations

from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairrank.functions.vectors import from_ml_vector, to_ml_vector

# Bucket bounds (seconds, rows, seconds).
STAGE_SECONDS = (0.1, 0.5, 1, 5, 10, 30, 60, 120, 300, 600)
BATCH_ROWS = (10, 50, 100, 250, 500, 1000, 2500, 5000)
REQUEST_SECONDS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def runs_by_status(runs: DataFrame) -> DataFrame:
    return runs.groupBy("source", "status").agg(F.count(F.lit(1)).alias("runs"))


def sum_by(log: DataFrame, labels: list[str], amount: str, output: str) -> DataFrame:
    return log.groupBy(*labels).agg(F.sum(amount).cast("bigint").alias(output))


def records_by_source(log: DataFrame) -> DataFrame:
    """Upserted records by source and entity type."""
    return sum_by(log, ["source", "entity_type"], "rows_upserted", "records")


def parse_errors(log: DataFrame) -> DataFrame:
    """Rejected records by source and file format."""
    return sum_by(log, ["source", "format"], "rows_rejected", "errors")


def histogram(values: DataFrame, labels: list[str], value: str, bounds=STAGE_SECONDS) -> DataFrame:
    """Cumulative buckets per label set: le, bucket_count, value_sum, value_count.

    All buckets are conditional sums of one aggregation, reduced map-side.
    """
    amount = F.col(value)
    sums = values.groupBy(*labels).agg(
        *[F.sum(F.when(amount <= F.lit(float(b)), 1).otherwise(0)).alias(f"_b{i}") for i, b in enumerate(bounds)],
        F.count(amount).alias("value_count"),
        F.sum(amount.cast("double")).alias("value_sum"),
    )
    rows = [
        F.struct(F.lit(f"{float(b):g}").alias("le"), F.col(f"_b{i}").alias("bucket_count"))
        for i, b in enumerate(bounds)
    ] + [F.struct(F.lit("+Inf").alias("le"), F.col("value_count").alias("bucket_count"))]
    return sums.select(*labels, "value_sum", "value_count", F.inline(F.array(*rows)))


def stage_histogram(runs: DataFrame) -> DataFrame:
    """Buckets of the seconds that each stage of the runs took, by source and stage."""
    seconds = runs.select("source", F.explode("stages").alias("stage", "seconds"))
    return histogram(seconds, ["source", "stage"], "seconds")


def batch_histogram(runs: DataFrame) -> DataFrame:
    """Buckets of the rows that each run or batch read, by source and entity type."""
    return histogram(runs, ["source", "entity_type"], "rows_in", BATCH_ROWS)


def mean_pool(positions: DataFrame, by: list[str], vector: str, mask: str, output: str = "pooled") -> DataFrame:
    """Mean of the position vectors whose mask is set, per group.

    Whole vectors are summed map-side, so neither a long group nor a wide vector is
    exploded. A group without a single position left has no mean and no row.
    """
    kept = positions.filter(F.col(mask) == 1).select(*by, to_ml_vector(F.col(vector)).alias("_v"))
    pooled = kept.groupBy(*by).agg(Summarizer.mean(F.col("_v")).alias("_m"))
    return pooled.select(*by, from_ml_vector("_m").alias(output))
