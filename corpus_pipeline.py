"""A corpus pipeline: toxicity, line dedup, near duplicates, decontamination, encoding.

Each stage gets what the one before kept, as read back from Parquet. All but the last
return the columns of ``documents``; the last adds the token ids. Models and thresholds
are fitted on a stage's own input. Null, empty and very long texts, repeated rows and null
ids are handled as each stage's operator states; an empty table gives an empty result. Own
columns of the table keep their values, whatever an operator calls its results, in any
case; only ``ids`` and ``n_ids`` are replaced by the last stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairrank.llm import decontaminate, line_dedup, ngram_join, toxicity, unigram
from pairrank.session import shared_dir


def _beside(docs: DataFrame, results: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work(docs)`` with the columns of ``docs`` alone; those named like a result of ``work`` stand aside meanwhile."""
    aside = {c: f"_own_{i}_{c}" for i, c in enumerate(docs.columns) if c.lower() in results}
    done = work(docs.withColumnsRenamed(aside)) if aside else work(docs)
    return done.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _beside(docs, ("n_lines", "n_dropped"), line_dedup.dedup_lines)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _beside(docs, ("matches",), lambda rows: decontaminate.without_items(rows, items))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return unigram.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", keep_one_of_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("sentencepiece", encode),
]

#: Learned scores, edit distances and piece paths are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each stage's rows are written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(made.schema).parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
