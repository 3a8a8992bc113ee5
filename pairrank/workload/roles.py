"""The driver's tables in the roles of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairrank.functions.keys import surrogate_id
from pairrank.functions.text import qgram_bits
from pairrank.session import spread

N_BITS = 2048
DIM = 320


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts: the brand is the source, the name (blank as '=') the structure."""
    return table(spark, sf_dir, "part").select(
        surrogate_id(F.col("p_brand"), F.col("p_partkey")).alias("id"),
        F.col("p_brand").alias("source"),
        F.col("p_partkey").cast("string").alias("external_id"),
        F.translate("p_name", " ", "=").alias("smiles"),
        F.create_map(F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string")).alias("metadata"),
    )


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers: the nation is the source, the name the sequence."""
    source = F.concat(F.lit("nation"), "s_nationkey")
    return table(spark, sf_dir, "supplier").select(
        surrogate_id(source, F.col("s_suppkey")).alias("id"),
        source.alias("source"),
        F.col("s_suppkey").cast("string").alias("external_id"),
        F.col("s_name").alias("sequence"),
        F.create_map(F.lit("balance"), F.col("s_acctbal").cast("string")).alias("metadata"),
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items; returned ones are the positives."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("external_id"),
        F.col("l_partkey").alias("compound_id"),
        F.col("l_suppkey").alias("protein_id"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
    )


def interaction_parents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Compounds and proteins under the numeric ids line items use."""
    return (
        compounds(spark, sf_dir).withColumn("id", F.col("external_id").cast("bigint")),
        proteins(spark, sf_dir).withColumn("id", F.col("external_id").cast("bigint")),
    )


def compound_features(spark: SparkSession, sf_dir: str, n_bits: int = N_BITS) -> DataFrame:
    return compounds(spark, sf_dir).select(
        "external_id", "source", qgram_bits(F.col("smiles"), n_bits).alias("fp")
    )


def protein_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that have an embedding of their number."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("external_id"), F.col("embedding").alias("emb")
    )
    return proteins(spark, sf_dir).select("external_id", "source").join(vectors, "external_id")


def embedding_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("label"), "label").alias("source"),
        F.col("vec_id").cast("string").alias("external_id"),
        F.col("embedding").alias("vector"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts for the featurisers, spread over the cores."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).withColumn(
        "external_id", F.col("doc_id").cast("string")
    )


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, label, score: quality labels with a score that has ties."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    size = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return labels.join(size, "doc_id").select(
        F.col("doc_id").alias("key"), "label", ((F.col("n_chars") % 1000) / F.lit(1000.0)).alias("score")
    )
