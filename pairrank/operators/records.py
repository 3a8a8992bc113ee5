"""Parsed records to table rows, and checks of query tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairrank.functions.keys import surrogate_id
from pairrank.operators.topk import MAX_K

# Names of the entity types, and an interaction's columns with their defaults.
ENTITY_TYPES = ("compound", "protein", "interaction")
INTERACTION_DEFAULTS = {
    "interaction_type": ("string", "binds"),
    "label": ("int", 1),
    "affinity_value": ("double", None),
    "affinity_unit": ("string", None),
    "assay_type": ("string", None),
    "confidence": ("double", None),
}


def _field(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def to_rows(records: DataFrame, source, entity_type: str, keep: list[str] | None = None) -> DataFrame:
    """Records to rows of the entity's table; ``keep`` passes extra columns through.

    A compound's empty or missing external_id falls back to source_id. Rows that still
    have none are kept here with a null and split off by :func:`quarantine`.
    """
    if entity_type not in ENTITY_TYPES:
        raise ValueError(f"unknown entity_type '{entity_type}', expected one of {ENTITY_TYPES}")
    source = F.lit(source) if isinstance(source, str) else source
    given = F.nullif(_field(records, "external_id"), F.lit(""))
    if entity_type == "compound":
        external = F.coalesce(given, F.nullif(_field(records, "source_id"), F.lit("")))
        body = [
            _field(records, "smiles").alias("smiles"),
            _field(records, "props", "map<string,string>").alias("metadata"),
        ]
    elif entity_type == "protein":
        external = given
        body = [
            _field(records, "sequence").alias("sequence"),
            F.create_map(F.lit("description"), _field(records, "description")).alias("metadata"),
        ]
    else:
        external = given
        body = [
            F.coalesce(_field(records, name, kind), F.lit(default).cast(kind)).alias(name)
            for name, (kind, default) in INTERACTION_DEFAULTS.items()
        ] + [
            _field(records, name).alias(name)
            for name in (
                "compound_external_id", "compound_source", "protein_external_id", "protein_source"
            )
        ]
    return records.select(
        source.alias("source"), external.alias("external_id"), *body, *[F.col(c) for c in keep or []]
    ).withColumn("id", surrogate_id("source", "external_id"))


def quarantine(rows: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with a reason naming the missing columns)."""
    missing = F.concat_ws(",", *[F.when(F.col(c).isNull(), c) for c in required])
    good = rows.filter(missing == "")
    bad = rows.filter(missing != "").withColumn("reason", F.concat(F.lit("missing "), missing))
    return good, bad


def query_reason(text="query", top_k="top_k", entity_type="entity_type") -> Column:
    """Why a query is rejected; null when it is fine."""
    return (
        F.when(F.col(text).isNull() | ~F.col(text).rlike(r"\S"), "blank query")
        .when(F.col(top_k).isNull() | ~F.col(top_k).between(1, MAX_K), "top_k out of range")
        .when(
            F.col(entity_type).isNull() | ~F.lower(F.col(entity_type)).isin("protein", "compound"),
            "unknown entity_type",
        )
    )


def check_queries(queries: DataFrame, **names: str) -> tuple[DataFrame, DataFrame]:
    """(accepted queries, rejected queries with reason)."""
    marked = queries.withColumn("reason", query_reason(**names))
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())
