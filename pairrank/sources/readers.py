"""Scans of SDF, FASTA and CSV files.

SDF and FASTA are text with a record separator, which Spark splits like lines: a plain
file is read by many tasks. A ``.gz`` file is one task by nature, so its records are
spread by ``repartition`` right after the scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Where a record stood, for last-wins order: file time, file, block, place in block.
POSITION = ["_file_time", "_file", "_block", "_place"]


def with_position(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        F.col("_metadata.file_modification_time").alias("_file_time"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_place"),
    )


def _is_gzip(path: str | list[str]) -> bool:
    return any(p.endswith(".gz") for p in ([path] if isinstance(path, str) else path))


def _records(spark: SparkSession, path, separator: str, partitions: int | None) -> DataFrame:
    rows = with_position(spark.read.option("lineSep", separator).text(path))
    if partitions or _is_gzip(path):
        rows = rows.repartition(partitions or spark.sparkContext.defaultParallelism)
    return rows


# ---------------------------------------------------------------------------------- SDF


ITEM_HEADER = r"(?m)^>[^\n<]*<"
#: Starts the line that ends a record, whether lines end with a line feed alone or not.
SDF_SEPARATOR = "\n$$$$"


#: The fixed start of a molecule's fourth line: two numbers of three places.
COUNTS = r"(?=.{0,5}\d)[ \d]{6}(?:[ \d]|\r?(?:\n|\z))"


def without_line_rest(records: DataFrame, text: str = "value", block: str = "_block") -> DataFrame:
    """Takes the rest of the separator's line from the start of each record.

    All records but a file's first begin with it. A record of a later block is not the first
    (``block`` is the offset where its block starts), nor is one whose fifth line holds the
    counts, which stand in a molecule's fourth. A first record with a blank name looks alike
    but has them in its fourth line, and keeps its blank line.
    """
    def counts_in(line: int) -> Column:
        return F.col(text).rlike(rf"\A(?:[^\n]*\n){{{line - 1}}}{COUNTS}")

    first = (F.col(block) == 0) if block in records.columns else F.lit(True)
    keeps = first & counts_in(4) & ~counts_in(5)
    return records.withColumn(text, F.when(keeps, F.col(text)).otherwise(F.regexp_replace(text, r"\A[ \t\r]*\n", "")))


def _sdf_items(text: Column) -> Column:
    """(name, value) of each data item: header line, value lines up to a blank one."""

    def item(part: Column) -> Column:
        rest = F.substring(part, F.locate("\n", part) + 1, F.length(part))
        value = F.rtrim(F.substring_index(rest, "\n\n", 1), F.lit("\n"))
        return F.struct(
            F.substring_index(part, ">", 1).alias("name"),
            F.when(rest.startswith("\n"), "").otherwise(value).alias("value"),
        )

    parts = F.split(text, ITEM_HEADER)
    return F.transform(F.slice(parts, 2, F.size(parts)), item)


def _sdf_props(items: Column) -> Column:
    """Items as a map; a property given twice keeps its last value."""
    names = F.transform(items, lambda item: item["name"])
    last = F.filter(
        items,
        lambda item, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), item["name"]),
    )
    unique = F.size(F.array_distinct(names)) == F.size(names)
    return F.map_from_entries(F.when(unique, items).otherwise(last))


def parse_sdf(records: DataFrame, text: str = "value", external_id_prop: str = "_Name", smiles_prop: str = "SMILES") -> DataFrame:
    """external_id, smiles, props of each readable molecule, beside the other columns.

    ``_Name`` is the record's first line; other names are properties. A record without the
    end of a connection table or without the structure property has a null ``smiles``, so a
    load rejects and counts it; only blank records are skipped.
    """
    kept = [F.col(c) for c in records.columns if c != text]
    whole = F.col(text).contains("M  END")
    cleaned = records.filter(F.col(text).rlike(r"\S")).withColumn(text, F.regexp_replace(text, r"\r|\$\$\$\$\s*$", ""))
    items = cleaned.withColumn("_items", _sdf_items(F.col(text)))
    props = items.withColumn("_props", _sdf_props(F.col("_items")))
    name = F.nullif(F.trim(F.substring_index(text, "\n", 1)), F.lit(""))
    key = name if external_id_prop == "_Name" else F.try_element_at("_props", F.lit(external_id_prop))
    return props.select(
        key.alias("external_id"),
        F.when(whole, F.nullif(F.try_element_at("_props", F.lit(smiles_prop)), F.lit(""))).alias("smiles"),
        F.map_filter("_props", lambda k, _: k != smiles_prop).alias("props"),
        *kept,
    )


def read_sdf(
    spark: SparkSession, path, external_id_prop: str = "_Name", smiles_prop: str = "SMILES",
    partitions: int | None = None,
) -> DataFrame:
    rows = without_line_rest(_records(spark, path, SDF_SEPARATOR, partitions))
    return parse_sdf(rows, external_id_prop=external_id_prop, smiles_prop=smiles_prop)


# -------------------------------------------------------------------------------- FASTA


def parse_fasta(records: DataFrame, text: str = "value") -> DataFrame:
    """external_id (header up to the first blank), description (header), sequence."""
    kept = [F.col(c) for c in records.columns if c != text]
    filled = records.filter(F.col(text).rlike(r"\S"))
    end = F.locate("\n", F.col(text))
    header = F.when(end > 0, F.substring(text, F.lit(1), end - 1)).otherwise(F.col(text))
    body = F.when(end > 0, F.substring(text, end + 1, F.length(text))).otherwise("")
    parts = filled.select(
        F.regexp_replace(header, "^>|\r", "").alias("description"),
        F.regexp_replace(body, r"\s", "").alias("sequence"), *kept,
    )
    key = F.regexp_extract("description", r"^(\S*)", 1).alias("external_id")
    return parts.select(key, "description", "sequence", *kept)


def read_fasta(spark: SparkSession, path, partitions: int | None = None) -> DataFrame:
    return parse_fasta(_records(spark, path, "\n>", partitions))


# ---------------------------------------------------------------------------------- CSV


def read_csv(
    spark: SparkSession, path, schema: str | None = None, partitions: int | None = None, multi_line: bool = False,
) -> DataFrame:
    """CSV with header. Give a schema for large inputs: inferring one reads the data twice.

    ``multi_line`` reads quoted values that hold line ends; a file is then one task.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    rows = with_position(reader.csv(path))
    if partitions or _is_gzip(path):
        rows = rows.repartition(partitions or spark.sparkContext.defaultParallelism)
    return rows


#: The reader of each format that the catalogue knows.
READERS: dict[str, Callable[..., DataFrame]] = {"sdf": read_sdf, "fasta": read_fasta, "csv": read_csv}


def read(spark: SparkSession, fmt: str, path, **options) -> DataFrame:
    """The records of files in a named format, in any case of letters."""
    if fmt.lower() not in READERS:
        raise ValueError(f"no reader for format '{fmt}'; known: {sorted(READERS)}")
    return READERS[fmt.lower()](spark, path, **options)
