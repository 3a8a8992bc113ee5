"""Source catalogue: what a named source holds and how its files are read."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("sdf", "fasta", "csv")


@dataclass(frozen=True)
class Source:
    """A readable set of files. ``url`` is any path Spark can read."""

    source: str
    url: str
    format: str
    entity_type: str
    version: str = "latest"
    stats: dict = field(default_factory=dict)

    def discover(self) -> dict:
        return asdict(self)


_registered: dict[str, Source] = {}


def register_source(name: str, source: Source) -> None:
    """Add a source; a later registration under the same name replaces the earlier."""
    _registered[name] = source


def get_registered_source(name: str) -> Source:
    try:
        return _registered[name]
    except KeyError:
        raise ValueError(f"no source named '{name}'; known: {sorted(_registered)}") from None


# Versions and stated sizes of the two preset sources.


def chembl_source(url: str, version: str = "v33") -> Source:
    return Source("chembl", url, "sdf", "compound", version, {"estimated_compounds": 2_400_000})


def uniprot_source(url: str, version: str = "2024_01") -> Source:
    return Source("uniprot", url, "fasta", "protein", version, {"estimated_proteins": 570_000})


def catalogue(spark: SparkSession) -> DataFrame:
    """The registered sources as a table."""
    rows = [
        (name, s.source, s.version, s.format, s.entity_type, {k: str(v) for k, v in s.stats.items()}, s.url)
        for name, s in _registered.items()
    ]
    return spark.createDataFrame(
        rows,
        "name string, source string, version string, format string, entity_type string, "
        "stats map<string,string>, url string",
    )


def latest_entries(entries: DataFrame, order: list[str]) -> DataFrame:
    """Registration log to catalogue: the last entry of each name."""
    columns = [c for c in entries.columns if c != "name"]
    latest = entries.groupBy("name").agg(
        F.max_by(F.struct(*columns), F.struct(*order)).alias("_entry")
    )
    return latest.select("name", "_entry.*")


def reader_of(fmt: Column) -> Column:
    """Reader name of a format in any case; null when there is none."""
    lowered = F.lower(fmt)
    return F.when(lowered.isin(*FORMATS), lowered)


def route(loads: DataFrame, entries: DataFrame, by: str, measures: list[str]) -> DataFrame:
    """Totals per (reader, entity_type): one scan group each.

    ``loads`` is summed per source name before the join, so a hot source is one row by then.
    Names the catalogue does not hold come out under a null reader.
    """
    per_name = loads.groupBy(F.col(by).alias("name")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(m) for m in measures]
    )
    routed = per_name.join(entries, "name", "left").withColumn("reader", reader_of(F.col("format")))
    return routed.groupBy("reader", "entity_type").agg(
        F.sum("n").alias("n_loads"), F.count(F.lit(1)).alias("n_sources"),
        *[F.sum(m).alias(m) for m in measures],
    )
