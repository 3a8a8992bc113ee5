"""Incremental ingest: arriving files go through the same load as a batch run."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairrank.plans.ingest import Ingestion, _now
from pairrank.sources.catalog import Source
from pairrank.sources.readers import SDF_SEPARATOR, parse_fasta, parse_sdf, without_line_rest

SEPARATORS = {"sdf": SDF_SEPARATOR, "fasta": "\n>"}


def _arriving(ingestion: Ingestion, source: Source, schema: str | None, max_files: int | None) -> DataFrame:
    reader = ingestion.spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if source.format.lower() == "csv":
        if schema is None:
            raise ValueError("a CSV stream needs a schema")
        rows = reader.schema(schema).option("header", True).csv(source.url)
    elif source.format.lower() in SEPARATORS:
        rows = reader.option("lineSep", SEPARATORS[source.format.lower()]).text(source.url)
    else:
        raise ValueError(f"no reader for format '{source.format}'")
    return rows.select(
        "*",
        F.col("_metadata.file_modification_time").alias("_file_time"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )


def _parsed(batch: DataFrame, fmt: str, options: dict) -> DataFrame:
    placed = batch.withColumn("_place", F.monotonically_increasing_id())
    if fmt == "sdf":
        return parse_sdf(without_line_rest(placed), **options)
    if fmt == "fasta":
        return parse_fasta(placed)
    return placed


def ingest_stream(
    ingestion: Ingestion, name: str, source: Source, checkpoint: str, schema: str | None = None,
    max_files: int | None = None, **parse_options,
) -> StreamingQuery:
    """Starts an ``availableNow`` query that loads each file once.

    ``foreachBatch`` may run a batch again after a failure. The batch's run is logged under
    an id made of the checkpoint and the batch number: a batch that completed is skipped,
    and one that did not is upserted again, with the same result.
    """
    fmt = source.format.lower()

    def load(batch: DataFrame, batch_id: int) -> None:
        run_id = hashlib.sha256(f"{name}|{checkpoint}|{batch_id}".encode()).hexdigest()
        done = ingestion.run_log.read().filter((F.col("run_id") == run_id) & (F.col("status") == "COMPLETED"))
        if not done.isEmpty():
            return
        run = {
            "run_id": run_id, "source": name, "entity_type": source.entity_type, "format": fmt,
            "batch_id": batch_id, "started_at": _now(),
        }
        ingestion._log({**run, "status": "STARTED"})
        try:
            run |= ingestion.load(_parsed(batch, fmt, parse_options), name, source.entity_type, run_id)
        except Exception as error:
            ingestion._log({**run, "status": "FAILED", "error": str(error), "ended_at": _now()})
            raise
        ingestion._log({**run, "status": "COMPLETED", "ended_at": _now()})

    return (
        _arriving(ingestion, source, schema, max_files)
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
