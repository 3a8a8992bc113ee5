"""Content-addressed raw files: ``<source>/<version>/<sha256>/<filename>``."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairrank.functions.keys import artifact_key, content_sha

INLINE_BYTES = 32 << 20
BLOCK_BYTES = 8 << 20


def list_files(spark: SparkSession, path) -> DataFrame:
    """path, bytes, filename; the content is not read."""
    return spark.read.format("binaryFile").load(path).select(
        "path", F.col("length").alias("bytes"), F.substring_index("path", "/", -1).alias("filename")
    )


def _stream(source, sink=None) -> str:
    """SHA-256 of a stream read in blocks, copied to the sink on the way."""
    digest = hashlib.sha256()
    while block := source.read(BLOCK_BYTES):
        digest.update(block)
        if sink is not None:
            sink.write(block)
    return digest.hexdigest()


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """Filesystem and path of a URI as Spark writes it."""
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def hash_files(spark: SparkSession, path) -> DataFrame:
    """path, bytes, filename, sha256.

    Small files are hashed by Spark from ``binaryFile``; larger ones, which would not fit
    a row, are streamed in blocks, one file per task.
    """
    files = spark.read.format("binaryFile").load(path)
    named = F.substring_index("path", "/", -1).alias("filename")
    small = files.filter(F.col("length") <= INLINE_BYTES).select(
        "path", F.col("length").alias("bytes"), named, content_sha(F.col("content")).alias("sha256")
    )
    large = files.filter(F.col("length") > INLINE_BYTES).select("path", F.col("length").alias("bytes"), named)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas = []
            for name in batch.column("path").to_pylist():
                system, inner = _filesystem(name)
                with system.open_input_stream(inner, compression=None) as stream:
                    shas.append(_stream(stream))
            yield batch.append_column("sha256", pa.array(shas))

    streamed = large.repartition("path").mapInArrow(digest, "path string, bytes long, filename string, sha256 string")
    return small.unionByName(streamed)


def store_raw(hashed: DataFrame, source: str, version: str, root: str) -> DataFrame:
    """Copies hashed files under their content address; returns the ``raw_files`` rows.

    A copy appears under its address only when it is complete, and a retried task moves
    the same bytes to the same place.
    """
    keyed = hashed.select(
        F.lit(source).alias("source"), F.lit(version).alias("version"), "sha256", "bytes", "path",
        artifact_key(F.lit(source), F.lit(version), F.col("sha256"), F.col("filename")).alias("key"),
    )

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = _filesystem(root)
        for batch in batches:
            for name, key, sha in zip(
                batch.column("path").to_pylist(), batch.column("key").to_pylist(), batch.column("sha256").to_pylist()
            ):
                place = f"{base}/{key}"
                target.create_dir(place.rsplit("/", 1)[0], recursive=True)
                part = f"{place}.{uuid.uuid4().hex}.part"
                origin, inner = _filesystem(name)
                with origin.open_input_stream(inner, compression=None) as stream:
                    with target.open_output_stream(part, compression=None) as sink:
                        copied = _stream(stream, sink)
                if copied != sha:
                    target.delete_file(part)
                    raise ValueError(f"{name} changed while it was being stored")
                target.move(part, place)
            yield batch

    return keyed.repartition("path").mapInArrow(copy, keyed.schema)


def new_artifacts(hashed: DataFrame, stored: DataFrame) -> DataFrame:
    """Artifacts whose (source, version, sha256) is not stored yet."""
    key = ["source", "version", "sha256"]
    return hashed.join(stored.select(*key).distinct(), key, "left_anti")
