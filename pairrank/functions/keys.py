"""Content addresses, surrogate ids and other key expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def surrogate_id(source, external_id) -> Column:
    """Id that a retried task makes again, unlike ``uuid()``."""
    return F.sha2(F.concat_ws(":", source, external_id), 256)


def content_sha(content) -> Column:
    return F.sha2(content, 256)


def artifact_key(source, version, sha, filename) -> Column:
    """``source/version/sha256/filename``."""
    return F.concat_ws("/", source, version, sha, filename)


def iso_utc(ts) -> Column:
    """ISO 8601 text of a UTC timestamp."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def hash_bucket(text, n: int) -> Column:
    """First 32 bits of md5, modulo ``n``; any SQL engine can repeat it."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % F.lit(n)
