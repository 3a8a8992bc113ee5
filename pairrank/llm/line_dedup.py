"""Drops lines that an earlier document holds already; DataFrame functions only.

Lines become pairs of 64-bit hashes. The hashes are range-partitioned and sorted by document
and position, so one pass over a partition sees the first occurrence of each line before the
later ones. What leaves that pass is a bitmap for each document that loses lines, never text.

A line that very many documents hold would be one long run in one partition. Such keys are
found first: counts of 65,536 hash ranges, then counts of the keys in ranges that are too
full. A key above a two-thousandth of all lines is heavy; there are fewer than 2,000 of
them whatever the data, so their first documents are broadcast and their lines never sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairrank.llm.common import BLANKS, hold, replace_text

#: A key with more than one of this many of the lines is heavy.
HEAVY_SHARE = 2000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case and other letters as they are."""
    line = F.trim(line, F.lit(BLANKS))
    return F.when(line.rlike(r"[^\x00-\x7F]"), F.translate(line, UPPER, LOWER)).otherwise(F.lower(line))


def _version(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """(h1, h2, doc, version, pos) of each line with a key of at least ``min_chars`` code points."""
    return (
        docs.where(F.col(doc_id).isNotNull())
        .select(F.col(doc_id).alias("doc"), _version(F.col(text)).alias("version"), F.posexplode(_lines(F.col(text))).alias("pos", "line"))
        .select("doc", "version", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "version", "pos")
    )


def repeated_lines(lines: DataFrame) -> DataFrame:
    """(doc, version, pos) of the lines whose key a smaller document holds."""
    rows = lines.count()
    limit = max(1, rows // HEAVY_SHARE)
    bucket = F.shiftrightunsigned("h1", 48)
    full = [r.bucket for r in lines.groupBy(bucket.alias("bucket")).count().where(F.col("count") > limit).collect()]
    heavy = hold(
        lines.where(bucket.isin(full) if full else F.lit(False)).groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.min("doc").alias("first"))
        .where(F.col("n") > limit).select("h1", "h2", "first")
    )
    # At most HEAVY_SHARE rows of 24 bytes.
    of_heavy = lines.join(F.broadcast(heavy), ["h1", "h2"]).where("doc > first")
    rest = lines.join(F.broadcast(heavy.select("h1", "h2")), ["h1", "h2"], "left_anti")
    ahead = Window.partitionBy("h1", "h2").orderBy("doc", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of_rest = (
        rest.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", "doc", "pos")
        .withColumn("first", F.first("doc").over(ahead)).where("doc > first")
    )
    return of_rest.select("doc", "version", "pos").unionByName(of_heavy.select("doc", "version", "pos"))


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10) -> DataFrame:
    """(doc, version, n_dropped, keep) of each document that loses lines.

    ``keep`` has the 64-bit words of the keep bitmap that are not all ones, as (word, bits)
    in order; bit i of word w tells whether line 64 * w + i stays. ``version`` is a hash of the
    text, so rows that repeat a doc_id with other texts have bitmaps of their own.
    """
    lines = hold(line_hashes(docs, doc_id, text, min_chars))
    bit = F.expr("shiftleft(1L, pos % 64)")
    words = (
        repeated_lines(lines).groupBy("doc", "version", F.expr("cast(pos div 64 as int)").alias("word"))
        .agg(F.bit_or(bit).alias("gone"))
    )
    return words.groupBy("doc", "version").agg(
        F.sum(F.bit_count("gone")).alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits")))).alias("keep"),
    )


def _dropped_positions(keep: Column) -> Column:
    return F.flatten(F.transform(keep, lambda w: F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(w.bits, i) == 0), lambda i: w.word * 64 + i,
    )))


def kept_text(text: Column, keep: Column) -> Column:
    """The lines whose bit is set, joined again."""
    lines = _lines(text)
    chosen = F.transform(F.array(lines), lambda all_lines: F.concat_ws("\n", F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), _dropped_positions(keep)), lambda i: F.get(all_lines, i),
    )))
    return F.when(keep.isNull(), F.coalesce(text, F.lit(""))).otherwise(chosen[0])


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10) -> DataFrame:
    """``docs`` with ``text`` reduced to the kept lines, ``n_lines`` before and ``n_dropped``.

    Null or empty texts are one empty line. A row with a null id neither loses lines nor
    makes others lose them. Rows that repeat an id are one document: none of them loses a
    line to another. All rows stay, those that lose every line with an empty text. An empty
    table gives an empty result. Columns named n_lines or n_dropped are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    gone = keep_bitmaps(docs, doc_id, text, min_chars).select(
        F.col("doc").alias("_gone_doc"), F.col("version").alias("_gone_version"), F.col("n_dropped").alias("_gone_n"), F.col("keep").alias("_gone_keep"),
    )
    joined = docs.join(
        hold(gone), (F.col(doc_id) == F.col("_gone_doc")) & (_version(F.col(text)) == F.col("_gone_version")), "left",
    ).withColumns({"n_lines": F.size(_lines(F.col(text))).cast("long"), "n_dropped": F.coalesce("_gone_n", F.lit(0)).cast("long")})
    return replace_text(joined, text, kept_text(F.col(text), F.col("_gone_keep"))).drop(
        "_gone_doc", "_gone_version", "_gone_n", "_gone_keep"
    )
