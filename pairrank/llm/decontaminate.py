"""Finds passages of test items in documents, allowing for edits.

Pigeonhole edit matching: an item that may differ in k edits is split into k + 1 pieces, so
at least one piece of any such passage is unedited. An automaton over all pieces finds the
exact hits of each text in one pass; each hit says where its item would lie, and Myers'
bit-parallel algorithm gives the least edit distance of the item to a substring there.

Items are broadcast in blocks of bounded size; more items mean more passes over the
documents, never a larger broadcast. Nothing is shuffled.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Edits allowed for each character of an item.
ERROR_RATE = 0.06
#: Items shorter than this (normalised) are no passage and match nothing.
MIN_CHARS = 32
#: Characters of items broadcast at a time.
BLOCK_CHARS = 8 << 20
SLICE_ROWS = 512
MATCH = "array<struct<item_id:bigint,distance:int>>"
ARROW_MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())]))


def normalise(text: str | None) -> str:
    """Lower case, runs of white space as one blank, none at the ends."""
    return " ".join((text or "").lower().split())


def budget(item: str, error_rate: float) -> int:
    return int(len(item) * error_rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece) of ``errors + 1`` pieces of nearly equal length."""
    cuts = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def pattern_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for at, letter in enumerate(item):
        masks[letter] = masks.get(letter, 0) | 1 << at
    return masks


def myers(masks: dict[str, int], length: int, text: str) -> int:
    """Least edit distance of the pattern to any substring of ``text`` (Myers 1999), in one word of ``length`` bits."""
    full, top = (1 << length) - 1, length - 1
    plus, minus, score = full, 0, length
    least = score
    for letter in text:
        equal = masks.get(letter, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        score += (up >> top & 1) - (down >> top & 1)
        if score < least:
            least = score
        up = up << 1 & full
        down = down << 1 & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
    return least


class Matcher:
    """All items of a block: (id, normalised text) pairs."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        import ahocorasick

        self.items = [(i, t, budget(t, error_rate), pattern_masks(t)) for i, t in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for index, (_, text, errors, _) in enumerate(self.items):
            for offset, piece in pieces(text, errors):
                where.setdefault(piece, []).append((index, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def match(self, text: str | None) -> list[dict]:
        """{item_id, distance} of each item within its budget somewhere in the text."""
        if not self.items:
            return []
        text = normalise(text)
        starts: dict[int, set[int]] = {}
        for end, (length, places) in self.automaton.iter(text):
            for index, offset in places:
                starts.setdefault(index, set()).add(end + 1 - length - offset)
        found = []
        for index, places in starts.items():
            number, item, errors, masks = self.items[index]
            if item in text:
                found.append({"item_id": number, "distance": 0})
                continue
            least, ordered, at = errors + 1, sorted(places), 0
            while at < len(ordered):
                # Places that lie closer than the budget share a window.
                last = at
                while last + 1 < len(ordered) and ordered[last + 1] - ordered[last] <= errors:
                    last += 1
                window = text[max(0, ordered[at] - errors):ordered[last] + len(item) + errors]
                least = min(least, myers(masks, len(item), window))
                at = last + 1
            if least <= errors:
                found.append({"item_id": number, "distance": least})
        return sorted(found, key=lambda m: m["item_id"])


def _with_matches(docs: DataFrame, text: str, column: str, items: list[tuple[int, str]], error_rate: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    at, names = docs.columns.index(text), [*docs.columns, column]

    def run(batches):
        matcher = Matcher(shared.value, error_rate)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                found = [matcher.match(t) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, ARROW_MATCH)], names=names)

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *StructType.fromDDL(f"`{column}` {MATCH}").fields]))


def match_items(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS,
) -> DataFrame:
    """``docs`` with ``matches``: (item_id, distance) of each item of ``benchmark`` it holds.

    An item matches if its distance to some substring, both in lower case and with single
    blanks, is at most ``error_rate`` of its length. Null or short items and items with a
    null id match nothing; null and empty texts hold none. Items that repeat an id count
    once, with their least distance. A column named matches is replaced.
    """
    docs = docs.drop("matches")
    items = benchmark.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(
        F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("item"),
    ).distinct()
    chars = items.agg(F.sum(F.length("item")).alias("chars")).first().chars or 0
    blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    columns = []
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(blocks)) == block).collect()
        texts = sorted({(r.item_id, normalise(r.item)) for r in rows})
        columns.append(f"_matches_{block}")
        docs = _with_matches(docs, text, columns[-1], [(i, t) for i, t in texts if len(t) >= min_chars], error_rate)
    every = F.flatten(F.array(*columns))
    ids = F.array_sort(F.array_distinct(F.transform(every, lambda m: m.item_id)))
    least = F.transform(ids, lambda i: F.struct(
        i.alias("item_id"), F.array_min(F.transform(F.filter(every, lambda m: m.item_id == i), lambda m: m.distance)).alias("distance"),
    ))
    return docs.withColumn("matches", least).drop(*columns)


def without_items(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no item; same columns."""
    found = match_items(docs.withColumnRenamed("matches", "_own_matches") if "matches" in docs.columns else docs, benchmark, **options)
    clean = found.where(F.size("matches") == 0).drop("matches")
    return clean.withColumnRenamed("_own_matches", "matches") if "matches" in docs.columns else clean
