"""Removes passages that occur earlier: windows of 20 words, found by prefix-partitioned suffix trees.

A suffix tree over all texts is cut by prefixes into subtrees that fit a task. Its nodes of
depth 20 and more are the repeats; the windows below a node, in order of document and
place, are one original and its copies. Joined, a document's copied windows are its maximal
repeats.

1. Not every suffix is needed. Of the 13 runs of 8 words in a window the one of least hash
   (the first of equals) is the window's anchor, so equal windows have equal anchors, and about one
   word in seven is one. Trees hold the suffixes that start at anchors, each with the words
   before it that its windows reach: a window is a node on the right of the anchor and one
   on the left. Nothing is lost, and nothing is sampled.
2. An anchor's 8 words are the prefix that its suffix is dealt by. Prefixes that occur once
   are leaves and end here; copies of whole texts are one text first. Only for the others
   are the texts read again, for the words around the anchors.
3. Prefixes share a task up to its size. A prefix that is too frequent is dealt to several
   tasks, which find the copies among their own; what is first there goes on, under longer
   prefixes: the windows an anchor serves are halved, and each half shares more words. At
   the end a prefix is a whole window, of which each task leaves one. So a passage that half of
   all documents hold is reduced in a few rounds and never gathered.

Words and prefixes are compared as 64-bit hashes, copies of whole texts as 128-bit ones.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairrank.llm.common import WORD, hold, map_texts
from pairrank.llm.shingles import mix, word_hashes

#: Words of a window and of the shortest prefix, and the windows that can share an anchor.
WINDOW, PREFIX = 20, 8
SERVED = WINDOW - PREFIX + 1
#: Suffixes of a task, and of one prefix in a task.
TASK, SAME = 16_384, 8_192
MEMBERS = "key bigint, low int, high int, doc string, version bigint, place int, mask int, words binary"
_WORDS = re.compile(WORD)
_THREE = np.uint64(3)


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, key, low, high) of a text's anchors: the windows that start at place - high to place - low are its own."""
    if len(words) < WINDOW:
        none = np.empty(0, np.int64)
        return none, none, none, none
    runs = words
    for half in (1, 2, 4):
        runs = mix(runs[:-half] * _THREE + runs[half:])
    start = np.arange(len(words) - WINDOW + 1)
    at = start + np.lib.stride_tricks.sliding_window_view(runs, SERVED).argmin(axis=1)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], len(at)) - 1
    place = at[first]
    return place, runs[place].view(np.int64), place - start[last], place - start[first]


def _version(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _identified(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc"), _version(F.col(text)).alias("version"), F.col(text).alias("_text"))


def sketch(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, version, d1, d2, places, keys) of each text of a window or more; d1 and d2 digest its words."""

    def make():
        def work(texts):
            out = [], [], [], []
            for value in texts:
                words = word_hashes(value or "")
                place, key, _, _ = anchors(words)
                turn = np.arange(1, len(words) + 1, dtype=np.uint64)
                for salt, column in zip((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), out):
                    column.append(int(mix(words ^ mix(turn * np.uint64(salt))).sum(dtype=np.uint64).view(np.int64)))
                out[2].append(place)
                out[3].append(key)
            return out

        return work

    made = map_texts(_identified(docs, doc_id, text), "_text", "d1 bigint, d2 bigint, places array<int>, keys array<bigint>", make)
    return made.drop("_text").where(F.size("keys") > 0)


def whole_copies(marks: DataFrame) -> DataFrame:
    """(doc, version) of the texts whose words are all those of a smaller document."""
    texts = marks.select("doc", "version", "d1", "d2")
    first = hold(texts.groupBy("d1", "d2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("d1", "d2", "first"))
    return texts.join(first, ["d1", "d2"]).where("doc > first").select("doc", "version").distinct()


def _pieces(words: np.ndarray, left: np.ndarray, low: int, high: int) -> np.ndarray:
    """Prefix keys: hashes of the words that all windows of the offsets low to high share; ``left`` is the anchor's column."""
    at = left[:, None] + np.arange(-low, WINDOW - high)
    part = np.take_along_axis(words, at, axis=1)
    key = np.full(len(part), 64 * low + high + 1, np.uint64)
    for k in range(part.shape[1]):
        key = mix(key * _THREE + part[:, k])
    return key.view(np.int64)


def _children(node: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The tree's nodes one word deeper: equal where the node above and the word are."""
    order = np.lexsort((word, node))
    new = (np.diff(node[order], prepend=-1) != 0) | np.append(True, word[order][1:] != word[order][:-1])
    below = np.empty(len(node), np.int64)
    below[order] = np.cumsum(new)
    return below


def copied_windows(key: np.ndarray, order: np.ndarray, same: np.ndarray, mask: np.ndarray, words: np.ndarray, left: np.ndarray, low: int, high: int):
    """(copies, firsts): bit masks over offsets for each suffix of a subtree.

    Suffixes with one ``key`` share the prefix of the offsets low to high. ``order`` ranks
    them by document and place, ``same`` numbers the distinct ones. ``words`` has one row for
    each, with the anchor in column ``left`` and zeros where no window of it reaches.
    """
    copies, firsts = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    rows = np.arange(len(key))
    root = _children(np.zeros(len(key), np.int64), key)

    def walk(depths, column):
        node, nodes = root, []
        for d in depths:
            node = _children(node, words[rows, np.clip(column(d), 0, words.shape[1] - 1)])
            nodes.append(node)
        return [root, *nodes]

    right = walk(range(WINDOW - high, WINDOW - low), lambda d: left + d)
    before = walk(range(low + 1, high + 1), lambda d: left - d)
    for offset in range(low, high + 1):
        active = np.flatnonzero(mask >> offset & 1)
        one, other = right[high - offset][active], before[offset - low][active]
        sort = np.lexsort((order[active], other, one))
        one, other, active = one[sort], other[sort], active[sort]
        new = np.append(True, (one[1:] != one[:-1]) | (other[1:] != other[:-1]))[:len(active)]
        head = active[np.flatnonzero(new)][np.cumsum(new) - 1] if len(active) else active
        firsts[active[new]] |= 1 << offset
        copies[active[same[active] != same[head]]] |= 1 << offset
    return copies, firsts


def _subtree(rows: pa.Table) -> pa.Table:
    """One task: (copies) rows with the windows found to be copies, and for a prefix that has more tasks what goes on."""
    rows = rows.combine_chunks()
    n = len(rows)
    key, low, high, version, place, mask = (rows.column(c).to_numpy() for c in ("key", "low", "high", "version", "place", "mask"))
    order_of = rows.select(["doc", "version", "place"]).append_column("row", pa.array(np.arange(n))).sort_by([(c, "ascending") for c in ("doc", "version", "place")])
    sort = order_of.column("row").to_numpy()
    order = np.empty(n, np.int64)
    order[sort] = np.arange(n)
    doc = np.array(rows.column("doc").to_pylist(), object)
    differs = np.append(True, (doc[sort][1:] != doc[sort][:-1]) | (version[sort][1:] != version[sort][:-1]) | (place[sort][1:] != place[sort][:-1]))
    same = np.empty(n, np.int64)
    same[sort] = np.cumsum(differs)
    # Each row's words lie around its anchor; rows without a word there have a zero.
    reach_left = np.array([int(m).bit_length() - 1 for m in mask.tolist()])
    matrix = np.zeros((n, 2 * WINDOW), np.uint64)
    left = np.full(n, WINDOW)
    for k, data in enumerate(rows.column("words").to_pylist()):
        own = np.frombuffer(data, np.uint64)
        start = WINDOW - int(reach_left[k])
        matrix[k, start:start + len(own)] = own
    more = rows.column("g2")[0].as_py() >= 0
    out = {c: [] for c in ("key", "low", "high", "row", "mask", "copies")}

    def add(keys, lo, hi, which, masks, found):
        for c, v in zip(out, (keys, np.full(len(which), lo), np.full(len(which), hi), which, masks, found)):
            out[c].append(v)

    for lo, hi in {*zip(low.tolist(), high.tolist())}:
        chosen = np.flatnonzero((low == lo) & (high == hi))
        copies, firsts = copied_windows(key[chosen], order[chosen], same[chosen], mask[chosen], matrix[chosen], left[chosen], lo, hi)
        found = np.flatnonzero(copies)
        add(np.zeros(len(found), np.int64), 0, 0, chosen[found], np.zeros(len(found), np.int64), copies[found])
        if more:
            middle = (lo + hi) // 2
            for a, b in {(lo, middle), (min(middle + 1, hi), hi)}:
                left_over = firsts & ((2 << b) - (1 << a))
                on = np.flatnonzero(left_over)
                add(_pieces(matrix[chosen[on]], left[chosen[on]], a, b), a, b, chosen[on], left_over[on], np.zeros(len(on), np.int64))
    made = {c: np.concatenate(v) for c, v in out.items()}
    which = pa.array(made["row"])
    going = made["copies"] == 0
    words = rows.column("words").take(which).to_pylist()
    kept = []
    for k, data in enumerate(words):
        if going[k]:
            row, bits = int(made["row"][k]), int(made["mask"][k])
            reach, low_bit = bits.bit_length() - 1, (bits & -bits).bit_length() - 1
            anchor = int(reach_left[row])
            kept.append(data[8 * (anchor - reach):8 * (anchor + WINDOW - low_bit)])
        else:
            kept.append(None)
    return pa.table({
        "key": made["key"], "low": pa.array(made["low"], pa.int32()), "high": pa.array(made["high"], pa.int32()),
        "doc": rows.column("doc").take(which), "version": rows.column("version").take(which), "place": rows.column("place").take(which),
        "mask": pa.array(made["mask"], pa.int32()), "words": pa.array(kept, pa.binary()), "copies": pa.array(made["copies"], pa.int32()),
    })


def suffixes(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame) -> DataFrame:
    """The suffixes at the anchors of ``wanted`` (doc, version, anchors: place and rows of its prefix), as ``MEMBERS`` and n."""
    texts = _identified(docs, doc_id, text).join(wanted, ["doc", "version"]).select("doc", "version", "_text", "anchors")
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64()]
        for batch in batches:
            of, made = [], [[] for _ in types]

            def flush():
                key, low, high, place, mask, around, n = (pa.array(c, t) for c, t in zip(made, types))
                whose = pa.array(of, pa.int64())
                done = pa.RecordBatch.from_arrays(
                    [key, low, high, batch.column(0).take(whose), batch.column(1).take(whose), place, mask, around, n],
                    names=["key", "low", "high", "doc", "version", "place", "mask", "words", "n"],
                )
                of.clear()
                for column in made:
                    column.clear()
                return done

            for k in range(batch.num_rows):
                words = word_hashes(batch.column(2)[k].as_py() or "")
                chosen = {a["place"]: a["n"] for a in batch.column(3)[k].as_py()}
                for place, key, low, high in zip(*(c.tolist() for c in anchors(words))):
                    if place in chosen:
                        around = words[place - high:place + WINDOW - low].tobytes()
                        of.append(k)
                        for column, value in zip(made, (key, 0, SERVED - 1, place, (2 << high) - (1 << low), around, chosen[place])):
                            column.append(value)
                        if len(of) == TASK:
                            yield flush()
            yield flush()

    return texts.mapInArrow(run, MEMBERS.replace("doc string", f"doc {kind}") + ", n bigint")


def copied(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, version, place, copies) of the windows that occur earlier: bit o of ``copies`` is the window
    that starts o words before ``place``. A whole copy has place -1."""
    marks = hold(sketch(docs, doc_id, text))
    whole = hold(whole_copies(marks))
    single = marks.join(whole, ["doc", "version"], "left_anti").select("doc", "version", F.explode(F.arrays_zip("places", "keys")).alias("a"))
    single = single.select("doc", "version", F.col("a.places").alias("place"), F.col("a.keys").alias("key"))
    counts = hold(single.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    wanted = hold(single.join(counts, "key").groupBy("doc", "version").agg(F.collect_list(F.struct("place", "n")).alias("anchors")))

    rows = suffixes(docs, doc_id, text, wanted)
    total = counts.agg(F.sum("n")).first()[0] or 0
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = MEMBERS.replace("doc string", f"doc {kind}") + ", copies int"
    found = []
    while total:
        bins = math.ceil(total / TASK)
        few = F.col("n") <= SAME
        salt = F.pmod(F.xxhash64("doc", "version", "place"), F.ceil(F.col("n") / SAME)).cast("int")
        dealt = rows.withColumns({"g1": F.when(few, F.pmod(F.xxhash64("key"), F.lit(bins))).otherwise(F.col("key")), "g2": F.when(few, F.lit(-1)).otherwise(salt)})
        made = hold(dealt.groupBy("g1", "g2").applyInArrow(_subtree, schema))
        found.append(made.where("copies != 0").select("doc", "version", "place", "copies"))
        left_over = made.where("copies = 0").drop("copies")
        sizes = hold(left_over.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
        total = sizes.agg(F.sum("n")).first()[0] or 0
        rows = left_over.join(sizes, "key")
    parts = [whole.select("doc", "version", F.lit(-1).alias("place"), F.lit(0).alias("copies")), *found]
    return reduce(DataFrame.unionByName, parts)


def without_copied(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``text`` reduced to the kept words, joined by one blank, with ``n_words``, ``n_removed``
    and ``spans``: the removed words as (start, end) in order, end exclusive.

    Words end at blanks, tabs and line ends. A word goes if a window of 20 words that covers
    it has the words of a window that starts earlier: in a smaller document, or earlier in
    its own. Windows are judged on the texts as given, so what is left may still repeat.

    A null or blank text has no words and becomes empty; a text of fewer than 20 words keeps
    all. A row with a null id neither loses words nor makes others lose them. Rows that
    repeat id and text are one document; rows that repeat an id with other texts are ordered
    by a hash of the text. Texts of any length are read
    whole. An empty table gives an empty result. Columns named n_words, n_removed or spans
    are replaced, all others are returned as they are.
    """
    gone = copied(docs, doc_id, text).groupBy("doc", "version").agg(F.collect_list(F.struct("place", "copies")).alias("_gone"))
    gone = hold(gone).select(F.col("doc").alias("_gone_doc"), F.col("version").alias("_gone_version"), "_gone")
    docs = docs.drop("n_words", "n_removed", "spans")
    joined = docs.join(gone, (F.col(doc_id) == F.col("_gone_doc")) & (_version(F.col(text)) == F.col("_gone_version")), "left").drop("_gone_doc", "_gone_version")

    def make():
        def one(value, gone):
            words = _WORDS.findall(value or "")
            if not gone:
                return " ".join(words), len(words), 0, []
            steps = np.zeros(len(words) + 1, np.int64)
            for found in gone:
                if found["place"] < 0:
                    steps[0] += 1
                for offset in range(SERVED):
                    if found["copies"] >> offset & 1:
                        start = found["place"] - offset
                        steps[start] += 1
                        steps[start + WINDOW] -= 1
            removed = np.cumsum(steps[:-1]) > 0
            edges = np.flatnonzero(np.diff(np.concatenate(([False], removed, [False])).astype(np.int8))).reshape(-1, 2)
            spans = [{"start": int(a), "end": int(b)} for a, b in edges]
            return " ".join([w for w, r in zip(words, removed.tolist()) if not r]), len(words), int(removed.sum()), spans

        def work(texts, gone):
            kept, n, less, spans = zip(*map(one, texts, gone))
            return kept, n, less, pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

        return work

    made = map_texts(joined, text, "_kept string, n_words bigint, n_removed bigint, spans array<struct<start:int,end:int>>", make, ("_gone",))
    return made.withColumn(text, F.col("_kept")).drop("_kept", "_gone")
