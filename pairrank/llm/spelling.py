"""Groups spelling variants: pairs of words one edit apart, and the form each word goes back to.

One edit changes the letter counts of a word little: an inserted or deleted letter changes
one count by one (squared distance 1 of the count vectors, adjacent lengths), a replaced one
two counts (squared distance 2, equal lengths). So:

1. Words are counted inside the scan's tasks first, so a word that fills the corpus is a few
   rows when it is shuffled.
2. Blocks are words of equal length and equal counts in each of six groups of letters. A
   variant lies in the same block or in one that differs by the edit: one group one less
   (adjacent length), or one group less and another more (equal length). Each word is at home in
   its block and visits the 21 others that can hold such a variant; each pair of blocks meets once.
3. In a block, one NumPy product of the members' letter counts (a Gram matrix) gives all
   squared distances; what is near enough is verified letter by letter. Only a word's number
   of near words and its best one leave the task, never the pairs.

A block of very many words is cut into parts of bounded size, and each pair of parts is a
task: its work is the square that a Gram matrix is, its memory is not. Small blocks share tasks.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairrank.llm.common import UPPER, LOWER, held, hold

#: Letters after lower-casing A-Z: a to z, and U+00C0 to U+00FF.
RUN = re.compile("[a-zÀ-ÿ]+")
_LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: A run whose crc32 this divides loses a letter.
SLIP = 97
#: Words and characters a task counts before it passes them on.
WORDS, CHARS = 200_000, 1 << 24
#: Members of a part of a block, and of the small blocks that share a task.
PART = 2048
#: Dimension of each latin-1 code in a count vector, its group, and the differences between
#: the blocks that can hold variants: none, one letter more, or one more and one less.
LETTERS, GROUPS = 90, 6
_LETTER = np.full(256, -1)
_LETTER[97:123], _LETTER[192:256] = np.arange(26), np.arange(26, LETTERS)
_GROUP = np.arange(LETTERS) % GROUPS
_UNIT = np.eye(GROUPS, dtype=np.int64)
STEPS = np.array([0 * _UNIT[0], *_UNIT, *(_UNIT[i] - _UNIT[j] for i, j in combinations(range(GROUPS), 2))])
#: Block numbers are linear in the counts, so a step to another block is an addition. Words of
#: over a thousand letters may share a number by accident; pairs are checked against their steps.
_WEIGHT = 1024 ** np.arange(GROUPS, dtype=np.int64)
#: Cells that are compared letter by letter at a time.
CELLS = 1 << 22


def slipped(run: str, prefix: int) -> str:
    """The run, or the run without one letter; ``prefix`` is the crc32 of the document id and a colon."""
    h = zlib.crc32(run.encode(), prefix)
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, doc_id: str, text: str, min_chars: int, min_count: int) -> DataFrame:
    """(word, n) of the words that occur often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        chars = 0

        def flush():
            made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return made

        for batch in batches:
            for number, value in zip(*(c.to_pylist() for c in batch.columns)):
                prefix = zlib.crc32(f"{'' if number is None else number}:".encode())
                lowered = (value or "").encode("utf-8", "surrogatepass").translate(_LOWERED).decode("utf-8", "surrogatepass")
                for found, n in Counter(RUN.findall(lowered)).items():
                    if len(found) >= min_chars:
                        word = slipped(found, prefix)
                        if len(word) >= min_chars:
                            if word not in counts:
                                chars += len(word)
                            counts[word] += n
                if len(counts) > WORDS or chars > CHARS:
                    yield flush()
                    chars = 0
        yield flush()

    parts = docs.select(doc_id, text).mapInArrow(run, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def letter_counts(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(latin-1 codes of all words in a row, lengths, matrix of letter counts)"""
    data = [w.encode("latin-1") for w in words]
    lengths = np.fromiter(map(len, data), np.int64, len(data))
    codes = np.frombuffer(b"".join(data), np.uint8)
    cell = np.repeat(np.arange(len(words)), lengths) * LETTERS + _LETTER[codes]
    return codes, lengths, np.bincount(cell, minlength=len(words) * LETTERS).reshape(len(words), LETTERS)


def group_counts(counts: np.ndarray) -> np.ndarray:
    return np.stack([counts[:, _GROUP == g].sum(axis=1) for g in range(GROUPS)], axis=1)


def visits(words: DataFrame) -> DataFrame:
    """(block, step, word, n): each word at home (step 0) and in each block it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                counts = group_counts(letter_counts(part.column(0).to_pylist())[2])
                blocks = (counts @ _WEIGHT)[:, None] - (STEPS @ _WEIGHT)[None, :]
                of = pa.array(np.repeat(np.arange(part.num_rows), len(STEPS)))
                step = pa.array(np.tile(np.arange(len(STEPS), dtype=np.int32), part.num_rows))
                yield pa.RecordBatch.from_arrays([pa.array(blocks.ravel()), step, part.column(0).take(of), part.column(1).take(of)], names=["block", "step", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "block bigint, step int, word string, n bigint")


def _padded(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    at = starts[:, None] + np.arange(width)
    inside = np.arange(width) < lengths[:, None]
    return np.where(inside, codes[np.where(inside, at, 0)], 0)


def one_edit(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a and b, of equal lengths or b shorter by one, are exactly one edit apart."""
    good = np.zeros(len(a), bool)
    order = np.argsort(lengths[a], kind="stable")
    at = 0
    while at < len(order):
        # Words of about equal length go together; the longest of them bounds the memory.
        some = order[at:at + max(1, CELLS // int(lengths[a[order[-1]]]))]
        x, y = a[some], b[some]
        width = int(lengths[x].max())
        left, right = _padded(codes, starts[x], lengths[x], width), _padded(codes, starts[y], lengths[y], width)
        equal = lengths[x] == lengths[y]
        replaced = equal & ((left != right).sum(axis=1) == 1)
        filled = np.arange(width - 1) < lengths[y][:, None]
        ahead = np.cumprod((left[:, :-1] == right[:, :-1]) & filled, axis=1).sum(axis=1)
        behind = np.cumprod(((left[:, 1:] == right[:, :-1]) | ~filled)[:, ::-1], axis=1).sum(axis=1) - (~filled).sum(axis=1)
        good[some] = replaced | (~equal & (ahead + behind >= lengths[y]))
        at += len(some)
    return good


def near_pairs(words: list[str], block: np.ndarray, step: np.ndarray, part: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the rows one edit apart; rows are sorted by block, and step 0 marks those at home.

    With ``part`` only pairs of different parts count: the others are another task's.
    """
    codes, lengths, counts = letter_counts(words)
    starts = np.cumsum(lengths) - lengths
    # Sums of squares must be exact: single precision holds those of words up to 2,000 letters.
    exact = np.float32 if lengths.max(initial=0) <= 2000 else np.float64
    vectors, groups = counts.astype(exact), group_counts(counts)
    squares = (vectors * vectors).sum(axis=1)
    bounds = np.flatnonzero(np.diff(block, prepend=block[:1] - 1, append=block[-1:] + 1))
    found = [], []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        home = lo + np.flatnonzero(step[lo:hi] == 0)
        if not len(home) or hi - lo < 2:
            continue
        gram = vectors[home] @ vectors[lo:hi].T
        distance = squares[home][:, None] + squares[lo:hi][None, :] - 2 * gram
        apart = lengths[lo:hi][None, :] - lengths[home][:, None]
        i, j = np.nonzero(((apart == 0) & (distance == 2)) | ((apart == 1) & (distance == 1)))
        i, j = home[i], lo + j
        once = (step[j] > 0) | (i < j)
        if part is not None:
            once &= part[i] != part[j]
        i, j = i[once], j[once]
        i, j = (c[(groups[j] - groups[i] == STEPS[step[j]]).all(axis=1)] for c in (i, j))
        good = one_edit(codes, starts, lengths, j, i)
        found[0].append(i[good])
        found[1].append(j[good])
    none = [np.empty(0, np.int64)]
    return np.concatenate(found[0] or none), np.concatenate(found[1] or none)


def _best(rows: pa.Table) -> pa.Table:
    """One task: for each word in it that has near words, their number and the best of them."""
    rows = rows.sort_by([("block", "ascending")]).combine_chunks()
    words, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
    across = rows.column("g2")[0].as_py() != rows.column("g3")[0].as_py()
    i, j = near_pairs(words, rows.column("block").to_numpy(), rows.column("step").to_numpy(), rows.column("part").to_numpy() if across else None)
    one, other = np.concatenate((i, j)), np.concatenate((j, i))
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=lambda k: (-n[k], words[k]))] = np.arange(len(words))
    order = np.lexsort((rank[other], one))
    one, other = one[order], other[order]
    first = np.flatnonzero(np.diff(one, prepend=-1))
    near = np.diff(np.append(first, len(one)))
    who, best = one[first].tolist(), other[first].tolist()
    return pa.table({
        "word": pa.array([words[k] for k in who], pa.string()), "near": pa.array(near, pa.int64()),
        "best_n": pa.array(n[best], pa.int64()), "best": pa.array([words[k] for k in best], pa.string()),
    })


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): the number of near words and the most frequent one, ties to the first in code-point order."""
    rows = hold(visits(words))
    sizes = rows.groupBy("block").agg(F.count("*").alias("rows"), F.sum((F.col("step") == 0).cast("int")).alias("homes"))
    sizes = hold(sizes.where("homes > 0 and rows > 1").select("block", F.ceil(F.col("rows") / PART).cast("int").alias("parts"), "rows"))
    small = sizes.where("parts = 1").agg(F.sum("rows")).first()[0] or 0
    bins = max(1, math.ceil(small / PART))
    placed = rows.join(sizes.select("block", "parts"), "block").withColumn("part", F.pmod(F.xxhash64("word", "step"), "parts").cast("int"))
    alone = F.col("parts") == 1
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "block", "step", "word", "n", "part",
        F.when(alone, F.pmod(F.xxhash64("block"), F.lit(bins))).otherwise(F.col("block")).alias("g1"),
        F.when(alone, F.lit(-1)).otherwise(F.least("part", "other")).alias("g2"),
        F.when(alone, F.lit(-1)).otherwise(F.greatest("part", "other")).alias("g3"),
    )
    found = dealt.groupBy("g1", "g2", "g3").applyInArrow(_best, "word string, near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("top")).select(
        "word", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.best").alias("best"),
    )


def variants(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 5, min_count: int = 3, ratio: float = 2,
) -> DataFrame:
    """(word, n, form, root, n_near, form_n): one row for each word of the vocabulary.

    ``form`` is the near word of largest ``n`` (ties: the smallest), if it occurs at least
    ``ratio`` times as often; ``root`` is where following forms ends, the word itself if it
    has none; ``n_near`` counts the words one edit away.

    Null and blank texts have no words; a null id counts as an empty one. Rows that repeat
    an id or a text count each. Texts and words of any length are read whole. Without words
    the result is empty. Columns other than the two named are ignored, whatever their names.
    """
    words = hold(word_counts(docs, doc_id, text, min_chars, min_count))
    near = words.join(hold(near_words(words)), "word", "left")
    follows = F.col("best_n") >= ratio * F.col("n")
    formed = hold(near.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(follows, F.col("best")).alias("form"), F.when(follows, F.col("best_n")).alias("form_n"),
    ))
    roots = followed(formed.where("form is not null").select("word", F.col("form").alias("root")))
    return formed.join(roots, "word", "left").select(
        "word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n",
    )


def followed(links: DataFrame) -> DataFrame:
    """(word, root) at the end of the links (word, root).

    Each round every word takes the place its place points to, so a chain of m links takes
    log2(m) rounds; counts grow along a chain, so m itself is a logarithm of the largest count.
    """
    links = held(links)
    while True:
        onward = links.df.select(F.col("word").alias("at"), F.col("root").alias("next"))
        stepped = held(links.df.join(onward, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links.release()
        links = stepped
        if stepped.df.where("moved").isEmpty():
            return stepped.df.select("word", "root")
