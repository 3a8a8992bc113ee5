"""Pairs of documents whose sets of word n-grams have a Jaccard similarity of at least 0.8.

MinHash banding: a document's signature is cut into bands, equal bands meet in a shuffle,
and pairs are verified on the full n-gram sets. The steps:

1. Documents with equal n-gram sets become one class of copies (combined before the
   shuffle); from here on each class is one representative.
2. Each (band, hash) with two or more representatives links its members to the least of
   them, and the components of those links are the candidate groups. No pair is written.
3. The texts of candidates are joined once, and their sets dealt to tasks: small groups
   share a task, large groups are cut into blocks, and each pair of blocks is a task of
   bounded size. Inside it the intersections of all its pairs are counted by matrix
   products over the shared n-grams, and one row for each document leaves it: how many
   links it has and the least document it reaches.
4. The components of those links are the result's classes.

The work for a group of m different near copies grows with m squared, because each pair in
it is a possible link and its links are counted exactly; rows and memory do not.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairrank.llm.common import components, held, hold, map_texts
from pairrank.llm.shingles import mix, shingle_set

#: Rows of a band, the chance that a pair at the threshold meets, and the seed of the hash functions.
TARGET_RECALL = 0.9999
SEED = 11
#: Members of a block, and n-grams of a block (8 bytes each).
BLOCK_DOCS, BLOCK_GRAMS = 128, 1 << 20
#: Columns of the incidence matrix that are multiplied at a time.
COLUMNS = 4096


def band_plan(threshold: float, recall: float = TARGET_RECALL, most: int = 160) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, that reach the recall.

    A pair at the threshold agrees in a band of r rows with probability t^r, so b bands miss
    it with probability (1 - t^r)^b. ``most`` bounds bands times rows.
    """
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows <= most:
            return bands, rows
    raise ValueError(f"no plan reaches recall {recall} at {threshold} within {most} hash functions")


class Signer:
    """Signatures of n-gram sets for a plan of bands and rows."""

    def __init__(self, bands: int, rows: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.scale = (rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.shift = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)[:, None]
        self.salt = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def band_hashes(self, grams: np.ndarray) -> np.ndarray:
        short = (mix(grams) >> np.uint64(32)).astype(np.uint32)
        least = np.full(self.bands * self.rows, 0xFFFFFFFF, np.uint32)
        for start in range(0, len(short), 1024):
            np.minimum(least, (short[start:start + 1024] * self.scale + self.shift).min(axis=1), out=least)
        key = self.salt.copy()
        for values in least.reshape(self.bands, self.rows).T:
            key = mix(key * np.uint64(31) + values)
        return key.view(np.int64)


def sketch(docs: DataFrame, doc_id: str, text: str, ngram: int, threshold: float, recall: float) -> DataFrame:
    """(id, n, d1, d2, bands) of each document with a word: set size, set digest, band hashes."""
    bands, rows = band_plan(threshold, recall)

    def make():
        signer = Signer(bands, rows)

        def work(texts):
            sizes, first, second, keys = [], [], [], []
            for value in texts:
                grams = shingle_set(value, ngram)
                sizes.append(len(grams))
                first.append(int(mix(grams).sum(dtype=np.uint64).view(np.int64)))
                second.append(int(mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)))
                keys.append(signer.band_hashes(grams) if len(grams) else None)
            return sizes, first, second, keys

        return work

    rows_in = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("_text"))
    return map_texts(rows_in, "_text", "n bigint, d1 bigint, d2 bigint, bands array<bigint>", make).drop("_text").where("n > 0")


def _links(label: np.ndarray, block: np.ndarray, ids: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], across: bool, threshold: float):
    """(links, root) for each row: copies of linked rows, and the least id reached in this task."""
    n = np.array([len(s) for s in sets])
    grams, column = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(column, minlength=len(grams)) > 1
    row = np.repeat(np.arange(len(sets)), n)[shared[column]]
    column = (np.cumsum(shared) - 1)[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(shared.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, (start, start + COLUMNS))
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[row[lo:hi], column[lo:hi] - start] = 1
        common += part @ part.T
    near = common >= threshold * (n[:, None] + n[None, :] - common) - 1e-6
    near &= label[:, None] == label[None, :]
    np.fill_diagonal(near, False)
    if across:
        counted = near & (block[:, None] != block[None, :])
    else:
        counted = near
    links = counted @ copies
    root = ids.copy()
    largest = np.iinfo(np.int64).max
    while True:
        step = np.minimum(root, np.where(counted, root[None, :], largest).min(axis=1, initial=largest))
        if (step == root).all():
            return links, root
        root = step


def verify(sets: DataFrame, threshold: float) -> DataFrame:
    """(id, links, root) of each row of each task; ``sets`` has the tasks in (g1, g2, g3)."""

    def task(table: pa.Table) -> pa.Table:
        table = table.sort_by("label").combine_chunks()
        label, block, ids, copies = (table.column(c).to_numpy() for c in ("label", "block", "id", "copies"))
        grams = table.column("grams").combine_chunks()
        grams = grams.chunk(0) if isinstance(grams, pa.ChunkedArray) else grams
        values, offsets = grams.values.to_numpy().view(np.uint64), grams.offsets.to_numpy()
        across = table.column("g2")[0].as_py() != table.column("g3")[0].as_py()
        bounds = np.flatnonzero(np.diff(label, prepend=label[0] - 1, append=label[-1] + 1))
        out = []
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if hi - lo > 1:
                members = [values[offsets[k]:offsets[k + 1]] for k in range(lo, hi)]
                out.append((ids[lo:hi], *_links(label[lo:hi], block[lo:hi], ids[lo:hi], copies[lo:hi], members, across, threshold)))
        if not out:
            out = [(np.empty(0, np.int64),) * 3]
        return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], names=["id", "links", "root"])

    return sets.groupBy("g1", "g2", "g3").applyInArrow(task, "id bigint, links bigint, root bigint")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ngram: int = 5, threshold: float = 0.8, recall: float = TARGET_RECALL,
) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies): one row for each row of ``docs``.

    ``class_id`` is the least id of the documents that links connect; ``n_links`` counts the
    other rows at the threshold, copies included; ``n_copies`` the rows with the same n-gram
    set, itself included. Words end at blanks, tabs and line ends. A text of fewer words
    than ``ngram`` is one n-gram. Null, empty and blank texts link to nothing and are a class
    each. Rows that repeat an id are one document of the class they share. A null id gets a
    null class and no links. Empty tables give empty results; other columns are ignored.
    """
    marks = hold(sketch(docs, doc_id, text, ngram, threshold, recall))
    classes = hold(marks.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    members = hold(
        marks.join(classes, ["d1", "d2"])
        .select("id", "rep", "n", "copies", F.when(F.col("id") == F.col("rep"), F.col("bands")).alias("bands"))
    )
    reps = members.where("id = rep").dropDuplicates(["id"])
    banded = members.where("id = rep").select("id", F.explode("bands").alias("band"))
    full = hold(banded.groupBy("band").agg(F.min("id").alias("a"), F.max("id").alias("last")).where("a < last").select("band", "a"))
    edges = banded.join(full, "band").where("id > a").select("a", F.col("id").alias("b")).distinct()
    groups = components(edges)

    listed = hold(groups.join(reps.select("id", "n", "copies"), F.col("node") == F.col("id")).select("id", "label", "n", "copies"))
    sizes = hold(listed.groupBy("label").agg(F.count("*").alias("docs"), F.sum("n").alias("grams")).select(
        "label", F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int").alias("blocks"), "docs", "grams",
    ))
    small = sizes.where("blocks = 1").agg(F.sum("docs").alias("docs"), F.sum("grams").alias("grams")).first()
    bins = max(1, math.ceil((small.docs or 0) / BLOCK_DOCS), math.ceil((small.grams or 0) / BLOCK_GRAMS))
    placed = hold(listed.join(sizes.select("label", "blocks"), "label").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")))

    def make():
        return lambda texts: ([shingle_set(t, ngram).view(np.int64) for t in texts],)

    texts = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("_text"))
    # Candidates grow with the documents, so this join moves the texts at every size.
    sets = map_texts(texts.join(placed.hint("merge"), "id"), "_text", "grams array<bigint>", make).drop("_text")
    alone = F.col("blocks") == 1
    dealt = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "id", "label", "copies", "grams", "block",
        F.when(alone, F.pmod(F.xxhash64("label"), F.lit(bins))).otherwise(F.col("label")).alias("g1"),
        F.when(alone, F.lit(-1)).otherwise(F.least("block", "other")).alias("g2"),
        F.when(alone, F.lit(-1)).otherwise(F.greatest("block", "other")).alias("g3"),
    )
    found = hold(verify(dealt, threshold))
    linked = hold(found.groupBy("id").agg(F.sum("links").alias("links")))
    joined = components(found.where("root < id").select(F.col("root").alias("a"), F.col("id").alias("b")).distinct())
    answers = hold(
        linked.join(joined, F.col("id") == F.col("node"), "left")
        .select(F.col("id").alias("of"), "links", F.coalesce("label", "id").alias("label"))
    )
    by_class = members.select("id", "rep", "copies").join(answers, F.col("rep") == F.col("of"), "left").select(
        F.col("id").alias(doc_id), F.coalesce("label", "rep").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.col("copies").cast("long").alias("n_copies"),
    )
    blank = docs.where(F.col(doc_id).isNull() | ~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")).select(
        F.col(doc_id), F.col(doc_id).alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"),
    )
    return by_class.unionByName(blank)


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose class holds a smaller id; rows with a null id stay.

    Rows that repeat the kept id all stay, as one document.
    """
    classes = near_duplicates(docs, doc_id, text, **options)
    later = hold(classes.where(F.col("class_id") < F.col(doc_id)).select(F.col(doc_id).alias("_later")).distinct())
    return docs.join(later.hint("merge"), F.col(doc_id) == F.col("_later"), "left_anti")
