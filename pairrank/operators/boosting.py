"""Gradient-boosted trees over pair vectors, grown from histograms of compact rows.

A training row is kept as one byte a dense feature and, of a fingerprint, one bit a position or two
bytes an on-bit, whichever is less, written once to the shared folder in blocks of rows; no row of
doubles is held in memory. A pass over the blocks grows one level of a tree: each task adds up counts
and residuals per (node, feature, bin), Spark sums these over the tasks, and the driver picks a split
for each node from sums whose number depends on the model alone. Of two children only the one of fewer
rows is summed; the other is what its parent has besides. The boosting is that of MLlib's ``GBTClassifier``: logistic loss, trees by variance,
cuts from quantiles of 10,000 rows (or the square of ``maxBins``), a share of rows for each tree
and of features for each node.

Draws hang on the row's ``key`` and residuals are summed as integers, so the trees do not depend
on how the rows lie in partitions.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairrank.session import shared_dir

#: Rows that set the cuts, unless ``maxBins`` asks for more.
CUT_ROWS = 10_000
#: Residuals lie in (-4, 4) and are summed in this unit: exact for two billion rows.
UNIT = 2.0 ** -20
#: Sums that reach the driver in one pass, and that it keeps of a level; more nodes take more passes.
CELLS = 1 << 21
#: Margins are written anew after so many trees, so a pass replays few.
REPLAYED = 8
#: Bytes of a block, which is one value of the table.
BLOCK = 8192
#: Rows summed at a time; with residuals below 2**22 units a count times COUNT and their sum share one double.
ROWS = 1 << 14
COUNT = 2.0 ** 37
#: The eight positions of every byte.
POSITIONS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(float)
# What the trees take unless told otherwise.
OPTIONS = {
    "maxDepth": 5, "stepSize": 0.1, "maxIter": 20, "subsamplingRate": 1.0, "featureSubsetStrategy": "all",
    "minInstancesPerNode": 1, "minWeightFractionPerNode": 0.0, "minInfoGain": 0.0, "maxBins": 32, "seed": 42,
}
# How MLlib should run, not what it should find.
NO_EFFECT = {"maxMemoryInMB", "cacheNodeIds", "checkpointInterval"}


@dataclass
class Trees:
    """Node arrays of a boosted ensemble, for scoring pairs inside a task."""

    n_features: int
    roots: np.ndarray
    weights: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def probability(self, rows: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(rows))
        every = np.arange(len(rows))
        for root, weight in zip(self.roots.tolist(), self.weights.tolist()):
            at = np.full(len(rows), root)
            for _ in range(self.depth):
                goes_left = rows[every, self.feature[at]] <= self.threshold[at]
                at = np.where(goes_left, self.left[at], self.right[at])
            margin += weight * self.value[at]
        return 1.0 / (1.0 + np.exp(-2.0 * margin))

    def score_pairs(self, queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Probability of every [query, candidate] pair, one query at a time."""
        width = queries.shape[1] + candidates.shape[1]
        if width != self.n_features:
            raise ValueError(f"model takes {self.n_features} features, the pair has {width}")
        used, trees = self._compact()
        ours = used < queries.shape[1]
        pair = np.empty((len(candidates), trees.n_features))
        pair[:, :len(used)][:, ~ours] = candidates[:, used[~ours] - queries.shape[1]]
        scores = np.empty((len(queries), len(candidates)))
        for q, query in enumerate(queries):
            pair[:, :len(used)][:, ours] = query[used[ours]]
            scores[q] = trees.probability(pair)
        return scores

    def _compact(self) -> tuple[np.ndarray, Trees]:
        """The features that the trees ask for, and the trees over these alone."""
        inner = self.left != np.arange(len(self.left))
        used, at = np.unique(self.feature[inner], return_inverse=True)
        feature = np.zeros_like(self.feature)
        feature[inner] = at
        return used, replace(self, feature=feature, n_features=max(len(used), 1))

    def pair_probability(self, fp: pa.Array, emb: pa.Array, n_bits: int | None) -> np.ndarray:
        """Probability of each row's pair; only the features that the trees ask for are laid out."""
        if not len(fp):
            return np.zeros(0)
        used, trees = self._compact()
        left = dense(emb, "emb")
        if n_bits:
            width, rows = n_bits + left.shape[1], np.zeros((len(fp), max(len(used), 1)))
            row, bit = on_bits(fp, n_bits)
            place = np.full(n_bits, -1)
            few = used < n_bits
            place[used[few]] = np.flatnonzero(few)
            asked = place[bit] >= 0
            rows[row[asked], place[bit[asked]]] = 1
            rows[:, :len(used)][:, ~few] = left[:, used[~few] - n_bits]
        else:
            both = np.concatenate([dense(fp, "fp"), left], axis=1)
            width, rows = both.shape[1], both[:, used] if len(used) else both[:, :1]
        if width != self.n_features:
            raise ValueError(f"model takes {self.n_features} features, the pair has {width}")
        return trees.probability(rows)


def dense(column: pa.Array, name: str, width: int | None = None) -> np.ndarray:
    """Vectors of one width as a matrix of doubles; nulls and other widths are an error."""
    if column.null_count:
        raise ValueError(f"rows without a vector in {name}")
    values = column.flatten()
    if values.null_count:
        raise ValueError(f"null elements in {name}")
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths != (width or lengths[0])).any():
        raise ValueError(f"vectors of unequal width in {name}")
    return values.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def on_bits(column: pa.Array, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and position of every on-bit; positions the fingerprint does not have are passed over."""
    if column.null_count:
        raise ValueError("rows without a vector in fp")
    row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    bit = column.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
    known = (bit >= 0) & (bit < n_bits)
    return row[known], bit[known]


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Midpoints between neighbouring values: all of them, or those nearest to equal shares of the rows."""
    points, counts = np.unique(values, return_counts=True)
    middle = (points[:-1] + points[1:]) / 2
    if len(middle) < bins:
        return middle
    upto = np.cumsum(counts)[:-1]
    wanted = np.arange(1, bins) * (len(values) / bins)
    after = np.minimum(np.searchsorted(upto, wanted), len(upto) - 1)
    before = np.maximum(after - 1, 0)
    return middle[np.unique(np.where(wanted - upto[before] < upto[after] - wanted, before, after))]


@dataclass
class _Layout:
    """Bytes of a row: fingerprint positions packed, unless on-bits are listed, then a bin for each dense feature."""

    n_bits: int
    cuts: list[np.ndarray]
    listed: bool = False
    head: int = field(init=False)
    stride: int = field(init=False)
    cells: int = field(init=False)

    def __post_init__(self) -> None:
        self.head = 0 if self.listed else -(-self.n_bits // 8)
        self.stride = max((len(c) for c in self.cuts), default=0) + 1
        self.cells = 1 + self.n_bits + len(self.cuts) * self.stride

    @property
    def width(self) -> int:
        return self.head + len(self.cuts)

    @property
    def bins(self) -> int:
        return max(2, self.stride)

    @property
    def position(self) -> np.dtype:
        return np.dtype("<u2" if self.n_bits <= 1 << 16 else "<u4")

    @property
    def n_features(self) -> int:
        return self.n_bits + len(self.cuts)

    def threshold(self, feature: int, cut: int) -> float:
        return 0.5 if feature < self.n_bits else float(self.cuts[feature - self.n_bits][cut])

    def pack(self, fp: pa.Array, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of the rows, how many on-bits are listed of each, and these."""
        packed = np.zeros((len(values), self.width), np.uint8)
        count, listed = np.zeros(len(values), np.int64), np.zeros(0, np.uint32)
        if self.listed:
            row, bit = on_bits(fp, self.n_bits)
            row, listed = np.divmod(np.unique(row.astype(np.int64) * self.n_bits + bit), self.n_bits)
            count = np.bincount(row, minlength=len(values))
        elif self.n_bits:
            on = np.zeros((len(values), self.n_bits), bool)
            on[on_bits(fp, self.n_bits)] = True
            packed[:, :self.head] = np.packbits(on, axis=1)
        for f, (cuts, column) in enumerate(zip(self.cuts, np.ascontiguousarray(values.T))):
            packed[:, self.head + f] = np.searchsorted(cuts, column, side="left")
        return packed, count, listed

    def columns(self, rows: _Rows, features: np.ndarray) -> np.ndarray:
        """[feature, row] bins of the features; 0 or 1 for positions."""
        packed = rows.records["packed"]
        found = np.zeros((len(features), len(packed)), np.uint8)
        if self.listed:
            place = np.full(self.n_bits, -1)
            few = features < self.n_bits
            place[features[few]] = np.flatnonzero(few)
            at = place[rows.bit]
            asked = at >= 0
            found[at[asked], rows.row_of_bit()[asked]] = 1
        for f, feature in enumerate(features.tolist()):
            if feature >= self.n_bits:
                found[f] = packed[:, self.head + feature - self.n_bits]
            elif not self.listed:
                found[f] = (packed[:, feature >> 3] >> (7 - (feature & 7))) & 1
        return found

    @staticmethod
    def _binned(columns: np.ndarray, slot: np.ndarray, weight: np.ndarray, nodes: int, bins: int) -> np.ndarray:
        """[node, column, bin] sums of the rows' weights."""
        found, base = np.empty((nodes, columns.shape[1], bins)), slot * bins
        for c, column in enumerate(np.ascontiguousarray(columns.T)):
            found[:, c] = np.bincount(base + column, weight, nodes * bins).reshape(nodes, bins)
        return found

    def add(self, sums: np.ndarray, rows: _Rows, slot: np.ndarray, residual: np.ndarray) -> None:
        """Adds counts and residuals of at most :data:`ROWS` rows to their nodes' cells: total, positions, bins.

        ``slot`` is the place of a row's node, or negative.
        """
        nodes, both = sums.shape[1], np.zeros(sums.shape[1:])
        taken = np.flatnonzero(slot >= 0)
        if not len(taken):
            return
        if self.listed:
            row = rows.row_of_bit()
            kept = slot[row] >= 0
            row = row[kept]
            cell = slot[row] * self.n_bits + rows.bit[kept]
            both[:, 1:1 + self.n_bits] = np.bincount(cell, COUNT + residual[row], nodes * self.n_bits).reshape(nodes, -1)
        packed, slot, weight = rows.records["packed"][taken], slot[taken], COUNT + residual[taken]
        both[:, 0] = np.bincount(slot, weight, nodes)
        if self.head:
            found = self._binned(packed[:, :self.head], slot, weight, nodes, 256) @ POSITIONS
            both[:, 1:1 + self.n_bits] = found.reshape(nodes, -1)[:, :self.n_bits]
        if self.cuts:
            both[:, 1 + self.n_bits:] = self._binned(packed[:, self.head:], slot, weight, nodes, self.stride).reshape(nodes, -1)
        count = np.rint(both / COUNT)
        sums[0] += count
        sums[1] += both - count * COUNT


@dataclass
class _Tree:
    """A tree that grows: nodes in the order they were made; a leaf leads to itself."""

    feature: list[int] = field(default_factory=lambda: [0])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    depth: int = 0

    def split(self, node: int, feature: int, cut: int, values: tuple[float, float]) -> list[int]:
        first = len(self.value)
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, first, first + 1
        for k, value in enumerate(values):
            self.feature.append(0)
            self.cut.append(0)
            self.left.append(first + k)
            self.right.append(first + k)
            self.value.append(value)
        return [first, first + 1]

    def asked(self) -> list[int]:
        return [f for node, f in enumerate(self.feature) if self.left[node] != node]

    def reached(self, features: np.ndarray, columns: np.ndarray, bins: int) -> np.ndarray:
        """Nodes that the rows end in; ``columns`` holds the bins of the sorted ``features``."""
        n, nodes = columns.shape[1], np.arange(len(self.value))
        cut, left, right = (np.array(x)[:, None] for x in (self.cut, self.left, self.right))
        follows = np.where(np.arange(bins) <= cut, left, right).ravel()
        inner = left.ravel() != nodes
        start = np.where(inner, np.searchsorted(features, self.feature), 0) * n
        at, rows, flat = np.zeros(n, np.int64), np.arange(n), columns.ravel()
        for _ in range(self.depth):
            at = follows.take(at * bins + flat.take(start.take(at) + rows))
        return at


def _record(width: int) -> np.dtype:
    return np.dtype([("row", "<u8"), ("margin", "<f8"), ("label", "i1"), ("bits", "<u4"), ("packed", "u1", (width,))])


@dataclass
class _Rows:
    """Records and the on-bits listed of them, one row's after the other's."""

    records: np.ndarray
    bit: np.ndarray

    def row_of_bit(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.records)), self.records["bits"])

    def filter(self, kept: np.ndarray) -> _Rows:
        if kept.all():
            return self
        return _Rows(self.records[kept], self.bit[np.repeat(kept, self.records["bits"])] if len(self.bit) else self.bit)


def _blocks(rows: _Rows, listed: np.dtype) -> pa.RecordBatch:
    """Records as values of some :data:`BLOCK` bytes, the on-bits listed of each value beside it."""
    records, size = rows.records, rows.records.itemsize
    step = max(1, BLOCK // size)
    ends = np.append(np.arange(0, len(records), step), len(records))
    upto = np.append(0, np.cumsum(records["bits"], dtype=np.int64))[ends] * listed.itemsize
    data = (records.tobytes(), rows.bit.astype(listed).tobytes())
    arrays = [
        pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(values)])
        for at, values in zip((ends * size, upto), data)
    ]
    return pa.RecordBatch.from_arrays(arrays, ["block", "bits"])


def _bytes(column: pa.Array) -> np.ndarray:
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]


def _records(batches: Iterator[pa.RecordBatch], layout: _Layout) -> Iterator[_Rows]:
    """The records of all blocks, at most :data:`ROWS` at a time."""
    for batch in batches:
        if not len(batch["block"]):
            continue
        records, bit = _bytes(batch["block"]).view(_record(layout.width)), _bytes(batch["bits"]).view(layout.position)
        upto = np.append(0, np.cumsum(records["bits"], dtype=np.int64))
        for start in range(0, len(records), ROWS):
            end = min(start + ROWS, len(records))
            yield _Rows(records[start:end], bit[upto[start]:upto[end]].astype(np.int64))


def _drawn(row: np.ndarray, draw: int, rate: float) -> np.ndarray:
    """Rows that take part in a tree, each with chance ``rate``: a mixed hash of the row and the draw."""
    if rate >= 1:
        return np.ones(len(row), bool)
    z = row + np.uint64((draw * 0x9E3779B97F4A7C15) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0 ** -53 < rate


def _features_asked(strategy, n: int) -> int:
    """How many of ``n`` features a node may split on."""
    named = {"auto": n, "all": n, "onethird": math.ceil(n / 3), "sqrt": math.ceil(math.sqrt(n)), "log2": math.ceil(math.log2(n)) if n > 1 else 1}
    text = str(strategy).lower()
    if text in named:
        return max(1, named[text])
    if text.isdigit() and int(text) > 0:
        return min(n, int(text))
    share = float(text)
    if not 0 < share <= 1:
        raise ValueError(f"unknown featureSubsetStrategy {strategy!r}")
    return max(1, math.ceil(share * n))


class Boosting:
    """Fits :class:`Trees` to rows ``label`` (0 or 1), ``fp``, ``emb`` and, if there, ``key``.

    Rows that share a key are drawn together; rows without one, by their place in the table.
    """

    def __init__(self, params: dict, n_bits: int | None) -> None:
        unknown = set(params) - set(OPTIONS) - NO_EFFECT
        if unknown:
            raise ValueError(f"unknown parameters of the trees: {sorted(unknown)}")
        self.options = {**OPTIONS, **{k: v for k, v in params.items() if k in OPTIONS}}
        if not 2 <= self.options["maxBins"] <= 256:
            raise ValueError("maxBins must be 2 to 256")
        self.n_bits = n_bits or 0

    def _values(self, fp: pa.Array, emb: pa.Array) -> np.ndarray:
        right = dense(emb, "emb")
        return right if self.n_bits else np.concatenate([dense(fp, "fp"), right], axis=1)

    def _layout(self, df: DataFrame) -> _Layout:
        """Cuts from the rows of least hash; a filter on the hash spares the joins below ``df`` the other rows."""
        size = max(CUT_ROWS, self.options["maxBins"] ** 2)
        order = F.xxhash64(F.lit(self.options["seed"]), "key") if "key" in df.columns else F.rand(self.options["seed"])
        for share in (2.0 ** -12, 2.0 ** -6, 1.0) if "key" in df.columns else (1.0,):
            part = df if share == 1 else df.filter(order < F.lit(int(share * 2.0 ** 64) - 2 ** 63))
            found = part.orderBy(order).limit(size).select("fp", "emb").toArrow()
            if len(found) >= size:
                break
        if not len(found):
            raise ValueError("no rows to train on")
        values = self._values(*(found[c].combine_chunks() for c in ("fp", "emb")))
        if not np.isfinite(values).all():
            raise ValueError("vectors must be finite")
        listed = False
        if self.n_bits:
            row, bit = on_bits(found["fp"].combine_chunks(), self.n_bits)
            listed = 2 * len(np.unique(row.astype(np.int64) * self.n_bits + bit)) < len(found) * self.n_bits / 8
        return _Layout(self.n_bits, [_cuts(v, self.options["maxBins"]) for v in values.T], listed)

    def _rows(self, df: DataFrame, layout: _Layout) -> DataFrame:
        place = F.monotonically_increasing_id()
        row = F.when(F.col("key").isNotNull(), F.xxhash64("key")).otherwise(place) if "key" in df.columns else place
        values_of = self._values

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                label = batch["label"].to_numpy(zero_copy_only=False)
                if not np.isin(label, (0, 1)).all():
                    raise ValueError("labels must be 0 or 1")
                values = values_of(batch["fp"], batch["emb"])
                if values.shape[1] != len(layout.cuts):
                    raise ValueError("vectors of unequal width")
                if not np.isfinite(values).all():
                    raise ValueError("vectors must be finite")
                records = np.zeros(len(batch), _record(layout.width))
                records["row"] = batch["row"].to_numpy().view(np.uint64)
                records["label"] = label
                records["packed"], records["bits"], bit = layout.pack(batch["fp"], values)
                yield _blocks(_Rows(records, bit), layout.position)

        given = df.select(row.alias("row"), F.col("label").cast("double").alias("label"), "fp", "emb")
        return given.mapInArrow(pack, "block binary, bits binary")

    def fit(self, df: DataFrame) -> Trees:
        spark, o = df.sparkSession, self.options
        folder = f"{shared_dir(spark)}/boosting/{uuid.uuid4().hex}"

        def held(rows: DataFrame, turn: int) -> DataFrame:
            # Two folders by turns: what is read is never what is written.
            path = f"{folder}/{turn % 2}"
            rows.write.mode("overwrite").parquet(path)
            return spark.read.schema(rows.schema).parquet(path)

        layout = self._layout(df)
        rows = held(self._rows(df, layout), 0)
        # A task of fewer rows takes longer to start than to run.
        n = rows.agg(F.sum(F.length("block"))).first()[0] // _record(layout.width).itemsize
        tasks = min(rows.rdd.getNumPartitions(), -(-n // ROWS))
        rows = rows.coalesce(tasks)
        trees: list[_Tree] = []
        weights: list[float] = []
        settled = 0
        for m in range(o["maxIter"]):
            if m - settled == REPLAYED:
                rows = held(_with_margin(rows, layout, trees[settled:], weights[settled:]), m // REPLAYED).coalesce(tasks)
                settled = m
            trees.append(self._grow(rows, tasks, layout, trees[settled:], weights[settled:], m))
            weights.append(1.0 if m == 0 else o["stepSize"])
        return _joined(layout, trees, weights, o["maxDepth"])

    def _grow(self, rows: DataFrame, tasks: int, layout: _Layout, before: list[_Tree], weights: list[float], m: int) -> _Tree:
        o = self.options
        tree = _Tree()
        # The nodes to sum, and of each its sibling and the sums of both together, if kept.
        pending: list[tuple[int, int | None, np.ndarray | None]] = [(0, None, None)]
        asked = _features_asked(o["featureSubsetStrategy"], layout.n_features)
        at_once = max(1, CELLS // layout.cells)
        total = 0.0
        for level in range(o["maxDepth"] + (o["maxDepth"] == 0)):
            made = []
            grown = replace(tree, **{k: list(getattr(tree, k)) for k in ("feature", "cut", "left", "right", "value")})
            keeps = len(pending) * layout.cells <= CELLS
            for start in range(0, len(pending), at_once):
                part = pending[start:start + at_once]
                sums = self._sums(rows, tasks, layout, before, weights, grown, [p[0] for p in part], m).transpose(1, 0, 2)
                summed = [
                    pair for (node, sibling, both), own in zip(part, sums)
                    for pair in sorted([(node, own)] + ([(sibling, both - own)] if sibling else []), key=itemgetter(0))
                ]
                for node, (n, s) in summed:
                    if level == 0:
                        total, tree.value[0] = n[0], s[0] / n[0] if n[0] else 0.0
                    if level == o["maxDepth"]:
                        continue
                    rng = np.random.default_rng([o["seed"] % 2**32, m, node])
                    allowed = np.sort(rng.permutation(layout.n_features)[:asked])
                    least = max(o["minInstancesPerNode"], o["minWeightFractionPerNode"] * total)
                    best = _best_split(layout, n, s, allowed, least, o["minInfoGain"])
                    if best:
                        *how, fewer_left = best
                        left, right = tree.split(node, *how)
                        few, many = (left, right) if fewer_left else (right, left)
                        made += [(few, many, np.stack([n, s]))] if keeps else [(left, None, None), (right, None, None)]
            if not made:
                break
            pending, tree.depth = made, level + 1
        return tree

    def _sums(self, rows, tasks, layout, before, weights, tree, nodes, m) -> np.ndarray:
        """[count or residual, node, cell] over the rows drawn for tree ``m``; the driver adds up what few tasks find."""
        slots = np.full(len(tree.value), -1)
        slots[nodes] = np.arange(len(nodes))
        draw, rate = self.options["seed"] + m, self.options["subsamplingRate"]
        shape = (2, len(nodes), layout.cells)
        few = tasks * len(nodes) * layout.cells <= CELLS

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(shape)
            features = _asked([tree])
            for drawn in _records(batches, layout):
                drawn = drawn.filter(_drawn(drawn.records["row"], draw, rate))
                slot = slots[tree.reached(features, layout.columns(drawn, features), layout.bins)]
                if len(tree.value) > 1:
                    # Rows of settled leaves and of the larger children need no margin.
                    wanted = slot >= 0
                    drawn, slot = drawn.filter(wanted), slot[wanted]
                sign = 2.0 * drawn.records["label"] - 1
                residual = 4 * sign / (1 + np.exp(2 * sign * _margin(drawn, layout, before, weights))) if m else sign
                layout.add(sums, drawn, slot, np.rint(residual / UNIT))
            if few:
                yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()])], ["sums"])
                return
            count, residual = sums.reshape(2, -1)
            cell = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell), pa.array(count[cell].astype(np.int64)), pa.array(residual[cell].astype(np.int64))],
                ["cell", "n", "s"],
            )

        if few:
            parts = rows.mapInArrow(add, "sums binary").toArrow()["sums"].to_pylist()
            sums = sum((np.frombuffer(part).reshape(shape) for part in parts), np.zeros(shape))
        else:
            parts = rows.mapInArrow(add, "cell long, n long, s long")
            found = parts.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toArrow()
            sums, cell = np.zeros(shape), found["cell"].to_numpy()
            for of, name in zip(sums.reshape(2, -1), ("n", "s")):
                of[cell] = found[name].to_numpy()
        sums[1] *= UNIT
        return sums


def _asked(trees: list[_Tree]) -> np.ndarray:
    return np.unique(np.array([f for tree in trees for f in tree.asked()], np.int64))


def _margin(rows: _Rows, layout: _Layout, trees: list[_Tree], weights: list[float]) -> np.ndarray:
    margin, features = rows.records["margin"].copy(), _asked(trees)
    columns = layout.columns(rows, features)
    for tree, weight in zip(trees, weights):
        margin += weight * np.array(tree.value)[tree.reached(features, columns, layout.bins)]
    return margin


def _with_margin(rows: DataFrame, layout: _Layout, trees: list[_Tree], weights: list[float]) -> DataFrame:
    """The rows with what the trees add to their margins."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in _records(batches, layout):
            settled = given.records.copy()
            settled["margin"] = _margin(given, layout, trees, weights)
            yield _blocks(_Rows(settled, given.bit), layout.position)

    return rows.mapInArrow(add, rows.schema)


def _best_split(
    layout: _Layout, n: np.ndarray, s: np.ndarray, allowed: np.ndarray, least: float, min_gain: float,
) -> tuple[int, int, tuple[float, float], bool] | None:
    """(feature, cut, means left and right, whether fewer rows go left) of the largest drop in variance; ties to the first feature and cut."""
    on, bins = slice(1, 1 + layout.n_bits), slice(1 + layout.n_bits, None)
    steps = max(layout.stride - 1, 0)

    def left_of(x: np.ndarray) -> np.ndarray:
        upto = np.cumsum(x[bins].reshape(len(layout.cuts), layout.stride), axis=1)[:, :steps]
        return np.concatenate([x[0] - x[on], upto.ravel()])

    feature = np.concatenate([np.arange(layout.n_bits), layout.n_bits + np.repeat(np.arange(len(layout.cuts)), steps)])
    cut = np.concatenate([np.zeros(layout.n_bits, int), np.tile(np.arange(steps), len(layout.cuts))])
    n_left, s_left = left_of(n), left_of(s)
    n_right, s_right = n[0] - n_left, s[0] - s_left
    fits = np.isin(feature, allowed) & (n_left >= max(least, 1)) & (n_right >= max(least, 1))
    if not fits.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fits, (s_left**2 / n_left + s_right**2 / n_right - s[0] ** 2 / n[0]) / n[0], -np.inf)
    best = int(gain.argmax())
    if gain[best] <= 0 or gain[best] < min_gain:
        return None
    means = (s_left[best] / n_left[best], s_right[best] / n_right[best])
    return int(feature[best]), int(cut[best]), means, bool(n_left[best] < n_right[best])


def _joined(layout: _Layout, trees: list[_Tree], weights: list[float], depth: int) -> Trees:
    """All trees in one set of node arrays, cuts as thresholds."""
    starts = np.cumsum([0] + [len(t.value) for t in trees])[:-1]
    leaf = [[a == i for i, a in enumerate(t.left)] for t in trees]
    return Trees(
        n_features=layout.n_features,
        roots=starts,
        weights=np.array(weights),
        feature=np.concatenate([t.feature for t in trees]),
        threshold=np.concatenate([
            [np.inf if end else layout.threshold(f, c) for end, f, c in zip(ends, t.feature, t.cut)]
            for ends, t in zip(leaf, trees)
        ]),
        left=np.concatenate([np.array(t.left) + start for t, start in zip(trees, starts)]),
        right=np.concatenate([np.array(t.right) + start for t, start in zip(trees, starts)]),
        value=np.concatenate([t.value for t in trees]),
        depth=max(1, depth),
    )
