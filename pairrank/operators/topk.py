"""Exact top-k: per group over rows, and per query over candidate vectors.

Ranking asks for the best of all candidates of every query, but no pair ever becomes a row
and no plan sorts or groups candidates: queries are broadcast, as many as a checked size
holds, to the tasks that scan the candidates. A task multiplies blocks of candidates with
blocks of queries and keeps k results per query; only those are shuffled. A scan thus serves
many blocks of queries, and candidates in few files are dealt to all cores once.

A block is multiplied in single precision first. Only pairs that may reach their query's
k-th score so far, rounding errors included, are scored in double, so work besides the
product is for few pairs.

Blocks of candidates need not be scored where they cannot matter. A task gathers like
candidates (by their nearest of a few pivots, then by their angle to it) and bounds a
query's best score in a block: by Cauchy-Schwarz with the block's norms, and by the
triangle inequality of angles with the pivot. A query whose bound does not reach its k-th
score so far, carried from block to block, skips the block. Results are the same.

Binary fingerprints are not multiplied: their queries are an inverted index, see
:mod:`pairrank.operators.postings`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from pairrank.operators.postings import QueryIndex, bit_matrix, bit_order, pack
from pairrank.session import cut_lineage, spread

# Fixed value: largest top_k of a query.
MAX_K = 500
SCORE_DIGITS = 6
ROUND_GUARD = 1e-6
MAX_BROADCAST_BYTES = 64 << 20
QUERY_BLOCK = 8192
#: Candidates that share a bound, pivots of a batch, and queries below which bounds cost more than they save.
CANDIDATE_BLOCK, PIVOTS, BOUNDED_QUERIES = 512, 16, 200
PIECE_CELLS = 4_000_000
#: Pairs below which blocks of candidates that no bound rules out are multiplied together.
FUSED_CELLS = 1 << 19
#: Results that a task holds for the queries of one scan, if a block of queries needs no more.
RESULT_ROWS = 1 << 20
#: Queries above which candidates are spread over the cores, and rows of a query that are then ranked by one task.
SPREAD_QUERIES, RANKED_ROWS = 1000, 100_000
#: Candidates indexed together, and found rows that wait for a merge, at least.
PACKED_ROWS, WAITING_ROWS = 2048, 4096
#: Input splits that one task may scan.
SPLITS = 64
METRICS = ("dot", "cosine", "binary_cosine")


def top_k_rows(
    df: DataFrame, by: list[str], order: list[Column], k: int, spread: Column, rank: str = "rank",
    salts: int = 64,
) -> DataFrame:
    """First ``k`` rows of each group with their rank, exact for a hot group too.

    A group is first cut by ``spread`` into salts that are ranked apart, so no task sorts
    more than its share; the second stage sees at most ``salts * k`` rows per group.
    ``order`` must be total within a group.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    first = Window.partitionBy(*by, "_salt").orderBy(*order)
    kept = salted.withColumn(rank, F.row_number().over(first)).filter(F.col(rank) <= k)
    last = Window.partitionBy(*by).orderBy(*order)
    return (
        kept.drop("_salt").withColumn(rank, F.row_number().over(last)).filter(F.col(rank) <= k)
    )


# ---------------------------------------------------------------- scoring inside a task


def _dense(column: pa.Array, size: int | None) -> np.ndarray:
    """Equal-length list column to a matrix; ragged, null or non-finite input is an error."""
    lengths = pc.list_value_length(column)
    if column.null_count or lengths.null_count:
        raise ValueError("null vector")
    widths = set(pc.unique(lengths).to_pylist())
    if len(widths) > 1 or (size is not None and widths and widths != {size}):
        raise ValueError(f"vectors differ in length: {sorted(widths)} against {size}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not np.isfinite(flat).all():
        raise ValueError("vector holds null, NaN or an infinite value")
    return flat.reshape(len(column), -1)


def _scatter(column: pa.Array, n_bits: int) -> np.ndarray:
    """On-bit lists to a 0/1 matrix; counts up to 2**24 stay exact in float32."""
    if column.null_count:
        raise ValueError("null fingerprint")
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    matrix = np.zeros((len(column), n_bits), dtype=np.float32)
    matrix[np.repeat(np.arange(len(column)), lengths), column.flatten().to_numpy()] = 1
    return matrix


def _norms(matrix: np.ndarray) -> np.ndarray:
    length = np.sqrt(np.einsum("ij,ij->i", matrix, matrix, dtype=np.float64))
    return np.where(length == 0, 1.0, length)


def _round(scores: np.ndarray) -> np.ndarray:
    """Six digits, half away from zero.

    Scores are first moved outward by a millionth of the last digit, so that the order in
    which a product was summed (batch shape, block size) cannot decide how a half rounds.
    """
    unit = 10.0**SCORE_DIGITS
    return np.sign(scores) * np.floor(np.abs(scores) * unit + 0.5 + ROUND_GUARD) / unit + 0.0


@dataclass
class Scorer:
    """Scores a candidate block against a query block.

    A zero query or candidate has a zero product, so taking its norm as 1 gives score 0.
    ``pair_model`` scores [query, candidate] vectors instead of a metric.
    """

    metric: str = "cosine"
    n_bits: int | None = None
    pair_model: object | None = None

    def __post_init__(self) -> None:
        if self.pair_model is None and self.metric not in METRICS:
            raise ValueError(f"unknown metric '{self.metric}', choose from {METRICS}")
        if self.pair_model is None and self.metric == "binary_cosine" and not self.n_bits:
            raise ValueError("binary_cosine needs n_bits")

    @property
    def by_postings(self) -> bool:
        return self.pair_model is None and self.metric == "binary_cosine"

    def queries(self, column: pa.Array) -> np.ndarray:
        return _scatter(column, self.n_bits) if self.n_bits else _dense(column, None)

    def candidates(self, column: pa.Array, queries: np.ndarray) -> np.ndarray:
        return _dense(column, queries.shape[1] if self.pair_model is None and len(queries) else None)

    def score(self, queries: np.ndarray, norms: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """One row per query, one column per candidate; ``norms`` are the queries' own."""
        if self.pair_model is not None:
            return self.pair_model.score_pairs(queries, candidates)
        product = (queries @ candidates.T).astype(np.float64)
        if self.metric == "dot":
            return product
        product /= norms[:, None] * _norms(candidates)[None, :]
        return product

    def few(self, queries: np.ndarray, norms: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Scores of single pairs, a query and a candidate in each row; ``norms`` are the queries' own."""
        product = np.einsum("ij,ij->i", queries, candidates, dtype=np.float64)
        return product if self.metric == "dot" else product / (norms * _norms(candidates))

    def best_possible(self, toward: np.ndarray, norms: np.ndarray, groups: list[_Group]) -> np.ndarray:
        """Upper bounds of each query's scores in blocks of candidates, rounding included.

        ``toward`` holds the queries' angles to the blocks' pivots, a column for each block.
        """
        near, far, shortest, longest = (np.array([getattr(g, name) for g in groups]) for name in ("near", "far", "shortest", "longest"))
        apart = np.maximum(0.0, np.maximum(near - toward, toward - far))
        bound = np.cos(np.minimum(apart, np.pi))
        norms = norms[:, None]
        if self.metric == "dot":
            bound = bound * norms * np.where(bound > 0, longest, shortest)
        bound = np.where(np.array([g.zero for g in groups]), np.maximum(bound, 0.0), bound)
        reach = norms * longest if self.metric == "dot" else 1.0
        return bound + 1e-6 + 1e-7 * reach


@dataclass
class _Group:
    """Like candidates: their rows, their pivot, and the bounds of their angles to it and of their norms."""

    rows: np.ndarray
    pivot: int
    near: float
    far: float
    shortest: float
    longest: float
    zero: bool


def _units(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of norm one or zero, norms)"""
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix, dtype=np.float64))
    return matrix / np.where(norms == 0, 1.0, norms)[:, None], norms


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))


def _groups(candidates: np.ndarray, size: int) -> tuple[np.ndarray, list[_Group]]:
    """The pivots of a batch, and its rows in groups of up to ``size`` around them."""
    units, norms = _units(candidates)
    pivots = units[np.unique(np.linspace(0, len(units) - 1, PIVOTS).astype(int))]
    angles = _angles(units, pivots)
    nearest = angles.argmin(axis=1)
    angle = angles[np.arange(len(units)), nearest]
    order = np.lexsort((angle, nearest))
    groups = []
    for pivot in range(len(pivots)):
        around = order[np.searchsorted(nearest[order], pivot):np.searchsorted(nearest[order], pivot, "right")]
        for start in range(0, len(around), size):
            rows = around[start:start + size]
            own = norms[rows]
            groups.append(_Group(np.sort(rows), pivot, angle[rows].min(), angle[rows].max(), own.min(), own.max(), bool((own == 0).any())))
    return pivots, groups


def _pick(scores: np.ndarray, ks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) indexes of the k best per query row; ties go to the earlier candidate."""
    n = scores.shape[1]
    if n <= ks.min(initial=n):
        return tuple(np.indices(scores.shape).reshape(2, -1))
    kept = np.ones(scores.shape, dtype=bool)
    for k in np.unique(ks[ks < n]).tolist():
        rows = np.flatnonzero(ks == k)
        part = scores[rows]
        cut = np.partition(part, n - k, axis=1)[:, n - k, None]
        above, level = part > cut, part == cut
        room = k - above.sum(axis=1, keepdims=True)
        kept[rows] = above | (level & (np.cumsum(level, axis=1, dtype=np.int32) <= room))
    return np.nonzero(kept)


@dataclass
class _Block:
    """Query side as it reaches a task."""

    ids: pa.Array
    ks: np.ndarray
    matrix: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, scorer: Scorer) -> _Block:
        table = table.combine_chunks()
        return cls(
            _array(table["query_id"]),
            table["top_k"].to_numpy().astype(np.int64),
            scorer.queries(_array(table["vector"])),
        )


def _array(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


_KEYS = [("_q", "ascending"), ("score", "descending"), ("source", "ascending"), ("external_id", "ascending")]


def _best(tables: list[pa.Table], ks: np.ndarray) -> pa.Table:
    """k best rows per query of the tables together."""
    merged = pa.concat_tables(tables).sort_by(_KEYS).combine_chunks()
    q = merged["_q"].to_numpy()
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return merged.filter(pa.array(place < ks[q]))


def _thresholds(best: pa.Table, ks: np.ndarray) -> np.ndarray:
    """The k-th score of each query that has k results; ``best`` is sorted by query and rank."""
    q, scores = best["_q"].to_numpy(), best["score"].to_numpy()
    ends = np.searchsorted(q, np.arange(len(ks)), "right")
    full = ends - np.searchsorted(q, np.arange(len(ks))) >= ks
    return np.where(full, scores[np.maximum(ends - 1, 0)], -np.inf) if len(scores) else np.full(len(ks), -np.inf)


class _Running:
    """The k best of a block of queries so far.

    Finds of a slab are gathered until they are worth new thresholds, and rows until they are worth a merge.
    """

    def __init__(self, ks: np.ndarray) -> None:
        self.ks, self.best, self.waiting, self.n_waiting = ks, None, [], 0
        self.reached = np.full(len(ks), -np.inf)
        self._top = np.full((len(ks), int(ks.max(initial=1))), -np.inf)
        self._gathered, self._n_gathered, self._short = [], 0, True

    def gather(self, slab: pa.Table, rows: np.ndarray, asked: np.ndarray, scores: np.ndarray) -> None:
        self._gathered.append((rows, asked, scores))
        self._n_gathered += len(rows)
        if self._short or self._n_gathered >= 2 * len(self.ks):
            self.flush(slab)

    def flush(self, slab: pa.Table) -> None:
        """Counts what was gathered; to be called before the next slab."""
        if self._gathered:
            self.add(slab, *map(np.concatenate, zip(*self._gathered)))
            self._gathered, self._n_gathered, self._short = [], 0, bool((self.reached == -np.inf).any())

    def add(self, slab: pa.Table, rows: np.ndarray, asked: np.ndarray, scores: np.ndarray) -> None:
        kept = _first(asked, scores, rows, self.ks)
        rows, asked, scores = rows[kept], asked[kept], scores[kept]
        touched, first, which = np.unique(asked, return_index=True, return_inverse=True)
        new = np.full((len(touched), self._top.shape[1]), -np.inf)
        new[which, np.arange(len(asked)) - first[which]] = scores
        both = np.concatenate([self._top[touched], new], axis=1)
        self._top[touched] = -np.sort(-both, axis=1)[:, :new.shape[1]]
        self.reached[touched] = self._top[touched, self.ks[touched] - 1]
        found = slab.select(["source", "external_id"]).take(pa.array(rows))
        found = found.append_column("_q", pa.array(asked, pa.int64())).append_column("score", pa.array(scores))
        self.waiting.append(found)
        self.n_waiting += len(found)
        if self.n_waiting >= max(WAITING_ROWS, 0 if self.best is None else len(self.best) // 2):
            self.merged()

    def merged(self) -> pa.Table | None:
        if self.waiting:
            self.best = _best([*self.waiting, self.best] if self.best is not None else self.waiting, self.ks)
            self.waiting, self.n_waiting = [], 0
        return self.best


def _rank_batches(
    batches: Iterator[pa.RecordBatch], block: _Block, scorer: Scorer, size: int, together: int
) -> tuple[list[tuple[int, pa.Table]], int, int]:
    """Running top-k of a stream of candidate batches, the pairs met and the pairs scored.

    Queries meet a slab of candidates in blocks of ``together``; the results are those of each block, behind its first query.
    """
    step = max(256, PIECE_CELLS // max(block.matrix.shape[1], 1))
    parts = [_Part(block, slice(k, k + together), scorer) for k in range(0, len(block.ids), together)]
    for batch in batches:
        ordered = pa.Table.from_batches([batch]).sort_by(
            [("source", "ascending"), ("external_id", "ascending")]
        )
        for start in range(0, len(ordered), step):
            slab = ordered.slice(start, step).combine_chunks()
            candidates = scorer.candidates(_array(slab["vector"]), block.matrix)
            side, grouped = _Side(candidates, scorer), {}
            for part in parts:
                piece = max(256, PIECE_CELLS // max(len(part.ks), 1))
                if part.bounded and len(slab) > size:
                    key = min(size, piece)
                    pivots, groups = grouped[key] = grouped.get(key) or _groups(candidates, key)
                    toward = _angles(part.units, pivots)[:, [g.pivot for g in groups]]
                    bounds = scorer.best_possible(toward, part.lengths, groups)
                    bounds[part.lengths == 0] = np.inf
                    part.rank(slab, side, [g.rows for g in groups], bounds)
                else:
                    part.rank(slab, side, [np.arange(k, min(k + piece, len(slab))) for k in range(0, len(slab), piece)], None)
    found = [(part.start, best) for part in parts if (best := part.running.merged()) is not None]
    return found, sum(part.met for part in parts), sum(part.done for part in parts)


class _Side:
    """Candidates as they are and, for a metric, in single precision: unit vectors for a cosine."""

    def __init__(self, candidates: np.ndarray, scorer: Scorer) -> None:
        self.exact, self.coarse, self.longest = candidates, None, 1.0
        if scorer.pair_model is None:
            self.coarse = (candidates if scorer.metric == "dot" else candidates / _norms(candidates)[:, None]).astype(np.float32)
            if scorer.metric == "dot":
                self.longest = float(_norms(candidates).max(initial=0))


class _Part:
    """A block of a scan's queries, and what it has found."""

    def __init__(self, block: _Block, rows: slice, scorer: Scorer) -> None:
        self.start, self.ks, self.matrix, self.scorer = rows.start, block.ks[rows], block.matrix[rows], scorer
        self.norms, self.running = _norms(self.matrix), _Running(self.ks)
        self.bounded = scorer.pair_model is None and len(self.ks) >= BOUNDED_QUERIES
        self.units, self.lengths = _units(self.matrix) if self.bounded else (None, None)
        self.side, self.met, self.done = _Side(self.matrix, scorer), 0, 0

    def rank(self, slab: pa.Table, side: _Side, pieces: list[np.ndarray], bounds: np.ndarray | None) -> None:
        running, every = self.running, np.arange(len(self.ks))
        # What single precision and the rounding of scores may take, for products of these norms.
        width = self.matrix.shape[1]
        slack = 1e-6 + (width + 8) * 2.0**-23 * (self.norms * side.longest if self.scorer.metric == "dot" else np.ones(len(every)))
        for k, rows in self._fused(pieces, bounds):
            active = every if bounds is None or k is None else np.flatnonzero(bounds[:, k] >= running.reached)
            self.met, self.done = self.met + len(every) * len(rows), self.done + len(active) * len(rows)
            if not len(active):
                continue
            whole = len(active) == len(every)
            if side.coarse is not None and (running.reached[active] > -np.inf).all():
                least = (running.reached - slack).astype(np.float32)
                near = (self.side.coarse if whole else self.side.coarse[active]) @ side.coarse[rows].T
                # Products past single precision are no reason to drop a pair.
                hit = np.flatnonzero(~(near < (least if whole else least[active])[:, None]))
                if not len(hit):
                    continue
                if 8 * len(hit) < near.size:
                    asked, places = active[hit // len(rows)], rows[hit % len(rows)]
                    scores = _round(self.scorer.few(self.matrix[asked], self.norms[asked], side.exact[places]))
                    self.kept(slab, places, asked, scores)
                    continue
            mine = (self.matrix, self.norms, self.ks) if whole else (self.matrix[active], self.norms[active], self.ks[active])
            scores = _round(self.scorer.score(mine[0], mine[1], side.exact[rows]))
            asked, places = _pick(scores, mine[2])
            self.kept(slab, rows[places], active[asked], scores[asked, places])
        running.flush(slab)

    def _fused(self, pieces: list[np.ndarray], bounds: np.ndarray | None) -> Iterator[tuple[int | None, np.ndarray]]:
        """The pieces with their numbers; small ones that every query has to meet come together, without a number."""
        at = 0
        while at < len(pieces):
            most = max(1, FUSED_CELLS // max(1, len(self.ks) * len(pieces[at])))
            if bounds is not None and most > 1 and (self.running.reached > -np.inf).all():
                every = (bounds[:, at:at + most] >= self.running.reached[:, None]).all(axis=0)
                n = len(every) if every.all() else int(every.argmin())
                if n > 1:
                    yield None, np.concatenate(pieces[at:at + n])
                    at += n
                    continue
            yield at, pieces[at]
            at += 1

    def kept(self, slab: pa.Table, rows: np.ndarray, asked: np.ndarray, scores: np.ndarray) -> None:
        good = np.flatnonzero(scores >= self.running.reached[asked])
        if len(good):
            self.running.gather(slab, rows[good], asked[good], scores[good])


def _first(queries: np.ndarray, scores: np.ndarray, rows: np.ndarray, ks: np.ndarray) -> np.ndarray:
    """Places of the k best of each query; ties go to the earlier row."""
    order = np.lexsort((rows, -scores, queries))
    asked = queries[order]
    return order[np.arange(len(asked)) - np.searchsorted(asked, asked) < ks[asked]]


def _found(slab: pa.Table, rows: np.ndarray, queries: np.ndarray, scores: np.ndarray, seen: int) -> pa.Table:
    """Result rows; ``_c`` numbers the candidates of a task."""
    found = slab.select(["source", "external_id"]).take(pa.array(rows))
    found = found.append_column("_q", pa.array(queries, pa.int64())).append_column("score", pa.array(scores, pa.float64()))
    return found.append_column("_c", pa.array(rows + seen, pa.int64()))


def _rank_sets(
    batches: Iterator[pa.RecordBatch], ks: np.ndarray, words: np.ndarray, place: np.ndarray
) -> tuple[pa.Table | None, int, int]:
    """Running top-k of bit sets by binary cosine, the pairs met and the pairs verified."""
    index, lead = QueryIndex(words), int(ks.max(initial=0))
    lengths, reached = np.sqrt(index.sizes), np.full(len(ks), -np.inf)
    best, first, waiting, seen, met, done = None, None, [], 0, 0, 0
    for batch in batches:
        ordered = pa.Table.from_batches([batch]).sort_by([("source", "ascending"), ("external_id", "ascending")])
        for start in range(0, len(ordered), PACKED_ROWS):
            slab = ordered.slice(start, PACKED_ROWS).combine_chunks()
            held = bit_matrix(_array(slab["vector"]), place)
            sizes = np.sqrt(held.sum(axis=1))
            for asked, rows, overlaps, pairs in index.matches(held):
                met, done = met + pairs, done + len(asked)
                scores = _round(overlaps / np.maximum(lengths[asked] * sizes[rows], 1.0))
                good = np.flatnonzero((overlaps > 0) & (scores >= reached[asked]))
                good = good[_first(asked[good], scores[good], rows[good], ks)]
                if not len(good):
                    continue
                waiting.append(_found(slab, rows[good], asked[good], scores[good], seen))
                if best is None or sum(map(len, waiting)) >= max(WAITING_ROWS, len(best) // 2):
                    best, waiting = _best([*waiting, best] if best is not None else waiting, ks), []
                    reached = _thresholds(best, ks)
                    index.raise_floor(reached)
            # Of the candidates that share no bit with a query, only the first by key can be in its result.
            places = np.arange(min(lead, len(slab)))
            none = _found(slab, places, np.zeros(len(places), np.int64), np.zeros(len(places)), seen)
            first = none if first is None else pa.concat_tables([first, none])
            first = first.sort_by(_KEYS).slice(0, lead)
            seen += len(slab)
    if first is None:
        return None, met, done
    tables = ([best] if best is not None else []) + waiting
    best = _best(tables, ks) if tables else first.slice(0, 0)
    asked = best["_q"].to_numpy()
    short = np.flatnonzero(np.bincount(asked, minlength=len(ks)) < ks)
    queries, rows = np.repeat(short, len(first)), np.tile(np.arange(len(first)), len(short))
    taken = np.isin(queries * seen + first["_c"].to_numpy()[rows], asked * seen + best["_c"].to_numpy())
    queries, rows = queries[~taken], rows[~taken]
    rest = first.take(pa.array(rows, pa.int64()))
    rest = rest.set_column(rest.schema.get_field_index("_q"), "_q", pa.array(queries, pa.int64()))
    return _best([best, rest], ks), met, done


def _emit(best: pa.Table, block: _Block, start: int = 0) -> pa.Table:
    """Result rows of the queries from ``start`` on."""
    q = pc.add(best["_q"], start)
    return pa.table(
        {
            "query_id": block.ids.take(q.combine_chunks()),
            "top_k": pa.array(block.ks[q.to_numpy()].astype(np.int32)),
            "source": best["source"],
            "external_id": best["external_id"],
            "score": best["score"],
        }
    )


# ------------------------------------------------------------------------- Spark plans


def nearest(
    queries: DataFrame,
    candidates: DataFrame,
    scorer: Scorer,
    top_k: int = 10,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
    report: SearchReport | None = None,
) -> DataFrame:
    """Best candidates of each query: query_id, top_k, rank, source, external_id, score.

    ``queries`` holds query_id and vector, and may hold its own top_k per query (1..500);
    ``candidates`` holds source, external_id and vector. Scores are rounded to six digits
    before ranking; ties go by source, then external_id. A null query_id, or one that two
    queries share, is an error. ``query_block`` and ``max_broadcast_bytes`` bound what is
    broadcast at a time, ``candidate_block`` the candidates that share a bound; ``report``
    counts the pairs that were scored.
    """
    if not 1 <= top_k <= MAX_K:
        raise ValueError(f"top_k must lie in 1..{MAX_K}, got {top_k}")
    own_k = "top_k" in queries.columns
    asked = F.col("top_k").cast("int") if own_k else F.lit(top_k)
    limit = MAX_K if own_k else top_k
    queries = queries.select("query_id", "vector", asked.alias("top_k"))
    candidates = candidates.select(
        F.col("source").cast("string").alias("source"),
        F.col("external_id").cast("string").alias("external_id"),
        "vector",
    )
    id_type = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {id_type}, top_k int, source string, external_id string, score double"

    width = scorer.n_bits or queries.agg(F.max(F.size("vector"))).first()[0] or 1
    block = max(1, min(query_block, max_broadcast_bytes // (8 * width)))
    # A block of bit sets is an index of its own; other blocks share a scan.
    scan = block if scorer.by_postings else max(1, min(max_broadcast_bytes // (8 * width), max(block, RESULT_ROWS // limit)))
    few = queries.limit(scan + 1).toArrow()
    fewer = len(few) <= scan
    if fewer:
        unclear = few["query_id"].null_count or pc.count_distinct(few["query_id"]).as_py() < len(few)
    else:
        unclear = not queries.groupBy("query_id").count().where("query_id is null or count > 1").isEmpty()
    if unclear:
        raise ValueError("query_id must be set and unique")
    if len(few) > SPREAD_QUERIES:
        candidates = spread(candidates)
    how = {"schema": schema, "size": candidate_block, "together": block, "report": report}
    if fewer:
        scored, tasks, _ = _against_broadcast(few, candidates, scorer, **how)
        ranked = _ranked(scored, limit, len(few) > SPREAD_QUERIES and tasks * limit <= RANKED_ROWS)
    else:
        del few
        ranked = _scan_by_scan(queries, candidates, scorer, scan, limit, how)
    return ranked.filter(F.col("rank") <= F.col("top_k")).select(
        "query_id", "top_k", "rank", "source", "external_id", "score"
    )


def _ranked(scored: DataFrame, limit: int, whole: bool) -> DataFrame:
    """``scored`` with the rank, in parts or, if ``whole``, at once: a query's rows are ``limit`` from each task at most."""
    order = [F.col("score").desc(), F.col("source"), F.col("external_id")]
    if whole:
        ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
        return ranked.filter(F.col("rank") <= limit)
    return top_k_rows(scored, ["query_id"], order, limit, F.concat_ws(":", "source", "external_id"))


class SearchReport:
    """Pairs of a query and a candidate that a search met, and those it scored; filled when its result is computed."""

    def __init__(self) -> None:
        self._seen: list[Observation] = []

    def watch(self, scored: DataFrame) -> DataFrame:
        self._seen.append(Observation())
        return scored.observe(self._seen[-1], F.sum("met").alias("met"), F.sum("done").alias("done"))

    @property
    def pruned_share(self) -> float:
        met, done = (sum(o.get[c] or 0 for o in self._seen) for c in ("met", "done"))
        return 1 - done / met if met else 0.0


def _against_broadcast(
    few: pa.Table, candidates: DataFrame, scorer: Scorer, schema: str, size: int, together: int, report: SearchReport | None,
) -> tuple[DataFrame, int, Broadcast | None]:
    """k results of each task for each query of a scan, the number of tasks, and the broadcast queries."""
    spark = candidates.sparkSession
    if len(few) == 0:
        return spark.createDataFrame([], schema), 1, None
    place = None
    if scorer.by_postings:
        few = few.combine_chunks()
        column = _array(few["vector"])
        place = bit_order(column, scorer.n_bits)
        block = _Block(_array(few["query_id"]), few["top_k"].to_numpy().astype(np.int64), pack(bit_matrix(column, place)))
    else:
        block = _Block.of(few, scorer)
    shared = spark.sparkContext.broadcast((block.ids, block.ks, block.matrix, place))
    del block, place

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *sides, place = shared.value
        asked = _Block(*sides)
        if place is None:
            found, met, done = _rank_batches(batches, asked, scorer, size, together)
        else:
            best, met, done = _rank_sets(batches, asked.ks, asked.matrix, place)
            found = [(0, best)] if best is not None else []
        for n, (start, best) in enumerate(found):
            # The task's pairs are counted on its first row.
            first = (np.arange(len(best)) == 0) & (n == 0)
            rows = _emit(best, asked, start).append_column("met", pa.array(first * met, pa.int64()))
            yield from rows.append_column("done", pa.array(first * done, pa.int64())).to_batches()

    # Every task sends k rows per query, so fewer, longer tasks shuffle less; each still
    # scans a bounded number of splits, however few cores there are.
    splits = candidates.rdd.getNumPartitions()
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-splits // SPLITS))
    rows = (candidates.coalesce(tasks) if splits > tasks else candidates).mapInArrow(rank, f"{schema}, met long, done long")
    return (report.watch(rows) if report else rows).drop("met", "done"), min(splits, tasks), shared


def _scan_by_scan(queries: DataFrame, candidates: DataFrame, scorer: Scorer, size: int, limit: int, how: dict) -> DataFrame:
    """One scan of the candidates for each ``size`` queries; its results are written before the next begins."""
    # Ids are unique, so hash blocks come out even; a quarter more leaves room for chance.
    n = -(-queries.count() * 5 // (4 * size))
    placed = cut_lineage(queries.withColumn("_qb", F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int")).repartitionByRange("_qb"))
    candidates = cut_lineage(candidates)
    found = []
    for k in range(n):
        few = placed.where(F.col("_qb") == k).drop("_qb").toArrow()
        scored, tasks, shared = _against_broadcast(few, candidates, scorer, **how)
        if shared is not None:
            found.append(cut_lineage(_ranked(scored, limit, tasks * limit <= RANKED_ROWS)))
            shared.destroy()
    return reduce(DataFrame.unionByName, found)


def concat_with_query(query: DataFrame, candidates: DataFrame, output: str = "pair") -> DataFrame:
    """[query, candidate] for one query: a projection over the candidate scan.

    ``query`` must have one row and one vector column; Spark's scalar subquery checks the
    row count at run time, so nothing of unknown size is broadcast.
    """
    pair = F.concat(
        query.scalar().cast("array<double>"), F.col("vector").cast("array<double>")
    )
    return candidates.withColumn(output, pair)
