"""Exact search among bit sets by an inverted index, inside a task.

A block of queries becomes postings: for each bit, rarest first, the queries that hold it.
A query whose k-th score so far is t needs an overlap of at least t^2 times its size with
any candidate, so it is posted under its rarest bits only: a candidate that misses all of
these cannot reach it (prefix bound; Bayardo et al. 2007). The overlap met in the prefix
plus what the rest could add, and the sizes of both sets, must reach the pair's own need
(Xiao et al. 2008). What is left is verified on packed words. Pairs without a common bit
are never looked at; queries with too few matches get theirs, of score 0, at the end.

Where a piece's sets are so dense that reading their postings costs more than a product of
the two bit matrices, the product counts the overlaps. Both ways return the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_BITS = 64
#: Cells (query by candidate) counted at a time, candidates of a first piece, pairs verified at a time, and postings that cost as much as one pair in a product.
PIECE_CELLS, FIRST_ROWS, VERIFIED_PAIRS, POSTINGS_PER_PAIR = 1_000_000, 256, 65_536, 8
#: Rounding may lift a score by half of its last digit.
SLACK = 1e-6


def bit_order(column: pa.Array, n_bits: int) -> np.ndarray:
    """The place of each bit when the column's bits are ordered by how many sets hold them, rarest first."""
    held = np.bincount(_flat(column, n_bits), minlength=n_bits)
    place = np.empty(n_bits, np.int64)
    place[np.argsort(held, kind="stable")] = np.arange(n_bits)
    return place


def _flat(column: pa.Array, n_bits: int) -> np.ndarray:
    bits = column.flatten()
    if column.null_count or bits.null_count:
        raise ValueError("null fingerprint")
    flat = bits.to_numpy(zero_copy_only=False)
    if len(flat) and not 0 <= flat.min() <= flat.max() < n_bits:
        raise ValueError(f"a bit lies outside 0..{n_bits - 1}")
    return flat.astype(np.int64)


def bit_matrix(column: pa.Array, place: np.ndarray) -> np.ndarray:
    """On-bit lists to rows of truth values, bits in their places; repeated bits count once."""
    flat = _flat(column, len(place))
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    on = np.zeros((len(column), -(-len(place) // WORD_BITS) * WORD_BITS), dtype=bool)
    on[np.repeat(np.arange(len(column)), lengths), place[flat]] = True
    return on


def pack(on: np.ndarray) -> np.ndarray:
    return np.packbits(on, axis=1).view(np.uint64)


class QueryIndex:
    """Packed queries and their postings, cut to the prefixes that the k-th scores allow."""

    def __init__(self, words: np.ndarray):
        self.words, self._numbers = words, None
        on = np.unpackbits(words.view(np.uint8), axis=1)
        self.sizes = on.sum(axis=1, dtype=np.int64)
        rows, places = (x.astype(np.int32) for x in np.nonzero(on))
        first = np.cumsum(self.sizes) - self.sizes
        at = np.arange(len(rows)) - first[rows]
        order = np.argsort(places, kind="stable")
        self._query, self._place, self._at = rows[order], places[order], at[order].astype(np.int32)
        self.raise_floor(np.full(len(words), -np.inf))

    def raise_floor(self, reached: np.ndarray) -> None:
        """Posts each query under the bits that a candidate must share to reach its k-th score."""
        self.floor = np.maximum(0.0, reached - SLACK)
        self.need = np.maximum(1, np.ceil(self.floor**2 * self.sizes - 1e-9)).astype(np.int64)
        kept = self._at < (self.sizes - self.need + 1)[self._query]
        self.posted = self._query[kept]
        self.lengths = np.bincount(self._place[kept], minlength=self.words.shape[1] * WORD_BITS)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def matches(self, on: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """For pieces of a block of candidates: queries, candidates and overlaps of all pairs that may reach the floor, and pairs met.

        Takes a floor raised between pieces into account.
        """
        n, words, start = len(self.words), pack(on), 0
        while n and start < len(on):
            # Without scores to reach nothing is ruled out, so the first pieces are small.
            step = max(1, min(PIECE_CELLS // n, len(on) if self.floor.any() else FIRST_ROWS))
            part = on[start:start + step]
            asked, found, overlaps = self._piece(part, words[start:start + step])
            yield asked, found + start, overlaps, n * len(part)
            start += step

    def _piece(self, on: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = on.sum(axis=1, dtype=np.int64)
        if int(on.sum(axis=0) @ self.lengths) > POSTINGS_PER_PAIR * len(self.words) * len(on):
            return self._multiplied(on, sizes)
        n = len(self.words)
        rows, places = np.nonzero(on)
        lengths = self.lengths[places]
        begin = np.repeat(self.starts[places] - np.cumsum(lengths) + lengths, lengths)
        cells = np.repeat(rows, lengths) * n + self.posted[begin + np.arange(len(begin))]
        counts = np.bincount(cells, minlength=n * len(on)).reshape(len(on), n)
        # What the piece's smallest set would have to share (empty ones share nothing); most pairs end here.
        smallest = min(sizes[sizes > 0], default=1)
        least = np.ceil(self._wanted(self.floor, self.sizes, smallest)) - self.need + 1
        found, asked = np.nonzero(counts >= np.maximum(1, least).astype(np.int64))
        counts = counts[found, asked]
        most = np.minimum(counts + self.need[asked] - 1, np.minimum(self.sizes[asked], sizes[found]))
        kept = most >= self._wanted(self.floor[asked], self.sizes[asked], sizes[found])
        asked, found, overlaps = asked[kept], found[kept], counts[kept]
        # Where every bit of a query is posted, the count is the overlap.
        open_ = np.flatnonzero(self.need[asked] > 1)
        for at in range(0, len(open_), VERIFIED_PAIRS):
            some = open_[at:at + VERIFIED_PAIRS]
            overlaps[some] = np.bitwise_count(self.words[asked[some]] & words[found[some]]).sum(axis=1)
        return asked, found, overlaps

    def _multiplied(self, on: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The piece's pairs by a product; sums of ones are exact in float32 up to 2**24."""
        if self._numbers is None:
            self._numbers = np.unpackbits(self.words.view(np.uint8), axis=1).astype(np.float32)
        common = on.astype(np.float32) @ self._numbers.T
        kept = (common > 0) & (common >= self._wanted(self.floor, self.sizes, sizes[:, None]))
        found, asked = np.nonzero(kept)
        return asked, found, common[found, asked].astype(np.int64)

    @staticmethod
    def _wanted(floor: np.ndarray, some: np.ndarray, others: np.ndarray) -> np.ndarray:
        """The overlap at which two sets reach the floor, less what rounding of the product may take."""
        return floor * np.sqrt(some * others) - 1e-9
