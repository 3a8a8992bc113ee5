"""Unigram encoding and decoding with the pieces and scores of a SentencePiece model file.

A double-array trie over the pieces' UTF-8 bytes is built once on the driver and broadcast
(its size is a few bytes for each trie node, so it is bounded by the vocabulary). A task
finds the best path of each distinct word by Viterbi search. No piece holds a whitespace
marker after another character or a line end, so no piece crosses from one word to the next
and the best path of a text is the best paths of its words in a row; models for which that
does not hold are encoded text by text. Words that a task has seen are looked up.

A unigram model's scores are log probabilities and are used as they are. A merge model's
scores are minus the ranks of its merges, which do not add up to anything; no model is
trained here, so its pieces get the log probabilities of Zipf's law at their rank.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairrank.llm.common import map_texts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: What an unknown character costs below the worst piece; a fixed value of the format.
UNKNOWN_PENALTY = 10.0
#: Slots looked through at a time when the trie is packed.
WINDOW = 256
#: Bytes of words and ids a task remembers before it starts anew, with what Python adds for each;
#: words of more bytes are not remembered.
MEMORY, OVERHEAD, LONGEST = 48 << 20, 200, 40
#: Words searched side by side, and characters of a text cut into words at a time.
SIDE_BY_SIDE, STRETCH = 8192, 1 << 20


def double_array(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value) over distinct keys: node s goes on byte c to t = base[s] + c where
    check[t] = s; value[t] is the key's index or -1. Node 0 is the root."""
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for index, key in enumerate(keys):
        node = 0
        for byte in key:
            step = children[node].get(byte)
            if step is None:
                step = children[node][byte] = len(children)
                children.append({})
                ends.append(-1)
            node = step
        ends[node] = index
    size = 4 * len(children) + 4 * WINDOW
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    used = np.zeros(size, bool)
    used[0] = True
    place, queue = {0: 0}, [0]
    # Lone children fill the first gap; families look from where the last one fitted.
    gap, family = 257, 1
    while queue:
        node = queue.pop()
        if not children[node]:
            continue
        codes = np.fromiter(children[node], np.int64)
        low = int(codes.min())
        if len(codes) == 1:
            while used[gap]:
                gap += 1
            start = gap - low
        else:
            while True:
                starts = family + np.flatnonzero(~used[family + low:family + low + WINDOW])
                fits = starts[~used[starts[:, None] + codes].any(axis=1)]
                if len(fits):
                    start = family = int(fits[0])
                    break
                family += WINDOW
        here = place[node]
        base[here] = start
        for code, child in children[node].items():
            at = start + code
            used[at], check[at], value[at], place[child] = True, here, ends[child], at
        queue.extend(children[node].values())
    last = int(np.flatnonzero(used).max()) + 257
    return base[:last], check[:last], value[:last]


def log_scores(scores: list[float]) -> list[float]:
    """Log probabilities: the scores themselves, or Zipf's law (one over the rank, summing to one) if they are merge ranks, so whole numbers."""
    if any(s != round(s) for s in scores):
        return scores
    place = np.unique(-np.array(scores), return_inverse=True)[1] + 1.0
    return (-np.log(place) - np.log((1 / place).sum())).tolist()


class Pieces:
    """The tables of a model, ready to be broadcast."""

    def __init__(self, model: bytes):
        import sentencepiece

        reader = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(reader.get_piece_size())
        normal = [i for i in ids if not (reader.is_unknown(i) or reader.is_control(i) or reader.is_byte(i) or reader.is_unused(i))]
        words = [reader.id_to_piece(i) for i in normal]
        self.ids = normal
        self.scores = log_scores([reader.get_score(i) for i in normal])
        self.unknown_score = min(self.scores) - UNKNOWN_PENALTY
        self.words = [w.encode() for w in words]
        self.base, self.check, self.value = double_array(self.words)
        self.by_word = not any(MARK in w.lstrip(MARK) or "\n" in w for w in words)
        self.unknown = reader.unk_id()
        self.bytes = {int(reader.id_to_piece(i)[3:5], 16): i for i in ids if reader.is_byte(i)}
        self.text = [b""] * len(ids)
        for i in ids:
            if reader.is_byte(i):
                self.text[i] = bytes([int(reader.id_to_piece(i)[3:5], 16)])
            elif reader.is_unknown(i):
                self.text[i] = " ⁇ ".encode()
            elif not reader.is_control(i):
                self.text[i] = reader.id_to_piece(i).replace(MARK, " ").encode()


@lru_cache(maxsize=4)
def _pieces(path: str, size: int, modified: float) -> Pieces:
    with open(path, "rb") as file:
        return Pieces(file.read())


def load(spark: SparkSession, path: str) -> Broadcast:
    """Reads the model on the driver, from a local path or through Spark, and broadcasts its tables."""
    if os.path.exists(path):
        found = os.stat(path)
        return spark.sparkContext.broadcast(_pieces(path, found.st_size, found.st_mtime))
    return spark.sparkContext.broadcast(Pieces(bytes(spark.read.format("binaryFile").load(path).first().content)))


class Encoder:
    """Encodes texts; remembers the bytes of the int32 ids of each short word, markers included."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.lists = [a.tolist() for a in (pieces.base, pieces.check, pieces.value)]
        self.id_of, self.score_of = np.array(pieces.ids, np.int32), np.array(pieces.scores)
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.line_end = np.array(self.best_path("\n"), np.int32).tobytes()

    def best_path(self, text: str) -> list[int]:
        """Viterbi over character positions; of equal paths the one found first, from the left, wins."""
        p, (base, check, value) = self.pieces, self.lists
        scores, ids, data = p.scores, p.ids, text.encode("utf-8", "surrogatepass")
        n = len(data)
        best: list[float | None] = [None] * (n + 1)
        back = [0] * (n + 1)
        piece = [-1] * (n + 1)
        best[0] = 0.0
        start = 0
        while start < n:
            lead = data[start]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            sofar, node, single = best[start], 0, False
            for end in range(start, n):
                step = base[node] + data[end]
                if check[step] != node:
                    break
                node = step
                found = value[node]
                if found >= 0:
                    score, to = sofar + scores[found], end + 1
                    if best[to] is None or score > best[to]:
                        best[to], back[to], piece[to] = score, start, found
                    single = single or to == start + width
            if not single:
                score, to = sofar + p.unknown_score, start + width
                if best[to] is None or score > best[to]:
                    best[to], back[to], piece[to] = score, start, -1
            start += width
        path: list[int] = []
        at = n
        while at > 0:
            if piece[at] >= 0:
                path.append(ids[piece[at]])
            elif p.bytes:
                path.extend(p.bytes[b] for b in reversed(data[back[at]:at]))
            else:
                path.append(p.unknown)
            at = back[at]
        path.reverse()
        return path

    def side_by_side(self, words: list[str], data: list[bytes]) -> None:
        """The same search for many short words at once, position by position; fills ``known``."""
        base, check, value = self.pieces.base, self.pieces.check, self.pieces.value
        n, sizes = len(words), np.array([len(d) for d in data], np.int32)
        width = int(sizes.max())
        codes = np.zeros((n, width), np.int32)
        codes[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(data), np.uint8)
        codes = np.ascontiguousarray(codes.T)
        best = np.full((width + 5, n), -np.inf)
        back, piece = np.zeros((width + 5, n), np.int32), np.full((width + 5, n), -1, np.int32)
        best[0] = 0.0
        for start in range(width):
            here = np.flatnonzero((sizes > start) & (best[start] > -np.inf))
            lead = codes[start].take(here)
            to = start + np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            sofar = best[start]
            single, rows, node, at = np.zeros(len(here), bool), here, 0, np.arange(len(here))
            for end in range(start, width):
                step = (base.take(node) if end > start else base[0]) + codes[end].take(rows)
                on = np.flatnonzero(check.take(step) == node)
                if not len(on):
                    break
                rows, node, at = rows.take(on), step.take(on), at.take(on)
                into = value.take(node)
                hit = np.flatnonzero(into >= 0)
                if not len(hit):
                    continue
                found, into = rows.take(hit), into.take(hit)
                reached = at.take(hit)
                single[reached[to.take(reached) == end + 1]] = True
                score = sofar.take(found) + self.score_of.take(into)
                better = np.flatnonzero(score > best[end + 1].take(found))
                found = found.take(better)
                best[end + 1][found], back[end + 1][found], piece[end + 1][found] = score.take(better), start, into.take(better)
            rows, to = here[~single], to[~single]
            score = sofar[rows] + self.pieces.unknown_score
            better = score > best[to, rows]
            rows, to = rows[better], to[better]
            best[to, rows], back[to, rows], piece[to, rows] = score[better], start, -1
        path, unknown = np.full((n, width), -1, np.int32), np.zeros(n, bool)
        rows, at, slot = np.flatnonzero(sizes), sizes.copy(), width - 1
        while len(rows):
            chosen = piece[at[rows], rows]
            unknown[rows[chosen < 0]] = True
            path[rows, slot] = chosen
            at[rows] = back[at[rows], rows]
            rows, slot = rows[at[rows] > 0], slot - 1
        filled = path >= 0
        flat, ends = self.id_of[path[filled]].tobytes(), 4 * np.cumsum(filled.sum(axis=1))
        for word, raw, odd, lo, hi in zip(words, data, unknown.tolist(), [0, *ends.tolist()], ends.tolist()):
            self.known[word] = np.array(self.best_path(raw.decode("utf-8", "surrogatepass")), np.int32).tobytes() if odd else flat[lo:hi]

    def learn(self, words: list[str]) -> None:
        """Adds words to ``known``. A word stands for itself after a marker, or after a line end if it begins with one."""
        data = [w[1:].encode("utf-8", "surrogatepass") if w[:1] == "\n" else (MARK + w).encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        order = np.argsort(sizes, kind="stable")
        short = int((sizes <= LONGEST).sum())
        for start in range(0, short, SIDE_BY_SIDE):
            some = order[start:min(start + SIDE_BY_SIDE, short)].tolist()
            self.side_by_side([words[k] for k in some], [data[k] for k in some])
        for k in order[short:].tolist():
            self.known[words[k]] = np.array(self.best_path(data[k].decode("utf-8", "surrogatepass")), np.int32).tobytes()
        for word in words:
            if word[:1] == "\n":
                self.known[word] = self.line_end + self.known[word]

    def lookup(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of the words of each text in a row."""
        distinct = set().union(*texts)
        if self.held > MEMORY:
            self.known, self.held = {}, 0
        new = list(distinct.difference(self.known))
        if new:
            self.learn(new)
        out = [b"".join(map(self.known.__getitem__, words)) for words in texts]
        for word in new:
            if len(word) > LONGEST:
                del self.known[word]
            else:
                self.held += len(word) + len(self.known[word]) + OVERHEAD
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.pieces.by_word:
            return [np.array(self.best_path(MARK + t.replace(" ", MARK)), np.int32).tobytes() if t else b"" for t in texts]
        out, waiting, size = [], [], 0
        for text in texts:
            if len(text) > STRETCH:
                out += self.lookup(waiting)
                out.append(b"".join(self.lookup([words])[0] for words in _stretches(text)))
                waiting, size = [], 0
                continue
            waiting.append(_words(text))
            size += len(text)
            if size > STRETCH:
                out += self.lookup(waiting)
                waiting, size = [], 0
        return out + self.lookup(waiting)


#: A word with the markers or the line end before it.
SEGMENT = re.compile(f"\n[^{MARK}\n]*|{MARK}+[^{MARK}\n]*")


def _words(text: str) -> list[str]:
    """Cuts a text where no piece can cross; each word without the one marker that stands before it."""
    if not text:
        return []
    if "  " not in text and text[0] != " " and MARK not in text:
        return text.replace("\n", " \n").split(" ")
    return [s[1:] if s[0] == MARK else s for s in SEGMENT.findall(MARK + text.replace(" ", MARK))]


def _stretches(text: str):
    """The words of a very long text, about ``STRETCH`` characters at a time."""
    text = MARK + text.replace(" ", MARK)
    start = 0
    while start < len(text):
        end = text.find(MARK, start + STRETCH)
        while end > 0 and text[end - 1] == MARK:
            end = text.find(MARK, end + 1)
        end = len(text) if end < 0 else end
        yield [s[1:] if s[0] == MARK else s for s in SEGMENT.findall(text, start, end)]
        start = end


def decode_ids(pieces: Pieces, ids: list[int]) -> str:
    """Text of the ids: byte pieces as UTF-8 (invalid bytes as U+FFFD), markers as blanks, the first blank dropped."""
    table = pieces.text
    return b"".join([table[i] for i in ids]).decode("utf-8", "replace").removeprefix(" ")


def _lists(made: list[bytes]) -> tuple[pa.ListArray, np.ndarray]:
    """The ids of a slice as one Arrow column, and their numbers."""
    sizes = np.array([len(m) // 4 for m in made], np.int32)
    offsets = np.concatenate(([0], np.cumsum(sizes, dtype=np.int32))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(made), np.int32))), sizes


def encode(docs: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """``docs`` with ``ids`` (array<int>) and ``n_ids``; columns of these names are replaced.

    Null and empty texts have no ids. A literal U+2581 is encoded as a blank, as the format
    defines; every other text decodes to itself.
    """
    shared = load(docs.sparkSession, model)

    def make():
        encoder = Encoder(shared.value)
        return lambda texts: _lists(encoder.encode([t or "" for t in texts]))

    return map_texts(docs, text, "ids array<int>, n_ids int", make)


def decode(rows: DataFrame, ids: str = "ids", into: str = "decoded", model: str = MODEL) -> DataFrame:
    """``rows`` with the text of ``ids`` in column ``into``; null ids give a null text."""
    shared = load(rows.sparkSession, model)
    rows = rows.drop(into)
    at, names = rows.columns.index(ids), [*rows.columns, into]

    def run(batches):
        pieces = shared.value
        for batch in batches:
            lists = batch.column(at)
            values, offsets, known = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_pylist(), lists.is_valid().to_pylist()
            texts = [decode_ids(pieces, values[a:b].tolist()) if ok else None for ok, a, b in zip(known, offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *StructType.fromDDL(f"`{into}` string").fields]))


def encoded_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """(doc_id, ids, n_ids, round_trip): the ids and whether they decode to the text; one pass, so one copy of the tables a core."""
    shared = load(docs.sparkSession, model)

    def make():
        pieces = shared.value
        encoder = Encoder(pieces)

        def work(texts):
            texts = [t or "" for t in texts]
            made = encoder.encode(texts)
            exact = [decode_ids(pieces, np.frombuffer(m, np.int32).tolist()) == t.replace(MARK, " ") for m, t in zip(made, texts)]
            ids, sizes = _lists(made)
            return ids, sizes.astype(np.int64), exact

        return work

    made = map_texts(docs.select(doc_id, F.col(text).alias("_text")), "_text", "ids array<int>, n_ids bigint, round_trip boolean", make)
    return made.select(doc_id, "ids", "n_ids", "round_trip")
