"""Secrets in texts: fixed rules, and a character network over every other candidate.

The rules find assignments, access keys and hex runs. Every other run of 12 or more token
characters with a digit is a candidate; a small convolutional network in numpy reads all of
it, in overlapping windows whose filters are pooled, with the characters before and after.
It is trained on the findings of the rules in the whole corpus, against all candidates that no
rule takes, in parts whose weights are averaged after each pass. Half of the findings lose what stands before them, and each
also appears with its characters drawn anew from the alphabets of other kinds of keys, so
the network has to learn what values look like and not their keywords.

A quarter of the findings and candidates, chosen by their value, is held out. On these the
network's output becomes a chance (Platt 1999), and the threshold is the largest that keeps
``RECALL`` of the findings; the model states the precision there.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairrank.llm.common import held, map_texts

# The rules, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
VALUE = re.compile(r"[A-Za-z0-9+/_.=-]+\Z")
HINTS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "network")

#: Alphabets of other keys: base 62, upper-case hex, base 32.
OTHER_KEYS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
#: A run may be a candidate from 12 characters on; a window holds this much of it and of both sides.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]*[0-9])[A-Za-z0-9+/_.=-]{12,}")
LEFT, BODY, RIGHT = 24, 48, 12
WINDOW = LEFT + BODY + RIGHT
#: Windows that a task trains on from common weights, windows of a step, and passes and steps at least.
PART_ROWS, BATCH, EPOCHS, STEPS = 8192, 64, 6, 600
RECALL, BLOCK = 0.95, 512
ALPHABET, FILTERS, REACH, EMBED = 72, 24, 5, 8
_CODE = np.zeros(256, np.int64)
for _k, _c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-", 2):
    _CODE[ord(_c)] = _k
_CODE[ord(" ")] = 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules' findings, in order; leftmost and non-overlapping for each kind."""
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    lower = text.lower()
    if any(h in lower for h in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return sorted(found)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the runs that overlap no finding of the rules."""
    out, at = [], 0
    for m in CANDIDATE.finditer(text):
        while at < len(taken) and taken[at][2] <= m.start():
            at += 1
        if not any(a < m.end() and m.start() < b for a, _, b in taken[at:at + 4]):
            out.append((m.start(), m.end()))
    return out


def _codes(left: str, body: str, right: str) -> np.ndarray:
    line = left.rjust(LEFT, "\0") + body.ljust(BODY, "\0") + right.ljust(RIGHT, "\0")
    codes = np.frombuffer(line.encode("latin-1", "replace"), np.uint8)
    return np.where(codes == 0, 0, np.where(_CODE[codes] == 0, ALPHABET - 1, _CODE[codes])).astype(np.uint8)


def windows(text: str, start: int, end: int, blank: bool = False) -> Iterator[np.ndarray]:
    """Codes of all of a candidate and of its surroundings; no stretch that a filter reads is cut by a window's end."""
    for at in range(start, max(start + 1, end - REACH + 1), BODY - REACH + 1):
        left = "" if blank and at == start else text[max(0, at - LEFT):at]
        stop = min(end, at + BODY)
        yield _codes(left, text[at:stop], text[stop:stop + RIGHT])


def other_key(value: str) -> str:
    """A value of this length with the characters of another kind of key."""
    draw = random.Random(value)
    return "".join(draw.choices(OTHER_KEYS[draw.randrange(len(OTHER_KEYS))], k=len(value)))


class CharNetwork:
    """Embedding, one convolution with ReLU, maximum over positions, logistic output."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.weights = {
            "embed": rng.normal(0, 0.5, (ALPHABET, EMBED)), "filters": rng.normal(0, 0.3, (REACH * EMBED, FILTERS)),
            "shift": np.zeros(FILTERS), "out": rng.normal(0, 0.3, FILTERS), "bias": np.zeros(1),
        }

    def forward(self, codes: np.ndarray):
        w = self.weights
        x = w["embed"][codes]
        n = WINDOW - REACH + 1
        patches = np.concatenate([x[:, k:k + n] for k in range(REACH)], axis=2)
        maps = patches @ w["filters"] + w["shift"]
        top = maps.argmax(axis=1)
        peak = np.maximum(0, np.take_along_axis(maps, top[:, None], 1)[:, 0])
        return patches, top, peak, 1 / (1 + np.exp(-np.clip(peak @ w["out"] + w["bias"], -30, 30)))

    def logits(self, codes: np.ndarray, owners: np.ndarray | None = None) -> np.ndarray:
        """Log odds of windows, or of candidates whose windows ``owners`` (rising from 0) names: filters are pooled over them."""
        owners = np.arange(len(codes)) if owners is None else owners
        peaks = np.zeros((int(owners.max(initial=-1)) + 1, FILTERS))
        for k in range(0, len(codes), BLOCK):
            np.maximum.at(peaks, owners[k:k + BLOCK], self.forward(codes[k:k + BLOCK])[2])
        return peaks @ self.weights["out"] + self.weights["bias"]

    def chance(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(codes), -30, 30)))

    def train(
        self, codes: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 7,
        steps: int = STEPS, share: float | None = None,
    ) -> CharNetwork:
        """Adam on the logistic loss, both classes weighing alike; ``share`` is that of the findings, else that of ``labels``."""
        share = labels.mean() if share is None else share
        rng, w = np.random.default_rng(seed), self.weights
        weight = np.where(labels > 0, 0.5 / max(1e-9, share), 0.5 / max(1e-9, 1 - share))
        mean, square, step = {k: 0.0 for k in w}, {k: 0.0 for k in w}, 0
        # A small sample is passed over more often.
        for _ in range(max(epochs, -(-steps * BATCH // max(1, len(labels))))):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), BATCH):
                rows = order[at:at + BATCH]
                patches, top, peak, chance = self.forward(codes[rows])
                error = (chance - labels[rows]) * weight[rows] / len(rows)
                up = (error[:, None] * w["out"]) * (peak > 0)
                chosen = np.take_along_axis(patches, top[:, :, None], 1)  # rows x filters x patch
                grad = {
                    "out": peak.T @ error, "bias": np.array([error.sum()]), "shift": up.sum(axis=0),
                    "filters": np.einsum("nfp,nf->pf", chosen, up), "embed": np.zeros_like(w["embed"]),
                }
                back = (up[:, :, None] * w["filters"].T).reshape(len(rows), FILTERS, REACH, EMBED)
                for k in range(REACH):
                    np.add.at(grad["embed"], np.take_along_axis(codes[rows], top + k, 1), back[:, :, k])
                step += 1
                for k in w:
                    mean[k] = 0.9 * mean[k] + 0.1 * grad[k]
                    square[k] = 0.999 * square[k] + 0.001 * grad[k]**2
                    w[k] = w[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
        return self


def platt(logits: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift that turn log odds into chances: Newton's method on the logistic loss with smoothed targets."""
    x = np.stack([logits, np.ones(len(logits))], axis=1)

    def slopes(w: np.ndarray, good: float, bad: float) -> tuple[np.ndarray, np.ndarray]:
        p = _chance(x @ w)
        return (x * (p * (1 - p))[:, None]).T @ x, x.T @ (p - np.where(labels > 0, good, bad))

    return _newton(slopes, labels.sum(), (1 - labels).sum(), steps)


def _chance(odds):
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _newton(slopes: Callable, n_good: int, n_bad: int, steps: int = 50) -> tuple[float, float]:
    """Slope and shift; ``slopes`` gives both derivatives of the loss at a point, for the targets of good and of bad rows."""
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        bend, lean = slopes(w, (n_good + 1) / (n_good + 2), 1 / (n_bad + 2))
        step = np.linalg.solve(bend + 1e-3 * np.eye(2), lean + 1e-3 * (w - [1.0, 0.0]))
        # A short step keeps Newton's method from overshooting where classes lie far apart.
        w = w - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


@dataclass
class SecretModel:
    """``threshold`` bounds calibrated chances; above 1 the rules alone decide. ``recall`` and ``precision`` are those held out."""

    network: CharNetwork
    threshold: float
    slope: float = 1.0
    shift: float = 0.0
    recall: float = 0.0
    precision: float = 0.0

    def chance(self, codes: np.ndarray, owners: np.ndarray | None = None) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.network.logits(codes, owners) + self.shift, -30, 30)))


def fit(docs: DataFrame, text: str = "text") -> SecretModel:
    """Trains on the findings and candidates of all documents, each distinct window once.

    Windows are dealt by their hash into parts of about ``PART_ROWS``. In a round every part trains on from the same
    weights, one pass over its windows, and the results are averaged (McMahan et al. 2017); a single part keeps all its
    passes together. Chances, threshold, recall and precision come from sums and counts over all held-out windows.
    Without findings or without candidates, in training or held out, the threshold is above 1, and the rules alone decide.
    """
    rows = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("_text"))

    def make():
        def work(texts):
            return [[_of_text(t) for t in texts]]

        return work

    marked = map_texts(rows, "_text", "w array<string>", make).select(F.explode("w").alias("w")).select(F.unhex("w").alias("w")).distinct()
    mark = F.conv(F.hex(F.substring("w", 1, 1)), 16, 10).cast("int")
    kept = held(marked.select(F.expr("substring(w, 2)").alias("codes"), (mark >= 2).cast("double").alias("label"), (mark % 2 == 1).alias("out")))
    counts = {(r["out"], r["label"]): r["count"] for r in kept.df.groupBy("out", "label").count().collect()}
    n = {key: counts.get(key, 0) for key in [(out, label) for out in (False, True) for label in (0.0, 1.0)]}
    if min(n.values()) < 1 or any(n[False, label] + n[True, label] < 8 for label in (0.0, 1.0)):
        kept.release()
        return SecretModel(CharNetwork(), 2.0)
    model = SecretModel(_trained(kept.df.where("not out"), n[False, 1.0], n[False, 0.0]), 2.0)
    network = model.network

    def logits(batches):
        for batch in batches:
            codes = _windows_of(batch.column("codes").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(network.logits(codes)), batch.column("label")], names=["x", "label"])

    scored = held(kept.df.where("out").select("codes", "label").mapInArrow(logits, "x double, label double"))
    kept.release()
    n_good, n_bad = n[True, 1.0], n[True, 0.0]
    model.slope, model.shift = _newton(lambda w, good, bad: _slopes(scored.df, w, good, bad), n_good, n_bad)
    least = _at_place(scored.df.where("label > 0").select("x"), int((1 - RECALL) * (n_good - 1)))
    model.threshold = float(_chance(model.slope * least + model.shift))
    found = {r["label"]: r["count"] for r in scored.df.where(F.col("x") >= least).groupBy("label").count().collect()}
    scored.release()
    model.recall, model.precision = found.get(1.0, 0) / n_good, found.get(1.0, 0) / max(1, sum(found.values()))
    return model


def _of_text(t: str) -> list[str]:
    """The marked windows of a text's findings, of these with the characters of other keys, and of its candidates."""
    spans, out = base_spans(t), []
    for n, (start, kind, end) in enumerate(spans):
        # An assignment's value is what follows its keyword; half of the findings lose what stands before.
        at = end - len(VALUE.search(t, start, end)[0]) if kind == 0 else start
        value, blank = t[at:end], (start + n) % 2 == 0
        around = t[max(0, at - LEFT):at], t[end:end + RIGHT]
        out += [_labelled(value, w, True) for w in windows(t, at, end, blank)]
        other = around[0] + other_key(value) + around[1]
        out += [_labelled(value, w, True) for w in windows(other, len(around[0]), len(other) - len(around[1]), blank)]
    return out + [_labelled(t[a:b], w, False) for a, b in candidates(t, spans) for w in windows(t, a, b)]


def _windows_of(codes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(codes), np.uint8).reshape(-1, WINDOW)


def _trained(rows: DataFrame, n_good: int, n_bad: int) -> CharNetwork:
    """A network trained on all ``rows`` (codes, label), part by part; parts and their order do not depend on the cluster."""
    parts, share = -(-(n_good + n_bad) // PART_ROWS), n_good / (n_good + n_bad)
    dealt = rows.groupBy(F.pmod(F.xxhash64("codes"), F.lit(parts)).alias("part")).agg(F.sort_array(F.collect_list(F.struct("codes", "label"))).alias("rows"))
    dealt, network = held(dealt), CharNetwork()
    names = list(network.weights)
    rounds, how = (1, {}) if parts == 1 else (max(EPOCHS, -(-STEPS * BATCH // PART_ROWS)), {"epochs": 1, "steps": 0})
    for k in range(rounds):
        weights = network.weights

        def work(batches, weights=weights, seed=7 + k):
            for batch in batches:
                for part, some in zip(batch.column("part").to_pylist(), batch.column("rows")):
                    own, values = CharNetwork(), some.values
                    own.weights = {name: w.copy() for name, w in weights.items()}
                    labels = values.field("label").to_numpy(zero_copy_only=False)
                    own.train(_windows_of(values.field("codes").to_pylist()), labels, seed=seed, share=share, **how)
                    flat = np.concatenate([own.weights[name].ravel() for name in names])
                    yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([len(labels)]), pa.array([flat.tolist()])], names=["part", "n", "flat"])

        grown = dealt.df.repartition(parts, "part").mapInArrow(work, "part long, n long, flat array<double>")
        # Summed in the order of the parts, so that a repeated run gives the same digits.
        each = grown.select("part", "n", F.posexplode("flat").alias("at", "value")).groupBy("at").agg(
            F.sort_array(F.collect_list(F.struct("part", (F.col("value") * F.col("n")).alias("v")))).alias("all"), F.sum("n").alias("n"))
        mean = each.select("at", (F.aggregate("all", F.lit(0.0), lambda total, x: total + x["v"]) / F.col("n")).alias("value")).orderBy("at").collect()
        flat, at, network = np.array([r["value"] for r in mean]), 0, CharNetwork()
        for name in names:
            shape = weights[name].shape
            network.weights[name] = flat[at:at + int(np.prod(shape))].reshape(shape)
            at += int(np.prod(shape))
    dealt.release()
    return network


def _slopes(scored: DataFrame, w: np.ndarray, good: float, bad: float) -> tuple[np.ndarray, np.ndarray]:
    """Second and first derivatives of the loss of logits ``x``, summed over all rows."""
    x = F.col("x")
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x * float(w[0]) + float(w[1])))))
    off, bend = p - F.when(F.col("label") > 0, float(good)).otherwise(float(bad)), p * (1 - p)
    r = scored.agg(*[F.sum(c) for c in (bend * x * x, bend * x, bend, off * x, off)]).first()
    return np.array([[r[0], r[1]], [r[1], r[2]]]), np.array([r[3], r[4]])


def _at_place(values: DataFrame, place: int, bins: int = 1000) -> float:
    """The value at ``place`` (from 0) of the rising values of ``x``, by counts in ever narrower ranges."""
    x = F.col("x")
    low, high = values.agg(F.min(x), F.max(x)).first()
    while low < high and low + (high - low) / bins > low:
        at = F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1))
        found = values.where(x.between(low, high)).groupBy(at.alias("at")).agg(F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"))
        for r in sorted(found.collect(), key=lambda r: r["at"]):
            if place < r["n"]:
                low, high = r["low"], r["high"]
                break
            place -= r["n"]
    return low


def _labelled(value: str, window: np.ndarray, good: bool) -> str:
    """A window behind its mark: 1 if its value is held out, and 2 for a finding."""
    return (bytes([(zlib.crc32(value.encode()) % 4 == 3) + 2 * good]) + window.tobytes()).hex()


def scan(docs: DataFrame, model: SecretModel, text: str = "text") -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, ``base`` and ``spans`` (kind:start:end by start, then kind, comma-joined).

    Offsets are code points, ends exclusive; ``network`` spans overlap no base span. Null and empty texts have none. Columns
    of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def work(texts):
            base = [base_spans(t or "") for t in texts]
            wanted = [(k, a, b) for k, (t, taken) in enumerate(zip(texts, base)) if t for a, b in candidates(t, taken)]
            extra: list[list] = [[] for _ in texts]
            if wanted and m.threshold <= 1:
                parts = [list(windows(texts[k], a, b)) for k, a, b in wanted]
                owners = np.repeat(np.arange(len(parts)), [len(some) for some in parts])
                chance = m.chance(np.array([w for some in parts for w in some]), owners)
                for (k, a, b), p in zip(wanted, chance):
                    if p >= m.threshold:
                        extra[k].append((a, 3, b))
            counts = [[sum(kind == c for _, kind, _ in some) for some in base] for c in range(3)]
            say = lambda some: ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in sorted(some))
            return *counts, [say(b) for b in base], [say(b + e) for b, e in zip(base, extra)]

        return work

    return map_texts(docs, text, "n_assign bigint, n_access bigint, n_hex bigint, base string, spans string", make)
