"""Language of texts: averaged embeddings of hashed subwords under a linear softmax.

A text is the average of the embeddings of its byte n-grams (2 to 4, letters lower-cased in
ASCII, digits and signs left out), hashed to ``BUCKETS`` rows. The fit is stochastic
gradient descent in numpy on a bounded sample of the labelled documents; temperature and
rejection threshold come from a part of that sample that the gradients do not see. For
prediction the embedding table times the softmax weights is one small table, so a text
costs one count of its n-grams and one product.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairrank.llm.common import fold, map_texts

BUCKETS, WIDTH = 1 << 14, 16
#: Documents learned from, of each language and in all.
PER_LANGUAGE, SAMPLE_ROWS = 800, 6_000
#: Languages with fewer learned documents than this are not predicted.
LEAST_ROWS = 2
HELD_OUT, HELD_PART = 3, 1
EPOCHS, BATCH, RATE = 12, 64, 0.5
#: Share of right answers that the rejection threshold keeps.
KEPT_RIGHT = 0.995
TEMPERATURES = np.geomspace(0.01, 20, 160)
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[*range(65), *range(91, 97), *range(123, 128)]] = 32


def ngram_counts(text: str | None) -> np.ndarray:
    """Counts of the hashed byte n-grams of a whole text."""
    codes = _FOLD[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    codes = np.concatenate(([np.uint32(32)], codes, [np.uint32(32)])).astype(np.uint32)
    # Runs of blanks count as one.
    codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
    total = np.zeros(BUCKETS)
    gram = codes
    for size in (2, 3, 4):
        gram = gram[:-1] * np.uint32(0x01000193) ^ codes[size - 1:]
        if not len(gram):
            break
        total += np.bincount((gram * np.uint32(2654435761)) >> np.uint32(18), minlength=BUCKETS)
    return total


def has_letter(text: str | None) -> bool:
    return bool(text) and LETTER.search(text) is not None


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: embeddings times weights
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        share = counts / np.maximum(1, counts.sum(axis=-1, keepdims=True))
        return softmax((share @ self.table + self.bias) / self.temperature)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(counts: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 5) -> LanguageModel:
    """Fits on rows of n-gram counts, which become shares in place; every fifth row calibrates only (all do both if few).

    The temperature is that of least loss against smoothed labels: each row leaves the wrong languages a share of
    1 / (rows + 2), so that faultless answers on a few rows do not pass for certainty.
    """
    rng = np.random.default_rng(seed)
    n_languages = len(languages)
    share = np.divide(counts, np.maximum(1, counts.sum(axis=1, keepdims=True)), out=counts)
    calibrate = np.arange(len(labels)) % 5 == 4
    if len(labels) < 50:
        fit, calibrate = np.arange(len(labels)), np.ones(len(labels), bool)
    else:
        fit = np.flatnonzero(~calibrate)
    embedding = rng.normal(0, 1, (BUCKETS, WIDTH)).astype(np.float32)
    weight, bias = np.zeros((WIDTH, n_languages), np.float32), np.zeros(n_languages, np.float32)
    target = np.eye(n_languages, dtype=np.float32)[labels]
    # Languages weigh alike, whatever their number of rows.
    balance = 1 / np.maximum(1, np.bincount(labels, minlength=n_languages))
    balance = (balance / (balance[labels].mean()))[labels].astype(np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(fit)
        for start in range(0, len(order), BATCH):
            rows = order[start:start + BATCH]
            x = share[rows].astype(np.float32)
            # Averages of many n-grams are small; the scale keeps the steps of a useful size.
            hidden = (x @ embedding) * 10
            error = (softmax(hidden @ weight + bias) - target[rows]) * balance[rows, None] / len(rows)
            step = (x.T @ (error @ weight.T)) * 10
            weight -= rate * hidden.T @ error
            bias -= rate * error.sum(axis=0)
            embedding -= rate * 10 * step
    table = (embedding @ weight).astype(np.float64) * 10
    checked = np.arange(len(labels))[calibrate]
    logits = np.concatenate([share[checked[k:k + BATCH]] @ table + bias for k in range(0, len(checked), BATCH)])
    right = labels[calibrate]
    doubt = 1 / (len(right) + 2)
    wanted = np.where(np.eye(n_languages)[right] > 0, 1 - doubt, doubt / max(1, n_languages - 1))
    loss = [-(wanted * np.log(softmax(logits / t) + 1e-300)).sum(axis=1).mean() for t in TEMPERATURES]
    temperature = float(TEMPERATURES[int(np.argmin(loss))])
    chance = softmax(logits / temperature)
    good = chance.max(axis=1)[chance.argmax(axis=1) == right]
    threshold = float(np.quantile(good, 1 - KEPT_RIGHT)) if len(good) else 0.0
    return LanguageModel(languages, table, bias.astype(np.float64), temperature, threshold)


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learns from documents with id, lettered text and language whose fold is not held out.

    At most about ``per_language`` documents of a language and ``sample_rows`` in all, by the
    hash of the id. Without any, every prediction is ``und``.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("_text"), F.col(lang).alias("lang")).where(
        F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("_text").rlike(r"\p{L}") & (fold(F.col("id"), HELD_OUT) != HELD_PART)
    )
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().where(F.col("count") >= LEAST_ROWS).orderBy(F.desc("count"), "lang").limit(sample_rows // LEAST_ROWS).collect()}
    if not sizes:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    each = max(LEAST_ROWS, min(per_language, sample_rows // len(sizes)))
    # A language's share of the hash range lets about ``each`` of its documents in.
    shares = rows.sparkSession.createDataFrame([(k, min(1.0, each / n)) for k, n in sizes.items()], "lang string, share double")
    chosen = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.col("share") * (1 << 20))

    def make():
        def work(texts):
            counts = [ngram_counts(t) for t in texts]
            places = [np.flatnonzero(c) for c in counts]
            return [p.astype(np.int32) for p in places], [c[p].astype(np.int32) for c, p in zip(counts, places)]

        return work

    found = map_texts(chosen.select("id", "lang", "_text"), "_text", "place array<int>, n array<int>", make).select("id", "lang", "place", "n")
    table = found.toArrow().sort_by([("id", "ascending"), ("lang", "ascending")])
    languages = sorted(sizes)
    counts = np.zeros((table.num_rows, BUCKETS), np.float32)
    for k, (place, n) in enumerate(zip(table.column("place"), table.column("n"))):
        counts[k, place.values.to_numpy()] = n.values.to_numpy()
    labels = np.array([languages.index(v) for v in table.column("lang").to_pylist()], np.int64)
    if not len(labels):
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    return train(counts, labels, languages)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (its probability, 12 digits) and ``rejected``.

    Texts that are null or hold no letter are ``und`` with score 0, rejected. ``rejected``
    marks answers below the calibrated threshold. Each row is judged alone, so equal texts
    get equal answers, whatever their ids; of equally likely languages the first by name
    wins. Columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def work(texts):
            names, scores, rejected = [], [], []
            for t in texts:
                if not m.languages or not has_letter(t):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    rejected.append(True)
                    continue
                chance = m.probabilities(ngram_counts(t))
                best = int(chance.argmax())
                names.append(m.languages[best])
                scores.append(round(float(min(1.0, chance[best])), 12))
                rejected.append(bool(chance[best] < m.threshold))
            return names, scores, rejected

        return work

    return map_texts(docs, text, "lang_pred string, score double, rejected boolean", make)
