"""Toxicity of documents: boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of a lexicon in three strengths, how close its words are to
the second person, and rates of capitals, punctuation and obfuscation (``1d1ot``,
``i*diot``). The lexicon is learned from labelled documents as words and word beginnings
whose presence tells toxic from clean ones; a few general insults are in it from the start.

The fit uses a bounded sample of the labelled rows (``sample_rows``): each labelled
document gets features from a lexicon learned without its own part of the sample, three
parts fit the trees and the fourth the calibration. Scoring is one pass over all texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairrank.llm.common import fold, hold, map_texts
from pairrank.llm.gbt import BoostedTrees, Isotonic

#: Labelled rows that the fit may use, and candidates for its lexicon.
SAMPLE_ROWS, LEXICON_ROWS = 12_000, 20_000
#: Documents fit and scored apart: crc32 of the id modulo this; remainder 0 is never learned from.
HELD_OUT = 5
#: Lengths of the word beginnings in the lexicon.
STEMS = (4, 5, 6, 8)
#: Log-odds from which a word is weak, medium or strong.
STRENGTHS = (1.5, 2.5, 3.5)
# General insults, second-person words, and look-alike characters.
INSULTS = "idiot moron stupid dumb scum trash loser pathetic worthless disgusting clown jerk fool imbecile".split()
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine euch ihr sie tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros tus".split()
)
LOOKALIKE = str.maketrans("013457@$!|", "oieastasil", "*._-'")

SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "…«»„“”‘’–—¡¿·"
WORDS = re.compile(r"[^\W_]+")
#: Strength of a word that is disguised but not in the lexicon.
DISGUISED = 1e-6
DISGUISE = re.compile(r"[^\W\d_][013457@$!|*]+[^\W\d_]")
_CLASS = np.zeros(256, np.int64)
for _codes, _kind in ((range(97, 123), 1), (range(65, 91), 2), (range(48, 58), 3), (range(128, 256), 4)):
    _CLASS[list(_codes)] = _kind
for _kind, _letter in enumerate(b"!?*@$.,", 5):
    _CLASS[_letter] = _kind
_CLASS[[9, 10, 11, 12, 13, 32]] = 12
N_CLASSES = 13
NEAR = 5
FEATURES = (
    "log_words", "weak", "medium", "strong", "hits", "peak", "near_person", "person", "capitals", "shouting", "exclaim", "question",
    "stars", "signs", "obfuscated", "obfuscated_hits", "mean_strength",
)


@dataclass
class Toxicity:
    lexicon: dict[str, float]
    trees: BoostedTrees
    calibration: Isotonic


class Tokens:
    """Strength of words: of the word itself or its strongest beginning in the lexicon, 0 if there is none.

    Below zero if the word is in the lexicon only once its look-alike characters are undone;
    ``DISGUISED`` if it has such characters between letters and is not in the lexicon.
    """

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.heads = {e.rstrip("~")[:STEMS[0]] for e in lexicon}
        self.known: dict[str, float] = {}

    def strength(self, word: str) -> float:
        if word[:STEMS[0]] not in self.heads:
            return 0.0
        known = self.lexicon.get
        return max(known(word, 0.0), *(known(word[:k] + "~", 0.0) for k in STEMS))

    def learn(self, word: str) -> float:
        bare = word if word.isalpha() else word.strip(SIGNS)
        found = self.strength(bare)
        if found == 0.0 and not bare.isalpha():
            plain = bare.translate(LOOKALIKE)
            if plain != bare:
                found = -self.strength(plain) or (DISGUISED if DISGUISE.search(bare) else 0.0)
        if len(word) <= 64:
            self.known[word] = found
        return found

    def of(self, words: list[str]) -> list[float]:
        if len(self.known) > 300_000:
            self.known = {}
        found = list(map(self.known.get, words))
        if None in found:
            known = self.known.get
            for i, word in enumerate(words):
                if found[i] is None:
                    value = known(word)
                    found[i] = self.learn(word) if value is None else value
        return found


def features(text: str | None, tokens: Tokens) -> list[float]:
    """The dense features of one whole text; a null or empty text has all zero."""
    text = text or ""
    words = text.lower().split()
    n = max(1, len(words))
    strength = tokens.of(words)
    at = [i for i, s in enumerate(strength) if s and abs(s) != DISGUISED] if any(strength) else []
    hits = [abs(strength[i]) for i in at]
    bare = {i: words[i].strip(SIGNS) for k in at for i in range(max(0, k - NEAR), min(len(words), k + NEAR + 1))}
    near = sum(any(bare[i] in SECOND_PERSON for i in range(max(0, k - NEAR), min(len(words), k + NEAR + 1))) for k in at)
    kinds = np.bincount(_CLASS[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)], minlength=N_CLASSES)
    letters, chars = max(1, kinds[1] + kinds[2] + kinds[4]), max(1, len(text))
    weak, medium, strong = (sum(h >= s for h in hits) for s in STRENGTHS)
    return [
        float(np.log1p(len(words))), weak / n, medium / n, strong / n, float(np.log1p(strong)), max(hits, default=0.0), near / n,
        sum(map(SECOND_PERSON.__contains__, words)) / n, kinds[2] / letters, float(kinds[2] > kinds[1]),
        kinds[5] / chars, kinds[6] / chars, kinds[7] / chars, (kinds[8] + kinds[9]) / chars, strength.count(DISGUISED) / n,
        float(sum(strength[i] < 0 for i in at)), sum(hits) / n,
    ]


def entries(text: str | None) -> set[str]:
    """The words of a text and their beginnings, as the lexicon writes them."""
    words = set(WORDS.findall((text or "").lower()))
    return words.union(*({w[:k] + "~" for w in words if len(w) >= k} for k in STEMS))


def _odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    return np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))


def _lexicon(names: list[str], toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> dict[str, float]:
    """Entries found in at least 4 toxic documents, by log-odds; the general insults are at least medium."""
    odds = np.minimum(_odds(toxic, clean, n_toxic, n_clean), 6.0)
    chosen = {e: float(o) for e, o, n in zip(names, odds, toxic) if o >= STRENGTHS[0] and n >= 4}
    for word in INSULTS:
        chosen[word] = max(chosen.get(word, 0.0), STRENGTHS[1])
    return chosen


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Toxicity:
    """Learns from the labelled rows whose fold is not 0, at most ``sample_rows`` of them.

    The sample is the rows with the least hash of the id. Null labels, ids and texts are no
    rows. Without rows of both classes the general insults alone decide.
    """
    chosen = hold(
        labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & (fold(F.col(doc_id), HELD_OUT) != 0))
        .groupBy(F.col(doc_id).alias("_id")).agg(F.max(F.col(label)).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    )
    part = (fold(F.col("_id"), HELD_OUT) - 1).cast("int")
    # Two columns of at most sample_rows rows.
    rows = hold(
        docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).where("_text is not null").join(F.broadcast(chosen), "_id")
        .select("_text", "_label", part.alias("_part"))
    )
    counts = np.zeros((HELD_OUT - 1, 2))
    for r in rows.groupBy("_part", "_label").count().collect():
        counts[r["_part"], int(r["_label"] > 0)] = r["count"]
    parts = range(HELD_OUT - 1)
    sums = [F.count(F.when(F.col("_part") == p, 1)).alias(f"n{p}") for p in parts]
    found = (
        map_texts(rows.where("_label > 0"), "_text", "entry array<string>", lambda: lambda texts: ([sorted(entries(t)) for t in texts],))
        .select("_part", F.explode("entry").alias("entry")).groupBy("entry").agg(*sums, F.count("*").alias("n"))
        .where("n >= 4").orderBy(F.desc("n"), "entry").limit(LEXICON_ROWS).collect()
    )
    names = [r.entry for r in found]
    shared = docs.sparkSession.sparkContext.broadcast({e: i for i, e in enumerate(names)})

    def look():
        index = shared.value
        return lambda texts: ([[index[e] for e in entries(t) if e in index] for t in texts],)

    table = np.zeros((len(names), HELD_OUT - 1, 2))
    table[:, :, 1] = np.array([[r[f"n{p}"] for p in parts] for r in found], float).reshape(len(names), len(parts))
    in_clean = map_texts(rows.where("_label <= 0"), "_text", "entry array<int>", look).select("_part", F.explode("entry").alias("entry"))
    for r in in_clean.groupBy("entry").agg(*sums).collect():
        table[r.entry, :, 0] = [r[f"n{p}"] for p in parts]

    def lexicon(without: int | None) -> dict[str, float]:
        kept = [p for p in parts if p != without]
        seen, size = table[:, kept].sum(axis=1), counts[kept].sum(axis=0)
        return _lexicon(names, seen[:, 1], seen[:, 0], size[1], size[0])

    lexicons = [lexicon(p) for p in parts]

    def make():
        tables = [Tokens(x) for x in lexicons]
        return lambda texts, parts: ([features(t, tables[p]) for t, p in zip(texts, parts)],)

    vectors = map_texts(rows, "_text", "x array<double>", make, also=("_part",)).drop("_text").collect()
    x = np.array([r.x for r in vectors], float).reshape(-1, len(FEATURES))
    part_of, y = np.array([r["_part"] for r in vectors], int), np.array([r["_label"] > 0 for r in vectors], float)
    late = part_of == HELD_OUT - 2
    train, test = ~late, late
    if len(set(y[train])) < 2 or len(set(y[test])) < 2:
        train = test = np.ones(len(y), bool)
    if len(set(y)) < 2:
        # Nothing to learn: the share of general insults decides.
        x = np.zeros((40, len(FEATURES)))
        x[20:, FEATURES.index("medium")] = 0.02
        x[20:, FEATURES.index("peak")] = STRENGTHS[1]
        y, train = np.repeat([0.0, 1.0], 20), np.ones(40, bool)
        test = train
    trees = BoostedTrees().fit(x[train], y[train])
    return Toxicity(lexicon(None), trees, Isotonic().fit(trees.margin(x[test]), y[test]))


def score(docs: DataFrame, model: Toxicity, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, rounded to 12 digits) and ``predicted`` (1 from 0.5 on).

    Null and empty texts get the score of a text without words. Columns named score or
    predicted are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        tokens = Tokens(m.lexicon)

        def work(texts):
            if not texts:
                return [], []
            x = np.array([features(t, tokens) for t in texts], float)
            value = np.clip(m.calibration.apply(m.trees.margin(x)), 0, 1).round(12)
            return value, (value >= 0.5).astype(np.int32)

        return work

    return map_texts(docs, text, "score double, predicted int", make)


def without_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not call toxic; same columns."""
    own = [c for c in docs.columns if c.lower() in ("score", "predicted")]
    docs_in = docs.withColumnsRenamed({c: f"_own_{c}" for c in own})
    kept = score(docs_in, fit(docs, labels, doc_id, text), text).where("predicted = 0").drop("score", "predicted")
    return kept.withColumnsRenamed({f"_own_{c}": c for c in own})
