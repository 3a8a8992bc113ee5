"""Substring dedup against windows compared one by one."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairrank.llm import substring_dedup
from pairrank.llm.shingles import word_hashes
from test_operators import COLUMNS, awkward

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """{(doc, text): (n_words, kept)}"""
    texts = sorted({(i, t) for i, t in rows if i is not None and t}, key=lambda x: (x[0], x[1]))
    seen, gone = {}, {}
    for i, text in texts:
        words = WORD.findall(text)
        for k in range(len(words) - 19):
            if seen.setdefault(tuple(words[k:k + 20]), (i, text, k)) != (i, text, k):
                gone.setdefault((i, text), set()).update(range(k, k + 20))
    out = []
    for i, text in rows:
        words = WORD.findall(text or "")
        less = gone.get((i, text), set())
        out.append((i, len(words), len(less), " ".join(w for k, w in enumerate(words) if k not in less)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in df.collect()), key=str)


def passages():
    rng = random.Random(4)

    def some(n):
        return [f"w{rng.randrange(400)}" for _ in range(n)]

    common, base = some(45), some(150)
    rows = []
    for n in range(240):
        words = some(rng.randrange(0, 60))
        if n % 3 == 0:  # a passage that a third of the documents hold, whole or cut
            words += common[rng.randrange(0, 8):rng.randrange(20, 46)] + some(5)
        if n % 3 == 1:  # near copies of one document
            near = list(base)
            near[rng.randrange(150)] = f"n{n}"
            words = near if n % 2 else near + words
        if n % 10 == 9:
            words = words + words[-30:] + some(1) + words[-25:]
        rows.append((n, "\t".join(words[:7]) + " " + "  ".join(words[7:])))
    rows += [(300 + k, t.replace("  ", "\n")) for k, (_, t) in enumerate(rows[:30])]  # the same words
    rows += [(400, "a " * 90), (401, "b a " * 50), (402, "a " * 19), (403, "a " * 20), (404, "a " * 21)]
    return rows


@pytest.mark.parametrize("same, task", [(8192, 16384), (3, 50)])
def test_windows(spark, monkeypatch, same, task):
    monkeypatch.setattr(substring_dedup, "SAME", same)
    monkeypatch.setattr(substring_dedup, "TASK", task)
    rows = passages()
    got = substring_dedup.without_copied(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7))
    wanted = brute(rows)
    assert found(got) == wanted and sum(r[2] > 0 for r in wanted) > 100
    for row in got.collect():
        assert sum(s.end - s.start for s in row.spans) == row.n_removed


def test_awkward_tables(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SAME", 5000)
    long = " ".join(f"x{k}" for k in range(40))
    rows = awkward() + [(i, t, *awkward()[0][2:]) for i, t in ((20, long), (20, long), (21, "y " + long), (None, long), (22, long))]
    odd = spark.createDataFrame(rows, COLUMNS)
    got = substring_dedup.without_copied(odd)
    assert found(got) == brute([r[:2] for r in rows])
    assert sorted(got.columns) == sorted([*odd.columns, "n_words", "n_removed", "spans"])
    none = substring_dedup.without_copied(spark.createDataFrame([], COLUMNS))
    assert none.count() == 0 and none.columns == got.columns


def test_an_id_with_two_texts(spark):
    """Ordered by a hash of the text: one of them keeps all, the other loses the shared words."""
    shared = " ".join(f"x{k}" for k in range(30))
    rows = [(1, shared + " tail"), (1, "head " + shared), (2, shared)]
    got = {(r.doc_id, r.text): r.n_removed for r in substring_dedup.without_copied(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert sorted(got.values()) == [0, 30, 30] and got[(2, "")] == 30


def test_anchors_cover_every_window_once():
    words = word_hashes(" ".join(random.Random(1).choices("a b c d e f g h".split(), k=500)))
    covered = []
    for place, key, low, high in zip(*substring_dedup.anchors(words)):
        assert 0 <= low <= high < substring_dedup.SERVED
        covered += range(place - high, place - low + 1)
    assert covered == list(range(len(words) - 19))


def test_text_ids(spark):
    rows = spark.range(30).select(F.concat(F.lit("d"), F.col("id")).alias("doc_id"), F.lit("the same words again " * 8).alias("text"))
    got = substring_dedup.without_copied(rows).collect()
    assert [r.n_removed for r in got if r.doc_id != "d0"] == [32] * 29
    assert np.array([r.n_removed for r in got if r.doc_id == "d0"]).tolist() == [28]
