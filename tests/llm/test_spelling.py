"""Spelling variants against edits tried one by one."""

import collections
import os
import random
import re
import zlib

import numpy as np
import pytest

from pairrank.llm import spelling
from test_operators import COLUMNS, awkward

FULL = re.compile("[A-Za-zÀ-ÿ]+")


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    head = len(os.path.commonprefix([a, b]))
    return a[head + (len(a) >= len(b)):] == b[head + (len(b) >= len(a)):]


def brute(rows):
    n = collections.Counter()
    for number, text in rows:
        for run in FULL.findall(text or ""):
            run = "".join(c.lower() if c < "\x7f" else c for c in run)
            h = zlib.crc32(f"{'' if number is None else number}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 3}
    near = {w: {e for e in n if one_edit(w, e)} for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, n[w], form[w], root(w), len(near[w]), n.get(form[w])) for w in n)


def found(spark, rows):
    got = spelling.variants(spark.createDataFrame(rows, "doc_id bigint, text string"))
    return sorted((r.word, r.n, r.form, r.root, r.n_near, r.form_n) for r in got.collect())


@pytest.mark.parametrize("part", [2048, 16])
def test_variants(spark, monkeypatch, part):
    """Made words with many edits of edits, anagrams, ties, accents; one letter pattern holds a third of all words."""
    monkeypatch.setattr(spelling, "PART", part)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeéÿñ×") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    words += ["aaaab" + "".join(rng.sample("cdefgh", 3)) for _ in range(100)]
    for _ in range(500):
        word = list(rng.choice(words))
        k = rng.randrange(len(word))
        word[k:k + 1] = rng.choice([[], ["a"], [word[k], "b"], ["É"], ["z"]])
        words.append("".join(word))
    rows = [(k % 5 and k, " ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=60)).title()) for k in range(200)]
    wanted = brute(rows)
    assert found(spark, rows) == wanted
    assert sum(r[4] > 1 for r in wanted) > 30 and len({r[3] for r in wanted}) < len(wanted)
    assert any(r[2] and r[3] != r[2] for r in wanted)


def test_awkward_tables(spark):
    rows = awkward() * 3 + [(77, "x" * 3000 + " " + "x" * 2999 + " " + "y" + "x" * 2999, *awkward()[0][2:])] * 3
    got = spelling.variants(spark.createDataFrame(rows, COLUMNS))
    assert sorted((r.word, r.n, r.form, r.root, r.n_near, r.form_n) for r in got.collect()) == brute([r[:2] for r in rows])
    assert got.columns == ["word", "n", "form", "root", "n_near", "form_n"]
    assert spelling.variants(spark.createDataFrame([], COLUMNS)).count() == 0


def test_each_pair_of_blocks_meets_once():
    seen = {tuple(s) for s in spelling.STEPS}
    assert len(seen) == len(spelling.STEPS) == 22
    assert not any(tuple(-s) in seen for s in spelling.STEPS[1:])
    unit = np.eye(spelling.GROUPS, dtype=int)
    for i in range(spelling.GROUPS):
        assert tuple(unit[i]) in seen
        assert all(i == j or tuple(unit[i] - unit[j]) in seen or tuple(unit[j] - unit[i]) in seen for j in range(spelling.GROUPS))


def test_chains_are_followed_to_their_end(spark):
    links = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(37)] + [("v", "w5")], "word string, root string")
    assert {r.root for r in spelling.followed(links).collect()} == {"w37"}
