import random

import pytest

from pairrank.llm.common import components


def expected(pairs):
    """Least reachable id of every node, by union of sets."""
    group = {}
    for a, b in pairs:
        if a == b:
            continue
        joined = group.get(a, {a}) | group.get(b, {b})
        for node in joined:
            group[node] = joined
    return {node: min(joined) for node, joined in group.items()}


def found(spark, pairs, rounds=None):
    rows = components(spark.createDataFrame(pairs, "a bigint, b bigint"), rounds).collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.label for r in rows}


@pytest.mark.parametrize("shuffled", [False, True])
def test_a_long_path_settles_in_logarithmic_rounds(spark, shuffled):
    ids = list(range(1000))
    if shuffled:
        random.Random(3).shuffle(ids)
    rounds = []
    pairs = list(zip(ids, ids[1:]))
    assert found(spark, pairs, rounds) == dict.fromkeys(range(1000), 0)
    assert rounds[0] <= 12


def test_random_graphs(spark):
    pick = random.Random(5)
    for nodes, links in ((40, 25), (60, 60), (30, 90)):
        pairs = [(pick.randrange(-nodes, nodes), pick.randrange(-nodes, nodes)) for _ in range(links)]
        assert found(spark, pairs + pairs[:5]) == expected(pairs)


def test_stars_take_no_round_and_loops_no_row(spark):
    rounds = []
    assert found(spark, [(1, 2), (3, 1), (7, 7)], rounds) == {1: 1, 2: 1, 3: 1}
    assert rounds == [0]
    assert found(spark, []) == {}
