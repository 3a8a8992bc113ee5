"""Shape of the physical plans: what must not appear at any scale."""

import re

import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
TRAINED = {"train_predict", "rank_learned"}


def plan(spark, name):
    return contract.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - TRAINED))
def test_no_cross_join_and_no_single_task_window(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    lines = text.splitlines()
    for above, line in zip(lines, lines[1:]):
        if "Exchange SinglePartition" in line:
            # Only a global aggregate may end in one task: it receives one row per task.
            assert "Aggregate" in above, above
    for window in re.findall(r"Window \[.*", text):
        assert not re.search(r"windowspecdefinition\(\S+ (ASC|DESC)", window), window


@pytest.mark.parametrize(
    "name, columns",
    [
        ("fk_violations", "doc_id:bigint"), ("feature_coverage", "l_partkey:bigint"),
        ("label_distribution", "l_returnflag:string"), ("latency_histogram", "event_type:string,value:double"),
        ("similar_topk", "vec_id:bigint,embedding:array<float>,label:int"),
    ],
)
def test_scans_read_only_their_columns(spark, name, columns):
    assert f"ReadSchema: struct<{columns}>" in plan(spark, name)


def test_candidates_of_few_queries_are_not_shuffled(spark):
    text = plan(spark, "similar_topk")
    below = text[text.index("MapInArrow"):]
    assert "Exchange" not in below
    assert text.count("WindowGroupLimit") == 4


def test_split_never_shuffles_the_rows(spark):
    text = plan(spark, "stratified_split")
    assert "Exchange hashpartitioning" not in text and "Sort [" not in text
