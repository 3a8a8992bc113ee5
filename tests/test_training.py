import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from pairrank.operators import keyed, metrics
from pairrank.operators.split import deal_groups, group_seats, grouped_split, split_overlap, split_sizes, stratified_split
from pairrank.plans.inference import Inference
from pairrank.plans.models import BoostedTrees, scoring_strategy
from pairrank.plans.training import Training, TrainingData
from pairrank.sources.feature_store import FeatureStore, read_json


def scored(spark, pairs, split="test"):
    rows = [(i, label, score, split) for i, (label, score) in enumerate(pairs)]
    return spark.createDataFrame(rows, "key int, label int, score double, split string")


def report(df, **kw):
    return {r["split"]: r.asDict(recursive=True) for r in metrics.evaluate(df, **kw).collect()}


def test_perfect_ranking(spark):
    r = report(scored(spark, [(1, 0.9), (1, 0.8), (1, 0.7)] + [(0, 0.1)] * 7))["test"]
    assert r["threshold_free"] == {"auroc": 1.0, "auprc": 1.0}
    assert r["threshold_based"]["accuracy"] == r["threshold_based"]["f1"] == 1.0
    assert (r["n_samples"], r["n_positive"], r["n_negative"]) == (10, 3, 7)
    assert r["ranking"] == {"precision@10": 0.3, "recall@10": 1.0}


def test_top_k_metrics(spark):
    pairs = [(1, 0.99), (1, 0.95), (1, 0.9), (1, 0.85), (0, 0.75)] + [(0, 0.1)] * 5
    r = report(scored(spark, pairs), k_values=(5, 10))["test"]["ranking"]
    assert r == {"precision@5": 0.8, "recall@5": 1.0, "precision@10": 0.4, "recall@10": 1.0}


def test_single_class_and_no_k_small_enough(spark):
    r = report(scored(spark, [(1, 0.9)] * 4))["test"]
    assert r["threshold_free"] == {"auroc": None, "auprc": None} and r["ranking"] == {}


def slow_auroc(pairs):
    pos = [s for y, s in pairs if y]
    neg = [s for y, s in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def slow_auprc(pairs):
    total = sum(y for y, _ in pairs)
    area = 0.0
    for cut in {s for _, s in pairs}:
        chosen = [y for y, s in pairs if s >= cut]
        here = sum(y for y, s in pairs if s == cut)
        area += here / total * sum(chosen) / len(chosen)
    return area


@pytest.mark.parametrize("ranges, rows", [(1, 10_000), (17, 10_000), (300, 10_000), (3, 5)])
def test_curves_do_not_depend_on_the_ranges(spark, ranges, rows):
    rng = random.Random(3)
    # A third of the rows share one score; the rest cluster near zero.
    splits = {
        name: [(rng.randint(0, 1), 0.25 if i % 3 == 0 else round(rng.random() ** 6, 5)) for i in range(n)]
        for name, n in (("val", 150), ("test", 231))
    }
    df = scored(spark, splits["val"], "val").union(scored(spark, splits["test"], "test"))
    with_batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        got = metrics.curves(metrics.held_groups(df, ranges)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", with_batches)
    assert len(got) == 2
    for r in got:
        assert r["auroc"] == pytest.approx(slow_auroc(splits[r["split"]]), abs=1e-12)
        assert r["auprc"] == pytest.approx(slow_auprc(splits[r["split"]]), abs=1e-12)
        assert 0.3 < r["auroc"] < 0.7


def test_groups_move_once_for_the_curves(spark):
    groups = metrics.held_groups(scored(spark, [(i % 2, i / 50) for i in range(50)]))
    text = metrics.running_counts(groups)._jdf.queryExecution().executedPlan().toString()
    kept, _, totals = text.partition("BroadcastExchange")
    assert "BroadcastHashJoin" in kept and "Exchange" not in kept and "Exchange" in totals


def test_curves_of_nothing(spark):
    empty = scored(spark, [(1, 0.5)]).limit(0)
    assert metrics.curves(metrics.held_groups(empty)).collect() == []


def test_compare_has_one_row_per_split(spark):
    df = scored(spark, [(1, 0.9), (0, 0.2)], "train").union(scored(spark, [(1, 0.1), (0, 0.6)], "test"))
    got = {r["split"]: r for r in metrics.compare(metrics.held_groups(df)).collect()}
    assert got["train"]["auroc"] == 1.0 and got["test"]["auroc"] == 0.0
    assert got["test"]["f1"] == 0.0 and got["test"]["n_samples"] == 2


def test_threshold_is_inclusive(spark):
    df = spark.createDataFrame([(0.5,), (0.4999,)], "p double")
    assert [r[0] for r in df.select(metrics.threshold_class(F.col("p"))).collect()] == [1, 0]


def test_split_sizes():
    assert split_sizes({0: 58, 1: 341}) == {0: (58, 9, 9), 1: (341, 51, 51)}
    assert split_sizes({0: 8, 1: 8}, 0.25, 0.25) == {0: (8, 2, 2), 1: (8, 2, 2)}
    with pytest.raises(ValueError):
        split_sizes({0: 1, 1: 50})


@pytest.mark.parametrize("partitions", [1, 7])
def test_split_is_exact_disjoint_and_stable(spark, partitions):
    rows = spark.range(1000).select("id", (F.col("id") % 10 < 3).cast("int").alias("label")).repartition(partitions)
    got = {r["id"]: r["split"] for r in stratified_split(rows, key="id").collect()}
    want = {r["id"]: r["split"] for r in stratified_split(rows.coalesce(2), key="id").collect()}
    assert got == want and len(got) == 1000
    counts = {s: list(got.values()).count(s) for s in ("train", "val", "test")}
    assert counts == {"train": 700, "val": 150, "test": 150}
    assert sum(1 for k, s in got.items() if s == "test" and k % 10 < 3) == 45
    other = {r["id"]: r["split"] for r in stratified_split(rows, key="id", seed=7).collect()}
    assert other != got


def test_group_split_keeps_groups_together(spark):
    rows = spark.range(600).select("id", (F.col("id") % 60).alias("g"), (F.col("id") % 2).cast("int").alias("label"))
    got = stratified_split(rows, key="id", group_key="g")
    assert got.groupBy("g").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    assert {r["split"]: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 420, "val": 90, "test": 90}


def test_group_split_meets_sizes_beside_a_hot_group(spark):
    """One group holds a third of the rows, the others have many sizes."""
    rng = random.Random(6)
    sizes = [500] + [rng.choice([1, 2, 3, 5, 8, 40]) for _ in range(120)]
    rows = [(f"g{g}", k, "x") for g, n in enumerate(sizes) for k in range(n)]
    total = len(rows)
    results = set()
    for partitions in (1, 6):
        df = spark.createDataFrame(rows, "g string, k int, part string").repartition(partitions)
        got = grouped_split(df, "g").collect()
        where = {}
        for r in got:
            where.setdefault(r["g"], set()).add(r["split"])
        assert len(got) == total and all(len(v) == 1 for v in where.values()) and where["g0"] == {"train"}
        n = [sum(r["split"] == s for r in got) for s in ("test", "val")]
        n_test = math.ceil(0.15 * total)
        assert n == [n_test, math.ceil(0.15 / (1 - 0.15) * (total - n_test))]
        results.add(tuple(sorted((g, *v) for g, v in where.items())))
    assert len(results) == 1
    # Within a size, the groups of least hash are test, the next val: checked against a plain sort.
    order = {}
    for g, n in enumerate(sizes):
        order.setdefault(n, []).append((hashlib.md5(f"42:g{g}".encode()).hexdigest(), f"g{g}"))
    for n, (_, test, val) in group_seats({n: len(v) for n, v in order.items()}).items():
        names = [g for _, g in sorted(order[n])]
        assert [where[g] for g in names] == [{"test"}] * test + [{"val"}] * val + [{"train"}] * (len(names) - test - val)


def test_dealt_groups_come_near():
    assert deal_groups({1: 10}, 3) == {1: 3} and deal_groups({7: 1, 2: 1}, 6) == {7: 0, 2: 1} and deal_groups({}, 0) == {}
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 9) for _ in range(rng.randint(1, 8))}
        wanted = rng.randint(0, sum(a * b for a, b in counts.items()))
        got = deal_groups(counts, wanted)
        missing = wanted - sum(a * b for a, b in got.items())
        assert all(0 <= got[a] <= counts[a] for a in counts)
        assert missing >= 0 and all(a > missing for a in counts if got[a] < counts[a])


def test_group_split_without_groups(spark):
    empty = spark.createDataFrame([], "g string, split string")
    assert grouped_split(empty.drop("split"), "g").count() == 0
    with pytest.raises(ValueError, match="group"):
        grouped_split(spark.createDataFrame([("a",), (None,)], "g string"), "g")
    assert [r["split"] for r in grouped_split(spark.createDataFrame([("a",)] * 3, "g string"), "g").collect()] == ["train"] * 3


def test_overlap_counts_contents(spark):
    rows = spark.createDataFrame([(1, "train"), (1, "val"), (2, "val"), (2, "test"), (2, "train"), (3, "test")], "x int, split string")
    got = {(r["split_a"], r["split_b"]): r["overlap"] for r in split_overlap(rows, ["x"]).collect()}
    assert got == {("train", "val"): 2, ("train", "test"): 1, ("val", "test"): 1}


@pytest.fixture
def world(spark, root):
    """10 compounds, 4 proteins, every pair; the label follows the first elements."""
    compounds = spark.createDataFrame([(f"c{i}", "chem", f"C{i}", "C") for i in range(10)], "id string, source string, external_id string, smiles string")
    proteins = spark.createDataFrame([(f"p{j}", "uni", f"P{j}", "M") for j in range(4)], "id string, source string, external_id string, sequence string")
    pairs = [("lab", f"I{i}-{j}", f"c{i}", f"p{j}", (i + j) % 2) for i in range(10) for j in range(4)]
    interactions = spark.createDataFrame(pairs, "source string, external_id string, compound_id string, protein_id string, label int")
    store = FeatureStore(spark, f"{root}/features")
    vector = "external_id string, source string, vector array<double>"
    store.save("compound", "fp_v1", spark.createDataFrame([(f"C{i}", "chem", [float(i % 2), i / 10]) for i in range(10)], vector), {"type": "test"})
    store.save("protein", "emb_v1", spark.createDataFrame([(f"P{j}", "uni", [float(j % 2), j / 4]) for j in range(4)], vector), {"type": "test", "dim": 2})
    return store, interactions, compounds, proteins


PARAMS = {"maxIter": 3, "maxDepth": 3, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}


def test_build_counts_and_dimensions(spark, world):
    built = TrainingData(*world, test_size=0.25, val_size=0.25).build("fp_v1", "emb_v1")
    meta = built["metadata"]
    assert (meta["total_samples"], meta["train_samples"], meta["val_samples"], meta["test_samples"]) == (40, 20, 10, 10)
    assert meta["feature_dim"] == 4 and meta["label_distribution"] == {"0": 20, "1": 20}
    assert built["rows"].select("key").distinct().count() == 40
    row = built["rows"].filter("key = 'lab:I3-2'").first()
    assert (row["fp"], row["emb"], row["label"]) == ([1.0, 0.3], [0.0, 0.5], 1)


def test_build_without_matches(spark, world):
    store, interactions, compounds, proteins = world
    assert TrainingData(store, interactions.limit(0), compounds, proteins).build("fp_v1", "emb_v1") == {"rows": None, "metadata": {}}
    strangers = compounds.withColumn("source", F.lit("elsewhere"))
    data = TrainingData(store, interactions, strangers, proteins)
    assert data.build("fp_v1", "emb_v1")["rows"] is None
    with pytest.raises(ValueError, match="no training data"):
        Training(data, "file:/tmp/unused", compound_version="fp_v1", protein_version="emb_v1").run()


def test_training_run_publishes_model_and_report(spark, root, world):
    run = Training(TrainingData(*world), root, "v7", PARAMS, compound_version="fp_v1", protein_version="emb_v1").run(k_values=(2, 5))
    assert set(run["evaluation"]["comparison"]) == {"val", "test"}
    assert read_json(spark, run["report_path"])["detailed_reports"][0]["ranking"]
    folder = f"{root}/models/boosted_trees/v7"
    loaded = BoostedTrees().load(spark, folder)
    assert loaded.params["maxIter"] == 3 and loaded.params["stepSize"] == 0.1 and loaded.feature_version == "v7"
    # The saved trees, scored inside tasks, agree with the model's own predictions.
    store, interactions, compounds, proteins = world
    rows = TrainingData(store, interactions, compounds, proteins).build("fp_v1", "emb_v1")["rows"]
    want = {r["key"]: r["probability"] for r in loaded.predict(rows).collect()}
    assert all(0 <= p <= 1 for p in want.values())
    queries = store.load("compound", "fp_v1").select(F.col("external_id").alias("query_id"), "vector")
    scorer = scoring_strategy("learned", loaded.trees(spark, folder))
    from pairrank.operators.topk import nearest

    for how in ({}, {"query_block": 3, "candidate_block": 2}):
        found = nearest(queries, store.load("protein", "emb_v1"), scorer, top_k=4, **how).collect()
        assert len(found) == 40
        for r in found:
            key = f"lab:I{r['query_id'][1:]}-{r['external_id'][1:]}"
            assert r["score"] == pytest.approx(want[key], abs=1e-6)


def test_sparse_bits_and_dense_vectors_train_alike(spark):
    rng = random.Random(42)
    rows = []
    for i in range(50):
        bits = [b for b in range(4) if rng.random() < 0.5]
        rows.append((i, int(0 in bits), bits, [rng.random() for _ in range(3)]))
    df = spark.createDataFrame(rows, "key int, label int, fp array<int>, emb array<double>")
    dense = df.withColumn("fp", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda b: F.array_contains("fp", b).cast("double")))
    probabilities = []
    for data, n_bits in ((df, 4), (dense, None)):
        model = BoostedTrees(PARAMS, n_bits=n_bits)
        with pytest.raises(RuntimeError):
            model.predict(data)
        model.train(data)
        got = model.predict(data)
        assert {"prediction", "probability"} <= set(got.columns)
        assert got.filter((F.col("probability") >= 0.5).cast("int") != F.col("prediction")).count() == 0
        assert got.filter(F.col("prediction") != F.col("label")).count() == 0
        probabilities.append({r["key"]: r["probability"] for r in got.collect()})
    assert probabilities[0] == pytest.approx(probabilities[1])


def test_clashing_feature_columns_get_suffixes(spark):
    c = spark.createDataFrame([("C", "s", 1, [1])], "external_id string, source string, n int, fp array<int>")
    p = spark.createDataFrame([("P", "s", 2, [1.0])], "external_id string, source string, n int, emb array<double>")
    i = spark.createDataFrame([("C", "s", "P", "s", 1)], "compound_external_id string, compound_source string, protein_external_id string, protein_source string, label int")
    row = keyed.merge_features(i, c, p).first()
    assert (row["n_compound"], row["n_protein"], row["label"]) == (1, 2, 1)


def test_hot_parent_is_split_by_adaptive_execution(spark):
    """Two thirds of the interactions name one compound: the join's plan must let AQE split it."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 60_000, 1, 8).select(
            F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 500).alias("compound_id"),
            (F.col("id") % 50).alias("protein_id"), F.lit(1).alias("label"), F.sha2(F.col("id").cast("string"), 256).alias("external_id"),
        )
        parents = spark.range(500).select("id", F.col("id").cast("string").alias("external_id"), F.lit("s").alias("source"))
        got = keyed.interaction_keys(rows, parents, parents.filter("id < 50"))
        assert got.count() == 60_000
        got.collect()
        assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_learned_ranking_from_the_store(spark, root):
    from pairrank.plans.featurize import Featurization, KmerEmbedding, QGramFingerprint

    compounds = spark.createDataFrame([(f"c{i}", "chem", f"C{i}", "C" * (i % 5 + 4) + "O" * (i % 3)) for i in range(12)], "id string, source string, external_id string, smiles string")
    proteins = spark.createDataFrame([(f"p{j}", "uni", f"P{j}", "MKWV" * (j + 1) + "GG" * j) for j in range(5)], "id string, source string, external_id string, sequence string")
    pairs = [("lab", f"I{i}-{j}", f"c{i}", f"p{j}", (i + j) % 2) for i in range(12) for j in range(5)]
    interactions = spark.createDataFrame(pairs, "source string, external_id string, compound_id string, protein_id string, label int")
    store = FeatureStore(spark, f"{root}/features")
    fingerprint, embedding = QGramFingerprint(n_bits=32), KmerEmbedding(dim=16)
    Featurization(store, compounds, proteins, fingerprint, embedding).run("v1")
    run = Training(TrainingData(store, interactions, compounds, proteins), root, "v1", {"maxIter": 2, "maxDepth": 2}).run()
    assert run["training_metadata"]["feature_dim"] == 48
    folder = f"{root}/models/boosted_trees/v1"
    model = BoostedTrees().load(spark, folder)
    scorer = scoring_strategy("learned", model.trees(spark, folder), n_bits=32)
    search = Inference(store, scorer, compound_featurizer=fingerprint, protein_featurizer=embedding)
    got = search.rank_one("CCCCCO", 3)
    assert [r["rank"] for r in got] == [1, 2, 3] and got[0]["score"] >= got[1]["score"] >= got[2]["score"]
    queries = spark.createDataFrame([(1, "CCCCO"), (2, "CC(")], "query_id int, query string")
    table = search.rank(queries).collect()
    assert {(r["query_id"], r["model_version"]) for r in table} == {(1, "v1")} and len(table) == 5
