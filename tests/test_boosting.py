import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from pairrank.operators import boosting
from pairrank.operators.boosting import OPTIONS, Boosting
from pairrank.plans.models import BoostedTrees, mllib_trees
from pairrank.session import shared_dir
from pairrank.sources.feature_store import write_json

BITS = 12
ALL = {"maxIter": 3, "maxDepth": 3, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}
DRAWN = {**ALL, "subsamplingRate": 0.7, "featureSubsetStrategy": "0.6"}


@pytest.fixture(scope="module")
def pairs():
    """Bits, few distinct values, many distinct values, a constant."""
    rng = random.Random(5)
    rows = []
    for i in range(600):
        bits = [b for b in range(BITS) if rng.random() < 0.4]
        emb = [round(rng.random(), 1), rng.random() ** 3, rng.gauss(0, 1), 1.0]
        rows.append((i, int((3 in bits) + emb[0] + emb[2] / 2 + rng.gauss(0, 0.5) > 1.2), bits, emb))
    return rows


@pytest.fixture(autouse=True)
def nothing_held(spark):
    """MLlib's trees, trained here to compare, leave RDDs in memory until they are collected."""
    yield
    for rdd in spark.sparkContext._jsc.getPersistentRDDs().values():
        rdd.unpersist()


def frame(spark, rows, partitions=3):
    return spark.createDataFrame(rows, "key int, label int, fp array<int>, emb array<double>").repartition(partitions)


def probabilities(model, df):
    return {r["key"]: r["probability"] for r in model.predict(df).collect()}


def trained(df, params, n_bits=BITS):
    model = BoostedTrees(params, n_bits=n_bits)
    model.train(df)
    return model


def test_trees_are_those_of_mllib_where_nothing_is_drawn(spark, root, pairs):
    df = frame(spark, pairs)
    rows = [(k, float(y), Vectors.dense([float(b in bits) for b in range(BITS)] + emb)) for k, y, bits, emb in pairs]
    vectors = spark.createDataFrame(rows, ["key", "label", "features"]).coalesce(1)
    for params in (ALL, {**ALL, "maxDepth": 4, "minInstancesPerNode": 30, "maxBins": 7}):
        model = trained(df, params)
        gbt = GBTClassifier(labelCol="label", featuresCol="features", **model.params).fit(vectors)
        found = gbt.transform(vectors).select("key", vector_to_array("probability")[1].alias("p")).collect()
        want = {r["key"]: r["p"] for r in found}
        assert probabilities(model, df) == pytest.approx(want, abs=1e-6)
    # What MLlib saved before is still read.
    PipelineModel([gbt]).write().overwrite().save(f"{root}/model")
    assert mllib_trees(spark, f"{root}/model").n_features == BITS + 4
    signature = model.model_signature()
    del signature["trees"]
    write_json(spark, f"{root}/signature.json", signature)
    assert probabilities(BoostedTrees().load(spark, root), df) == pytest.approx(want, abs=1e-12)


def test_trees_do_not_depend_on_partitions(spark, pairs):
    """Draws hang on the key and sums are whole numbers: not one digit may differ."""
    got = [probabilities(trained(frame(spark, pairs, n), DRAWN), frame(spark, pairs)) for n in (1, 5)]
    assert got[0] == got[1]
    assert got[0] != probabilities(trained(frame(spark, pairs), {**DRAWN, "seed": 7}), frame(spark, pairs))


def test_parts_give_the_trees_of_the_whole(spark, pairs, monkeypatch):
    """Margins written anew, few nodes a pass, small blocks and chunks of rows."""
    df, params = frame(spark, pairs), {**DRAWN, "maxIter": 5}
    want = trained(df, params)._fitted()
    for name, value in (("REPLAYED", 2), ("CELLS", 1), ("BLOCK", 100), ("ROWS", 64)):
        monkeypatch.setattr(boosting, name, value)
    got = trained(df, params)._fitted()
    for name in ("roots", "weights", "feature", "threshold", "left", "right", "value"):
        assert np.array_equal(getattr(got, name), getattr(want, name)), name


@pytest.mark.parametrize("chunks", [{}, {"REPLAYED": 2, "CELLS": 1, "BLOCK": 100, "ROWS": 64}])
def test_listed_on_bits_give_the_trees_of_packed_ones(spark, pairs, monkeypatch, chunks):
    """Few of many positions are listed: repeated, unknown and no positions, and what is written anew."""
    rows = [(k, y, [*(37 * b for b in bits if k % 5), *bits, 900, *bits[:1]], emb) for k, y, bits, emb in pairs]
    df, params, layouts = frame(spark, rows), {**DRAWN, "maxIter": 5}, []
    for name, value in chunks.items():
        monkeypatch.setattr(boosting, name, value)
    layout = Boosting._layout
    monkeypatch.setattr(Boosting, "_layout", lambda self, df: layouts.append(layout(self, df)) or layouts[-1])
    got = trained(df, params, 600)._fitted()
    assert layouts[0].listed and (layouts[0].head, layouts[0].width) == (0, 4)
    monkeypatch.setattr(Boosting, "_layout", lambda self, df: boosting._Layout(600, layout(self, df).cuts))
    want = trained(df, params, 600)._fitted()
    for name in ("roots", "weights", "feature", "threshold", "left", "right", "value"):
        assert np.array_equal(getattr(got, name), getattr(want, name)), name
    assert ((0 < got.feature) & (got.feature < 600)).any()


def test_training_keeps_bytes_not_doubles(spark):
    """20,000 rows of 64 bits and 64 numbers, no two alike: MLlib held about a kilobyte of each in memory."""
    rows = spark.range(0, 20_000, 1, 4).select(
        F.col("id").alias("key"), (F.col("id") % 2).cast("int").alias("label"),
        F.expr("filter(sequence(0, 63), b -> pmod(xxhash64(id, b), 5) = 0)").alias("fp"),
        F.expr("transform(sequence(1, 64), d -> pmod(xxhash64(id, d), 1000003) / 1000003D)").alias("emb"),
    )
    folder = Path(shared_dir(spark).removeprefix("file:")) / "boosting"
    before = set(folder.glob("*"))
    trained(rows, {"maxIter": 1, "maxDepth": 1}, 64)
    (held,) = set(folder.glob("*")) - before
    size = sum(f.stat().st_size for f in held.rglob("*.parquet"))
    assert 20_000 * 64 * 5 // 8 < size < 20_000 * 100
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_cuts_lie_between_values():
    assert boosting._cuts(np.array([2.0, 1, 2, 4]), 32).tolist() == [1.5, 3]
    assert boosting._cuts(np.ones(5), 32).tolist() == []
    cuts = boosting._cuts(np.arange(1000.0), 4)
    assert cuts.tolist() == [249.5, 499.5, 749.5]
    # Half of the rows share one value: it takes more than one share.
    assert boosting._cuts(np.r_[np.zeros(500), np.arange(1, 501.0)], 4).tolist() == [0.5, 250.5]


@pytest.mark.parametrize("row, why", [
    ((1, 1, None, [0.5]), "without a vector"), ((1, 1, [1], None), "without a vector"), ((1, 2, [1], [0.5]), "0 or 1"),
    ((1, None, [1], [0.5]), "0 or 1"), ((1, 1, [1], [float("nan")]), "finite"), ((1, 1, [1], [0.5, 0.5]), "unequal width"),
])
def test_rows_that_cannot_be_trained_on(spark, row, why):
    rows = [(0, 0, [0], [0.1]), row]
    with pytest.raises(Exception, match=why):
        trained(frame(spark, rows, 1), ALL)


def test_edges_of_the_training_table(spark, pairs):
    with pytest.raises(ValueError, match="no rows"):
        trained(frame(spark, pairs).limit(0), ALL)
    with pytest.raises(ValueError, match="unknown parameters"):
        Boosting({"weightCol": "w"}, BITS)
    assert set(OPTIONS) >= set(BoostedTrees().params)
    # One class, no key, null and repeated keys, bits outside the fingerprint.
    single = frame(spark, [(k, 1, [*bits, 99], emb) for k, _, bits, emb in pairs[:50]])
    assert set(map(round, probabilities(trained(single, DRAWN), single).values())) == {1}
    keyless = frame(spark, [(None if k % 2 else 7, y, bits, emb) for k, y, bits, emb in pairs])
    for df in (keyless, keyless.drop("key")):
        scored = trained(df, DRAWN).predict(df)
        assert scored.count() == len(pairs) and scored.filter("probability between 0 and 1").count() == len(pairs)


def test_only_asked_features_are_laid_out(pairs):
    trees = boosting.Trees(
        n_features=BITS + 4, roots=np.array([0]), weights=np.array([1.0]), feature=np.array([3, 0, BITS + 2, 0, 0]),
        threshold=np.array([0.5, np.inf, 0.0, np.inf, np.inf]), left=np.array([1, 1, 3, 3, 4]), right=np.array([2, 1, 4, 3, 4]),
        value=np.array([0.0, 1, 0, 2, 3]), depth=2,
    )
    fp, emb = pa.array([r[2] for r in pairs]), pa.array([r[3] for r in pairs])
    whole = np.array([[float(b in r[2]) for b in range(BITS)] + r[3] for r in pairs])
    assert np.array_equal(trees.pair_probability(fp, emb, BITS), trees.probability(whole))
    with pytest.raises(ValueError, match="features"):
        trees.pair_probability(fp, emb, BITS + 1)
