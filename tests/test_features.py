import hashlib

import pytest
from pyspark.sql import functions as F

from pairrank.functions import text, vectors
from pairrank.operators.aggregates import histogram, mean_pool
from pairrank.plans.featurize import Featurization, Featurizer, KmerEmbedding, ModelEmbedding, QGramFingerprint
from pairrank.sources.feature_store import FeatureStore

ASPIRIN, CAFFEINE, ETHANOL = "CC(=O)Oc1ccccc1C(=O)O", "CN1C=NC2=C1C(=O)N(C(=O)N2C)C", "CCO"
P01308 = "MALWMRLLPLLALLALWGPDPAAAFVNQHLCGSHLVEALYLVCGERGFFYTPKT"
P0CG48 = "MQIFVKTLTGKTITLEVEPSDTIENVKAKIQDKEGIPPDQQRLIFAGKQLEDGR"


def bucket(gram, n):
    return int(hashlib.md5(gram.encode()).hexdigest()[:8], 16) % n


def grams(value, q):
    return [value[i:i + q] for i in range(len(value) - q + 1)]


@pytest.fixture
def compounds(spark):
    rows = [("A", "s", ASPIRIN), ("C", "s", CAFFEINE), ("E", "s", ETHANOL)]
    return spark.createDataFrame(rows, "external_id string, source string, smiles string")


@pytest.fixture
def proteins(spark):
    rows = [("P01308", "u", P01308), ("P0CG48", "u", P0CG48)]
    return spark.createDataFrame(rows, "external_id string, source string, sequence string")


def test_fingerprint_values(compounds):
    got = {r["external_id"]: r["vector"] for r in QGramFingerprint().transform(compounds).collect()}
    for key, smiles in (("A", ASPIRIN), ("C", CAFFEINE), ("E", ETHANOL)):
        assert got[key] == sorted({bucket(g, 2048) for g in grams(smiles, 4)})
    assert got["E"] == []
    again = {r["external_id"]: r["vector"] for r in QGramFingerprint().transform(compounds.repartition(3)).collect()}
    assert again == got


def test_bad_structures_are_dropped(spark):
    rows = [("GOOD", "s", "CCO"), ("BAD", "s", "NOT_A_REAL_SMILES_XYZ"), ("OPEN", "s", "CC(=O"), ("BACK", "s", "C)O("),
            ("NONE", "s", None), ("ALSO_GOOD", "s", "C[C@H](N)C(=O)O")]
    df = spark.createDataFrame(rows, "external_id string, source string, smiles string")
    kept = [r["external_id"] for r in QGramFingerprint().transform(df).collect()]
    assert sorted(kept) == ["ALSO_GOOD", "GOOD"]


@pytest.mark.parametrize("chunk", [1 << 21, 7, 64])
def test_texts_longer_than_a_chunk(spark, monkeypatch, chunk):
    monkeypatch.setattr(text, "CHUNK_CHARS", chunk)
    values = ["", "ab", None, "héé wörld " * 9, "x" * 50, "日本語テキスト𝄞𝄞abc" * 5, "abcabcabc"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    got = df.select("i", text.qgram_bits(F.col("t"), 64, 3).alias("b"), text.kmer_frequencies(F.col("t"), 16, 3).alias("f")).collect()
    for row in got:
        all_grams = grams(values[row["i"]] or "", 3)
        assert row["b"] == sorted({bucket(g, 64) for g in all_grams})
        want = [0.0] * 16
        for g in all_grams:
            want[bucket(g, 16)] += 1 / len(all_grams)
        assert row["f"] == pytest.approx(want)


def test_gram_codes_survive_a_wide_alphabet(spark):
    value = "".join(chr(0x4E00 + i) for i in range(20_000)) + "".join(chr(0xAC00 + i) for i in range(11_000))
    df = spark.createDataFrame([(value,)], "t string")
    got = df.select(text.qgram_bits(F.col("t"), 512, 6).alias("b")).first()["b"]
    assert got == sorted({bucket(g, 512) for g in grams(value, 6)})


def test_parameters_are_checked():
    for bad in ({"n_bits": 0}, {"q": 0}):
        with pytest.raises(ValueError):
            QGramFingerprint(**bad)
    with pytest.raises(ValueError):
        KmerEmbedding(dim=0)
    assert QGramFingerprint().feature_manifest()["n_bits"] == 2048


def test_embedding_properties(proteins):
    got = {r["external_id"]: r["vector"] for r in KmerEmbedding().transform(proteins).collect()}
    assert all(len(v) == 320 and sum(v) == pytest.approx(1) for v in got.values())
    assert got["P01308"] != got["P0CG48"]
    assert any(x not in (0.0, 1.0) for x in got["P01308"])
    cut = KmerEmbedding(max_length=10).transform(proteins).first()["vector"]
    assert sum(1 for x in cut if x) <= 8


def test_store_round_trip(spark, root):
    store = FeatureStore(spark, root)
    df = spark.createDataFrame([(1, 0.5), (2, 1.5)], "id int, value double")
    uri = store.save("compound", "v1", df, {"param": "value"})
    assert uri.endswith("compound/v1/features.parquet")
    assert sorted(map(tuple, store.load("compound", "v1").collect())) == [(1, 0.5), (2, 1.5)]
    assert store.load_manifest("compound", "v1") == {"param": "value", "row_count": 2}
    store.save("compound", "v1", df.limit(1), {})
    assert store.load("compound", "v1").count() == 1
    with pytest.raises(Exception, match="v9"):
        store.load("compound", "v9")


def test_store_refuses_nan(spark, root):
    df = spark.createDataFrame([("a", "s", [1.0, float("nan")])], "external_id string, source string, vector array<double>")
    with pytest.raises(Exception, match="not finite"):
        FeatureStore(spark, root).save("protein", "v1", df, {})


def test_featurization_run(spark, root, compounds, proteins):
    bad = spark.createDataFrame([("BAD", "s", "no good")], compounds.schema)
    store = FeatureStore(spark, root)
    summary = Featurization(store, compounds.union(bad), proteins).run("v1")
    assert summary["compounds"]["count"] == 3 and summary["compounds"]["total"] == 4
    assert summary["proteins"]["count"] == 2
    manifest = store.load_manifest("compound", "qgram_v1")
    assert manifest["row_count"] == 3 and manifest["n_bits"] == 2048
    assert store.load("protein", "kmer_v1").count() == 2


def test_featurization_of_empty_tables_saves_nothing(spark, tmp_path, root, compounds, proteins):
    store = FeatureStore(spark, f"{root}/store")
    run = Featurization(store, compounds.limit(0), proteins.limit(0)).run()
    assert run["compounds"] == {"count": 0, "total": 0, "uri": None} == run["proteins"]
    assert not (tmp_path / "store").exists()


def test_own_featurizer_plugs_in(spark, root, compounds, proteins):
    class Letters(Featurizer):
        text = "sequence"

        def transform(self, df):
            return df.select("external_id", "source", F.array(F.length("sequence").cast("double")).alias("vector"))

        def feature_manifest(self):
            return {"type": "letters", "dim": 1}

    store = FeatureStore(spark, root)
    Featurization(store, compounds, proteins, protein_featurizer=Letters()).featurize_proteins("v2")
    assert [r["vector"] for r in store.load("protein", "letters_v2").collect()] == [[54.0], [54.0]]


def test_model_plug_in_loads_once_per_task(spark, proteins):
    def load():
        return {"calls": 0}

    def embed(model, texts):
        model["calls"] += 1
        return [[len(t), model["calls"]] for t in texts]

    rows = spark.createDataFrame([(str(i), "u", "M" * (i + 1)) for i in range(20)], proteins.schema).coalesce(1)
    got = ModelEmbedding("letters", 2, load, embed, batch_size=8, max_length=15).transform(rows).collect()
    assert [r["vector"] for r in got] == [[min(i + 1, 15), i // 8 + 1] for i in range(20)]
    bad = ModelEmbedding("letters", 3, load, embed)
    with pytest.raises(Exception, match="3 numbers"):
        bad.transform(rows).collect()


def test_vector_expressions(spark):
    df = spark.createDataFrame(
        [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 1.0], [0.0, 0.0])],
        "a array<double>, b array<double>",
    )
    assert [r[0] for r in df.select(vectors.cosine("a", "b")).collect()] == [1.0, 0.0, 0.0, 0.0]
    ones = spark.createDataFrame([([1.0] * 300, [1.0] * 300)], "a array<double>, b array<double>")
    assert ones.select(vectors.dot("a", "b")).first()[0] == 300
    uneven = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="differ in length"):
        uneven.select(vectors.dot("a", "b")).collect()
    wide = df.select(*vectors.unpack("a", "emb_", 2), F.lit(1).alias("label"))
    assert vectors.feature_columns(wide) == ["emb_0", "emb_1"]


def test_mean_pool_uses_the_mask(spark):
    rows = [("x", [1.0, 2.0], 1), ("x", [3.0, 6.0], 1), ("x", [100.0, 100.0], 0), ("y", [1.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "g string, v array<double>, m int")
    got = {r["g"]: r["pooled"] for r in mean_pool(df, ["g"], "v", "m").collect()}
    assert set(got) == {"x"} and got["x"] == pytest.approx([2.0, 4.0])


def test_histogram_is_cumulative(spark):
    df = spark.createDataFrame([("a", 0.05), ("a", 0.1), ("a", 7.0), ("a", 9999.0)], "s string, v double")
    got = {r["le"]: r["bucket_count"] for r in histogram(df, ["s"], "v").collect()}
    assert (got["0.1"], got["5"], got["10"], got["600"], got["+Inf"]) == (2, 2, 3, 3, 4)
