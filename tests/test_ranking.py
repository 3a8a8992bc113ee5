import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairrank.operators import postings as postings_module
from pairrank.operators import topk as topk_module
from pairrank.operators.records import check_queries
from pairrank.operators.topk import Scorer, SearchReport, concat_with_query, nearest, top_k_rows
from pairrank.plans.featurize import Featurization, KmerEmbedding, QGramFingerprint
from pairrank.plans.inference import Inference
from pairrank.plans.models import scoring_strategy
from pairrank.sources.feature_store import FeatureStore

VECTORS = "source string, external_id string, vector array<double>"


def candidates(spark, vectors, source="s"):
    return spark.createDataFrame([(source, key, v) for key, v in vectors], VECTORS)


def ask(spark, *vectors):
    return spark.createDataFrame(list(enumerate(vectors)), "query_id int, vector array<double>")


def rows(found):
    return [(r["rank"], r["external_id"], r["score"]) for r in found.orderBy("query_id", "rank").collect()]


# The small vectors of the next three tests and the scores they must give.


def test_dot_scores(spark):
    stored = candidates(spark, [("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0]), ("c", [0.5, 0.5, 0.0])])
    found = nearest(ask(spark, [1.0, 0.0, 0.0]), stored, scoring_strategy("similarity"))
    assert rows(found) == [(1, "a", 1.0), (2, "c", 0.5), (3, "b", 0.0)]


def test_cosine_of_zero_vectors(spark):
    stored = candidates(spark, [("P1", [2.0, 0.0]), ("P2", [0.0, 1.0]), ("P0", [0.0, 0.0])])
    found = nearest(ask(spark, [1.0, 0.0], [0.0, 0.0]), stored, Scorer("cosine"))
    assert rows(found) == [(1, "P1", 1.0), (2, "P0", 0.0), (3, "P2", 0.0)] + [
        (i, p, 0.0) for i, p in enumerate(["P0", "P1", "P2"], 1)
    ]


def test_binary_cosine_of_bits(spark):
    stored = spark.createDataFrame([("s", "C1", [0, 1]), ("s", "C2", [2, 3])], "source string, external_id string, vector array<int>")
    query = spark.createDataFrame([(0, [0, 1])], "query_id int, vector array<int>")
    assert rows(nearest(query, stored, Scorer("binary_cosine", n_bits=4))) == [(1, "C1", 1.0), (2, "C2", 0.0)]


def brute_force(queries, stored, k):
    out = {}
    for qid, q in queries:
        scored = []
        for source, key, c in stored:
            score = float(np.dot(q, c)) / ((np.linalg.norm(q) or 1.0) * (np.linalg.norm(c) or 1.0))
            score = math.copysign(math.floor(abs(score) * 1e6 + 0.5 + 1e-6) / 1e6, score)
            scored.append((-score, source, key))
        out[qid] = [(i + 1, key, source, -s) for i, (s, source, key) in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("how", [{}, {"query_block": 3, "candidate_block": 40}, {"max_broadcast_bytes": 1}])
@pytest.mark.parametrize("partitions", [1, 5])
def test_both_ways_match_brute_force_with_ties(spark, how, partitions):
    rng = random.Random(5)
    vector = lambda: [float(rng.randint(-1, 1)) for _ in range(4)]
    queries = [(i, vector()) for i in range(9)]
    # A third of the candidates are copies of one vector: the ties are decided by key.
    stored = [(f"s{i % 3}", str(i), vector() if i % 3 else [1.0, 1.0, 0.0, 0.0]) for i in range(300)]
    found = nearest(
        spark.createDataFrame(queries, "query_id int, vector array<double>"),
        spark.createDataFrame(stored, VECTORS).repartition(partitions),
        Scorer("cosine"), top_k=7, **how,
    )
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["external_id"], r["source"], r["score"] + 0.0))
    want = brute_force(queries, stored, 7)
    assert got == {q: [(a, b, c, d + 0.0) for a, b, c, d in v] for q, v in want.items()}


def test_each_query_has_its_own_k(spark):
    stored = candidates(spark, [(str(i), [float(i), 1.0]) for i in range(6)])
    queries = ask(spark, [1.0, 0.0], [1.0, 0.0]).withColumn("top_k", F.when(F.col("query_id") == 0, 2).otherwise(100))
    counts = {r["query_id"]: r["count"] for r in nearest(queries, stored, Scorer("dot")).groupBy("query_id").count().collect()}
    assert counts == {0: 2, 1: 6}


def test_no_queries_and_no_candidates(spark):
    stored = candidates(spark, [("a", [1.0])])
    assert nearest(ask(spark, [1.0]).limit(0), stored, Scorer("dot")).count() == 0
    assert nearest(ask(spark, [1.0]), stored.limit(0), Scorer("dot")).count() == 0


def test_unequal_and_broken_vectors_are_errors(spark):
    with pytest.raises(Exception, match="differ in length"):
        nearest(ask(spark, [1.0, 2.0, 3.0]), candidates(spark, [("a", [1.0, 2.0])]), Scorer("dot")).collect()
    with pytest.raises(Exception, match="NaN"):
        nearest(ask(spark, [1.0]), candidates(spark, [("a", [float("nan")])]), Scorer("dot")).collect()
    for k in (0, 501):
        with pytest.raises(ValueError):
            nearest(ask(spark, [1.0]), candidates(spark, [("a", [1.0])]), Scorer("dot"), top_k=k)
    with pytest.raises(ValueError):
        Scorer("manhattan")
    with pytest.raises(ValueError):
        scoring_strategy("psychic")


def test_pairs_are_concatenated_query_first(spark):
    query = spark.createDataFrame([([1.0, 2.0],)], "vector array<double>")
    got = concat_with_query(query, candidates(spark, [("a", [3.0, 4.0, 5.0]), ("b", [6.0, 7.0, 8.0])]))
    assert {r["external_id"]: r["pair"] for r in got.collect()} == {
        "a": [1.0, 2.0, 3.0, 4.0, 5.0], "b": [1.0, 2.0, 6.0, 7.0, 8.0]
    }
    two = query.union(query)
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        concat_with_query(two, candidates(spark, [("a", [3.0])])).collect()


def test_top_k_rows_of_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4000, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"), "id")
    got = top_k_rows(df, ["g"], [F.col("id").desc()], 3, F.col("id"))
    hot = [r["id"] for r in got.filter("g = 'hot'").orderBy("rank").collect()]
    assert hot == [3999, 3998, 3997] and got.count() == 8 * 3


def test_query_checks(spark):
    rows_ = [("ok", 10, "Protein"), ("  ", 10, "protein"), ("q", 0, "protein"), ("q", 501, "compound"), ("q", 5, "dna"), (None, 5, "protein")]
    good, bad = check_queries(spark.createDataFrame(rows_, "query string, top_k int, entity_type string"))
    assert good.count() == 1
    assert sorted(r["reason"] for r in bad.collect()) == [
        "blank query", "blank query", "top_k out of range", "top_k out of range", "unknown entity_type"
    ]


@pytest.fixture
def store(spark, root):
    compounds = spark.createDataFrame(
        [("ASPIRIN", "chem", "CC(=O)Oc1ccccc1C(=O)O"), ("CAFFEINE", "chem", "CN1C=NC2=C1C(=O)N(C(=O)N2C)C"), ("IBU", "chem", "CC(C)Cc1ccc(cc1)C(C)C(=O)O")],
        "external_id string, source string, smiles string",
    )
    proteins = spark.createDataFrame(
        [("P1", "uni", "MKWVTFISLLFLFSSAYSRG"), ("P2", "uni", "GGGGSGGGGSGGGGS"), ("P3", "uni", "MKWVTFISLLFLFAAAYSRG")],
        "external_id string, source string, sequence string",
    )
    store = FeatureStore(spark, root)
    Featurization(store, compounds, proteins).run("v1")
    return store


def test_one_query_calls(spark, store):
    search = Inference(store)
    found = search.find_similar_compounds("CC(=O)Oc1ccccc1C(=O)O", 2)
    assert [(r["rank"], r["external_id"], r["source"]) for r in found][0] == (1, "ASPIRIN", "chem") and len(found) == 2
    assert found[0]["score"] == 1.0 and found[0]["score"] > found[1]["score"]
    similar = search.find_similar_proteins("MKWVTFISLLFLFSSAYSRG", 100)
    assert [r["external_id"] for r in similar] == ["P1", "P3", "P2"]
    for call, text in ((search.find_similar_proteins, "   "), (search.find_similar_compounds, "not a structure")):
        with pytest.raises(ValueError):
            call(text)
    with pytest.raises(ValueError):
        search.find_similar_proteins("MKWV", 501)


def test_query_tables_echo_and_reject(spark, store):
    queries = spark.createDataFrame([(1, "MKWVTFISLL", 2), (2, " ", 2)], "query_id int, query string, top_k int")
    search = Inference(store)
    found = search.similar_proteins(queries).collect()
    assert {(r["query_id"], r["query"], r["top_k"], r["similarity_metric"]) for r in found} == {(1, "MKWVTFISLL", 2, "cosine")}
    assert [r["reason"] for r in search.rejected(queries, "protein").collect()] == ["blank query"]


def test_ranking_needs_one_space_or_a_model(spark, store):
    with pytest.raises(ValueError, match="learned"):
        Inference(store, scoring_strategy("similarity")).rank_one("CCO")
    with pytest.raises(ValueError, match="trained model"):
        scoring_strategy("learned")


def test_empty_store_is_an_error(spark, root, store):
    empty = FeatureStore(spark, f"{root}/empty")
    empty.save("protein", "kmer_v1", store.load("protein", "kmer_v1").limit(0), {"dim": 320})
    with pytest.raises(ValueError, match="no protein vectors"):
        Inference(empty).find_similar_proteins("MKWV")


@pytest.mark.parametrize("metric", ["cosine", "dot"])
def test_bounds_skip_blocks_and_change_nothing(spark, metric):
    """Clustered vectors of many lengths, with zeros, copies and opposite directions."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    made = [(centres[k % 12] + 0.05 * rng.normal(size=16)) * (1 + k % 5) for k in range(1500)]
    made += [np.zeros(16), np.zeros(16), -centres[0], *[centres[3]] * 40]
    stored = [(f"s{k % 3}", str(k), [float(x) for x in v]) for k, v in enumerate(made)]
    asked = [(k, [float(x) for x in made[k]]) for k in range(1200)] + [(5000, [0.0] * 16), (5001, [float(-x) for x in centres[5]])]
    queries = spark.createDataFrame(asked, "query_id int, vector array<double>")
    held = spark.createDataFrame(stored, VECTORS).repartition(3)
    results = []
    for how in ({"candidate_block": 10**6}, {"candidate_block": 20}, {"candidate_block": 20, "query_block": 800}):
        report = SearchReport()
        found = nearest(queries, held, Scorer(metric), top_k=7, report=report, **how)
        results.append(sorted(map(tuple, found.collect())))
        assert (report.pruned_share > 0.3) == (how["candidate_block"] == 20)
    assert results[0] == results[1] == results[2] and len(results[0]) == 1202 * 7
    if metric == "cosine":
        some = asked[:40] + asked[-2:]
        want = brute_force(some, stored, 7)
        assert [(r[0], r[2], r[4], r[3]) for r in results[1] if r[0] in want] == [(q, *x[:3]) for q in sorted(want) for x in want[q]]


@pytest.mark.parametrize("postings", [0, 10**6])
@pytest.mark.parametrize("how", [{}, {"query_block": 40}])
def test_bit_sets_by_inverted_index(spark, monkeypatch, postings, how):
    """Like sets, empty sets, repeated bits, copies, and queries with fewer matches than results."""
    rng = random.Random(11)
    kinds = [rng.sample(range(90), 20) for _ in range(8)]

    def bits(k):
        if k % 31 == 0:
            return []
        if k % 37 == 0:
            return [95, 95]
        return [b for b in kinds[k % 8] if rng.random() < 0.8] + rng.choices(range(90), k=3)

    stored = [(f"s{k % 3}", str(k), bits(k)) for k in range(700)] + [("s0", f"copy{k}", kinds[2]) for k in range(40)]
    asked = [(k, bits(k), 1 + k % 12) for k in range(110)] + [(500, kinds[2], 30), (501, [], 5), (502, [95], 40)]
    wanted = []
    for q, mine, k in asked:
        scored = []
        for source, key, theirs in stored:
            common = len(set(mine) & set(theirs))
            score = common / (math.sqrt(len(set(mine))) * math.sqrt(len(set(theirs)))) if common else 0.0
            scored.append((-math.floor(score * 1e6 + 0.5 + 1e-6) / 1e6, source, key))
        wanted += [(q, k, n, s, key, -score) for n, (score, s, key) in enumerate(sorted(scored)[:k], 1)]
    queries = spark.createDataFrame(asked, "query_id int, vector array<int>, top_k int")
    held = spark.createDataFrame(stored, "source string, external_id string, vector array<int>").repartition(3)
    report = SearchReport()
    found = nearest(queries, held, Scorer("binary_cosine", n_bits=96), report=report, **how)
    got = sorted((r["query_id"], r["top_k"], r["rank"], r["source"], r["external_id"], r["score"]) for r in found.collect())
    assert got == sorted((q, k, n, s, key, abs(score)) for q, k, n, s, key, score in wanted)
    assert report.pruned_share > 0
    # A task's own code, with small pieces, by products alone and by postings alone.
    monkeypatch.setattr(postings_module, "POSTINGS_PER_PAIR", postings)
    monkeypatch.setattr(postings_module, "PIECE_CELLS", 5000)
    monkeypatch.setattr(postings_module, "FIRST_ROWS", 16)
    monkeypatch.setattr(topk_module, "WAITING_ROWS", 64)
    sets = pa.array([b for _, b, _ in asked])
    place = postings_module.bit_order(sets, 96)
    words, ks = postings_module.pack(postings_module.bit_matrix(sets, place)), np.array([k for *_, k in asked])
    batch = pa.RecordBatch.from_pylist([{"source": s, "external_id": key, "vector": b} for s, key, b in stored])
    best, met, done = topk_module._rank_sets(iter([batch.slice(0, 300), batch.slice(300)]), ks, words, place)
    ids = [q for q, *_ in asked]
    mine = [(ids[r["_q"]], r["source"], r["external_id"], r["score"]) for r in best.to_pylist()]
    assert mine == [(q, s, key, abs(score)) for q, _, _, s, key, score in wanted]
    assert met == len(asked) * len(stored) and done < met * (0.5 if postings else 1)


def test_bits_outside_the_fingerprint_are_errors(spark):
    query = spark.createDataFrame([(0, [0, 4])], "query_id int, vector array<int>")
    stored = spark.createDataFrame([("s", "C1", [0, 1])], "source string, external_id string, vector array<int>")
    with pytest.raises(ValueError, match="outside"):
        nearest(query, stored, Scorer("binary_cosine", n_bits=4))


def test_queries_must_be_made_as_the_stored_vectors(spark, store):
    for search, call, told in (
        (Inference(store, compound_featurizer=QGramFingerprint(q=3)), "find_similar_compounds", "q 4 against 3"),
        (Inference(store, compound_featurizer=QGramFingerprint(n_bits=64)), "find_similar_compounds", "n_bits 2048 against 64"),
        (Inference(store, protein_featurizer=KmerEmbedding(k=2)), "find_similar_proteins", "k 3 against 2"),
        (Inference(store, protein_featurizer=KmerEmbedding(max_length=5)), "find_similar_proteins", "max_seq_length None against 5"),
    ):
        with pytest.raises(ValueError, match=told):
            getattr(search, call)("MKWV" if "protein" in call else "CCO")


@pytest.mark.parametrize("metric", ["cosine", "dot"])
def test_blocks_of_queries_share_a_scan(spark, metric):
    """Candidates are read once for all blocks of queries, and results are those of a single block."""
    rng = np.random.default_rng(4)
    made = [[float(x) for x in v] for v in rng.normal(size=(900, 8)).astype(np.float32)]
    queries = spark.createDataFrame(list(enumerate(made)), "query_id int, vector array<double>")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    stored = spark.createDataFrame([("s", str(k), v) for k, v in enumerate(made)], VECTORS).repartition(4)
    whole = nearest(queries, stored, Scorer(metric), top_k=5)
    some = nearest(queries, stored.mapInArrow(counted, stored.schema), Scorer(metric), top_k=5, query_block=210, candidate_block=16)
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, whole.collect()))
    assert read.value == 900
