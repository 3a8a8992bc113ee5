"""Labelled matrices, splits, metrics, models and run-log aggregates."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from pairrank.operators import aggregates, keyed, metrics
from pairrank.operators.colocated import BROADCAST_BYTES, PairLayout, stored_bytes, vector_bytes, with_proteins
from pairrank.operators.split import grouped_split, split_metadata, split_overlap, stratified_split
from pairrank.operators.topk import Scorer, nearest
from pairrank.plans.models import BoostedTrees
from pairrank.session import cut_lineage, shared_dir, spread
from pairrank.sources.feature_store import FeatureStore
from pairrank.workload.feature_queries import bits_sql
from pairrank.workload.registry import query
from pairrank.workload.roles import (
    N_BITS, compound_features, interaction_parents, interactions, protein_features, scored_labels, table,
)

#: Buckets of the query that joins by bucket; a store of terabytes takes thousands.
BUCKETS = 32

SCORED = """
      SELECT l.doc_id AS key, l.quality AS label, (d.n_chars % 1000) / 1000.0::DOUBLE AS score
      FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""

SPLIT = f"""
    scored AS ({SCORED}),
    c1 AS (SELECT label, COUNT(*)::DOUBLE AS c FROM scored GROUP BY label),
    t1 AS (SELECT SUM(c) AS n, ceil(0.15::DOUBLE * SUM(c)) AS n_test FROM c1),
    f1 AS (SELECT label, c, n, n_test, floor(c * n_test / n) AS seats, c * n_test / n - floor(c * n_test / n) AS frac FROM c1, t1),
    s1 AS (SELECT *, seats + CASE WHEN ROW_NUMBER() OVER (ORDER BY frac DESC, label) <= n_test - SUM(seats) OVER () THEN 1 ELSE 0 END AS test FROM f1),
    c2 AS (SELECT label, c - test AS c, test, n - n_test AS n,
                  ceil(0.15::DOUBLE / (1::DOUBLE - 0.15::DOUBLE) * (n - n_test)) AS n_val FROM s1),
    f2 AS (SELECT *, floor(c * n_val / n) AS seats, c * n_val / n - floor(c * n_val / n) AS frac FROM c2),
    s2 AS (SELECT *, seats + CASE WHEN ROW_NUMBER() OVER (ORDER BY frac DESC, label) <= n_val - SUM(seats) OVER () THEN 1 ELSE 0 END AS val FROM f2),
    placed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY md5('42:' || key)) AS rn FROM scored),
    split AS (
      SELECT p.key, p.label, p.score, CASE WHEN rn <= test THEN 'test' WHEN rn <= test + val THEN 'val' ELSE 'train' END AS split
      FROM placed p JOIN s2 ON p.label = s2.label)"""

CURVES = """
    g AS (SELECT split, score, SUM(label)::DOUBLE AS pos, SUM(1 - label)::DOUBLE AS neg FROM split GROUP BY split, score),
    w AS (SELECT *, SUM(pos) OVER (PARTITION BY split ORDER BY score DESC) AS cp, SUM(neg) OVER (PARTITION BY split ORDER BY score DESC) AS cn,
                 SUM(pos) OVER (PARTITION BY split) AS p, SUM(neg) OVER (PARTITION BY split) AS n FROM g),
    curve AS (
      SELECT split, CASE WHEN MAX(p) > 0 AND MAX(n) > 0 THEN SUM(pos * (n - cn + neg / 2)) / (MAX(p) * MAX(n)) END AS auroc,
             CASE WHEN MAX(p) > 0 AND MAX(n) > 0 THEN SUM(pos / p * cp / (cp + cn)) END AS auprc
      FROM w GROUP BY split)"""

COUNTS = """
    k AS (
      SELECT split, COUNT(*) AS n, SUM(label) AS p, SUM(CASE WHEN score >= 0.5 THEN label ELSE 0 END) AS tp,
             SUM(CASE WHEN score >= 0.5 THEN 1 - label ELSE 0 END) AS fp
      FROM split GROUP BY split),
    report AS (
      SELECT split, n::BIGINT AS n_samples, p::BIGINT AS n_positive, (n - p)::BIGINT AS n_negative,
             (tp + n - p - fp)::DOUBLE / n AS accuracy,
             CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS precision,
             CASE WHEN p = 0 THEN 0 ELSE tp::DOUBLE / p END AS recall,
             CASE WHEN 2 * tp + fp + p - tp = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (tp + fp + p) END AS f1
      FROM k)"""


def _split_labels(spark, sf_dir):
    return stratified_split(scored_labels(spark, sf_dir))


def _rounded(df, *names):
    return reduce(lambda d, n: d.withColumn(n, F.round(n, 6)), names, df)


@query(
    """
    SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, COUNT(*)::BIGINT AS n FROM lineitem GROUP BY 1
    """
)
def label_distribution(spark, sf_dir):
    return interactions(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(
    """
    SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS external_id,
           CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
           CAST(p_partkey AS VARCHAR) AS compound_external_id, p_brand AS compound_source,
           CAST(s_suppkey AS VARCHAR) AS protein_external_id, 'nation' || s_nationkey AS protein_source
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    """
)
def interactions_resolved(spark, sf_dir):
    return keyed.interaction_keys(interactions(spark, sf_dir), *interaction_parents(spark, sf_dir))


FEATURE_MATRIX = f"""
    WITH c AS (SELECT p_partkey, p_brand, replace(p_name, ' ', '=') AS text FROM part),
    b AS ({bits_sql('c', 'p_partkey')}),
    fp AS (SELECT p_partkey, string_agg(CAST(bit AS VARCHAR), ',' ORDER BY bit) AS bits FROM b GROUP BY p_partkey),
    e AS (
      SELECT vec_id, embedding,
             array_to_string([CAST(floor(CAST(x AS DOUBLE) * 1000000 + 0.5::DOUBLE) AS BIGINT) FOR x IN embedding], ',') AS micro
      FROM embeddings)
    SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS external_id,
           CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
           coalesce(fp.bits, '') AS on_bits, ROUND(CAST(e.embedding[1] AS DOUBLE), 6) + 0 AS emb_first,
           ROUND(CAST(e.embedding[64] AS DOUBLE), 6) + 0 AS emb_last, e.micro AS emb_millionths, {N_BITS + 64}::BIGINT AS feature_dim
    FROM lineitem JOIN c ON l_partkey = c.p_partkey LEFT JOIN fp ON fp.p_partkey = c.p_partkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN e ON e.vec_id = s_suppkey
    """


def _matrix(merged):
    emb = F.col("emb").cast("array<double>")
    millionths = F.transform(emb, lambda x: F.floor(x * 1000000 + 0.5).cast("bigint"))
    return merged.select(
        "external_id", "label", F.array_join("fp", ",").alias("on_bits"),
        F.round(emb[0], 6).alias("emb_first"), F.round(F.element_at(emb, -1), 6).alias("emb_last"),
        F.array_join(millionths, ",").alias("emb_millionths"),
        (F.lit(N_BITS) + F.size("emb")).cast("bigint").alias("feature_dim"),
    )


@query(FEATURE_MATRIX)
def feature_matrix(spark, sf_dir):
    """Interactions with the compound's bits and the protein's vector, joined on both keys."""
    keys = keyed.interaction_keys(interactions(spark, sf_dir), *interaction_parents(spark, sf_dir))
    return _matrix(keyed.merge_features(keys, compound_features(spark, sf_dir), protein_features(spark, sf_dir)))


@query(FEATURE_MATRIX)
def feature_matrix_bucketed(spark, sf_dir):
    """The same matrix from a store in buckets: interactions are laid out once and joined where they lie."""
    folder = f"{shared_dir(spark)}/matrix/{uuid.uuid4().hex}"
    store = FeatureStore(spark, folder)
    store.save("compound", "v1", compound_features(spark, sf_dir).withColumnRenamed("fp", "vector"), {"n_bits": N_BITS}, BUCKETS)
    store.save("protein", "v1", protein_features(spark, sf_dir).withColumnRenamed("emb", "vector"), {"dim": 64})
    keys = keyed.interaction_keys(interactions(spark, sf_dir), *interaction_parents(spark, sf_dir))
    compound = store.load_bucketed("compound", "v1").withColumnRenamed("vector", "fp")
    protein = store.load("protein", "v1").withColumnRenamed("vector", "emb")
    paired = PairLayout.write(keys, f"{folder}/pairs", BUCKETS).with_compounds(compound, N_BITS, stored_bytes(compound, "fp"))
    return _matrix(with_proteins(paired, protein, store.load_manifest("protein", "v1")["row_count"], 64))


@query(
    """
    SELECT COUNT(*)::BIGINT AS total, SUM(CASE WHEN vec_id IS NULL THEN 0 ELSE 1 END)::BIGINT AS matched,
           SUM(CASE WHEN vec_id IS NULL THEN 1 ELSE 0 END)::BIGINT AS dropped
    FROM lineitem LEFT JOIN embeddings ON l_partkey = vec_id
    """
)
def feature_coverage(spark, sf_dir):
    features = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("compound_id"))
    return keyed.coverage(interactions(spark, sf_dir), features, ["compound_id"])


@query(f"WITH {SPLIT} SELECT key, label, split FROM split", name="stratified_split")
def stratified_split_query(spark, sf_dir):
    return _split_labels(spark, sf_dir).select("key", "label", "split")


def _deal_sql(name: str, counts: str, wanted: str) -> str:
    """Groups taken of each size: shares rounded down, then two walks over the sizes that make up what is missing."""
    return f"""
    {name}_0 AS (
      SELECT size, n, n * want // total AS taken, n * want % total AS rest, want
      FROM {counts}, (SELECT SUM(size * n)::BIGINT AS total FROM {counts}), (SELECT {wanted} AS want)),
    {name}_1 AS (SELECT *, ROW_NUMBER() OVER (ORDER BY rest DESC, size) AS k FROM {name}_0),
    {name}_2 AS (
      SELECT 0::BIGINT AS k, 0::BIGINT AS size, 0::BIGINT AS more, MAX(want) - SUM(size * taken)::BIGINT AS missing FROM {name}_0
      UNION ALL
      SELECT s.k, s.size, m, w.missing - s.size * m FROM {name}_2 w JOIN {name}_1 s ON s.k = w.k + 1,
        LATERAL (SELECT CASE WHEN s.size <= w.missing AND s.taken < s.n THEN 1 ELSE 0 END::BIGINT AS m)),
    {name}_3 AS (
      SELECT s.size, s.n, s.taken + w.more AS taken, ROW_NUMBER() OVER (ORDER BY s.size DESC) AS k FROM {name}_1 s JOIN {name}_2 w ON s.k = w.k),
    {name}_4 AS (
      SELECT 0::BIGINT AS k, 0::BIGINT AS size, 0::BIGINT AS more, (SELECT missing FROM {name}_2 ORDER BY k DESC LIMIT 1) AS missing
      UNION ALL
      SELECT s.k, s.size, m, w.missing - s.size * m FROM {name}_4 w JOIN {name}_3 s ON s.k = w.k + 1,
        LATERAL (SELECT least(s.n - s.taken, w.missing // s.size) AS m)),
    {name} AS (SELECT s.size, s.n, s.taken + w.more AS taken FROM {name}_3 s JOIN {name}_4 w ON s.k = w.k)"""


def _grouped_sql(rows: str, keys: str) -> str:
    """Rows with a group ``g`` to their keys and split; see :func:`pairrank.operators.split.grouped_split`."""
    return f"""
    WITH RECURSIVE x AS ({rows}), g AS (SELECT g, COUNT(*) AS size FROM x GROUP BY g),
    c AS (SELECT size, COUNT(*) AS n FROM g GROUP BY size),
    w AS (SELECT COUNT(*) AS total, CEIL(0.15::DOUBLE * COUNT(*))::BIGINT AS test FROM x),
    {_deal_sql("t", "c", "(SELECT test FROM w)")},
    r AS (SELECT size, n - taken AS n FROM t),
    {_deal_sql("v", "r", "(SELECT CEIL(0.15::DOUBLE / (1 - 0.15::DOUBLE) * (total - test))::BIGINT FROM w)")},
    o AS (SELECT g, size, ROW_NUMBER() OVER (PARTITION BY size ORDER BY md5('42:' || g)) AS place FROM g),
    p AS (
      SELECT g, CASE WHEN place <= t.taken THEN 'test' WHEN place <= t.taken + v.taken THEN 'val' ELSE 'train' END AS split
      FROM o JOIN t ON o.size = t.size JOIN v ON o.size = v.size)
    SELECT {keys}, split FROM x JOIN p ON x.g = p.g"""


@query(_grouped_sql("SELECT doc_id, md5(coalesce(text, '')) AS g FROM documents", "doc_id"))
def split_without_copies(spark, sf_dir):
    """Documents split so that copies of a text stay together; sizes of the splits are those wanted."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("content"))
    return grouped_split(rows, "content").select("doc_id", "split")


@query(
    _grouped_sql("SELECT l_orderkey, l_linenumber, l_suppkey, l_suppkey AS g FROM lineitem", "l_orderkey, l_linenumber, l_suppkey"),
    name="grouped_split",
)
def grouped_split_query(spark, sf_dir):
    """Line items split so that a supplier's rows stay together; sizes of the splits are those wanted."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return grouped_split(rows, "l_suppkey")


@query(
    f"""
    WITH {SPLIT},
    b AS (SELECT label, split, COUNT(*) AS n FROM split GROUP BY label, split)
    SELECT SUM(n)::BIGINT AS total_samples, SUM(CASE WHEN split = 'train' THEN n END)::BIGINT AS train_samples,
           SUM(CASE WHEN split = 'val' THEN n END)::BIGINT AS val_samples, SUM(CASE WHEN split = 'test' THEN n END)::BIGINT AS test_samples,
           SUM(CASE WHEN label = 0 THEN n END)::BIGINT AS n_label_0, SUM(CASE WHEN label = 1 THEN n END)::BIGINT AS n_label_1,
           64::BIGINT AS feature_dim, 'qgram_v1' AS compound_feature_version, 'kmer_v1' AS protein_feature_version
    FROM b
    """,
    name="split_metadata",
)
def split_metadata_query(spark, sf_dir):
    rows = _split_labels(spark, sf_dir)
    width = table(spark, sf_dir, "embeddings").agg(F.max(F.size("embedding"))).scalar()
    versions = {"compound_feature_version": "qgram_v1", "protein_feature_version": "kmer_v1"}
    by_label = F.col("label_distribution")
    return split_metadata(rows, width, versions).select(
        "total_samples", "train_samples", "val_samples", "test_samples",
        by_label["0"].alias("n_label_0"), by_label["1"].alias("n_label_1"),
        F.col("feature_dim").cast("bigint").alias("feature_dim"), *versions,
    )


@query(
    f"""
    WITH {SPLIT},
    t AS (SELECT DISTINCT md5(d.text) AS content, s.split FROM split s JOIN documents d ON s.key = d.doc_id)
    SELECT a AS split_a, b AS split_b,
           (SELECT COUNT(*) FROM (SELECT content FROM t WHERE split = a INTERSECT SELECT content FROM t WHERE split = b))::BIGINT AS overlap
    FROM (VALUES ('train', 'val'), ('train', 'test'), ('val', 'test')) p(a, b)
    """,
    name="split_overlap",
)
def split_overlap_query(spark, sf_dir):
    """Texts that two splits share: exact copies may fall on both sides of a row-wise split."""
    text = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.md5("text").alias("content"))
    return split_overlap(_split_labels(spark, sf_dir).join(text, "key"), ["content"])


@query(
    f"""
    WITH scored AS ({SCORED})
    SELECT key, score, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction FROM scored
    """
)
def threshold_predict(spark, sf_dir):
    return scored_labels(spark, sf_dir).select("key", "score", metrics.threshold_class(F.col("score")).alias("prediction"))


@query(
    f"""
    WITH scored AS ({SCORED}), split AS (SELECT *, 'all' AS split FROM scored), {COUNTS}
    SELECT split, n_samples, n_positive, n_negative, ROUND(accuracy, 6) AS accuracy, ROUND(precision, 6) AS precision,
           ROUND(recall, 6) AS recall, ROUND(f1, 6) AS f1
    FROM report
    """
)
def classification_report(spark, sf_dir):
    scored = scored_labels(spark, sf_dir).withColumn("split", F.lit("all"))
    return _rounded(metrics.classification(metrics.score_groups(scored)), "accuracy", "precision", "recall", "f1")


@query(
    f"""
    WITH split AS (
      SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_extendedprice AS score, l_linestatus AS split FROM lineitem
      UNION ALL SELECT label, score, 'labels' FROM ({SCORED})
      UNION ALL SELECT 1, score, 'one class' FROM ({SCORED})
    ), {CURVES}
    SELECT split, ROUND(auroc, 6) AS auroc, ROUND(auprc, 6) AS auprc FROM curve
    """
)
def auroc_auprc(spark, sf_dir):
    """Many distinct scores (line items), tied scores (labels) and a single class."""
    items = table(spark, sf_dir, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.col("l_extendedprice").alias("score"), F.col("l_linestatus").alias("split"),
    )
    labels = scored_labels(spark, sf_dir)
    scored = items.unionByName(labels.select("label", "score", F.lit("labels").alias("split"))).unionByName(
        labels.select(F.lit(1).alias("label"), "score", F.lit("one class").alias("split"))
    )
    return _rounded(metrics.curves(metrics.held_groups(scored)), "auroc", "auprc")


@query(
    f"""
    WITH {SPLIT},
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY split ORDER BY score DESC, key) AS rn FROM split),
    n AS (SELECT split, COUNT(*) AS n, SUM(label) AS p FROM split GROUP BY split)
    SELECT r.split, k::INTEGER AS k, ROUND(SUM(CASE WHEN rn <= k THEN label ELSE 0 END)::DOUBLE / k, 4) AS precision,
           ROUND(SUM(CASE WHEN rn <= k THEN label ELSE 0 END)::DOUBLE / greatest(MAX(p), 1), 4) AS recall
    FROM r JOIN n ON r.split = n.split CROSS JOIN (VALUES (10), (50), (100)) ks(k)
    WHERE k <= n GROUP BY r.split, k
    """
)
def precision_recall_at_k(spark, sf_dir):
    return metrics.at_k(_split_labels(spark, sf_dir))


@query(
    f"""
    WITH {SPLIT}, {CURVES}, {COUNTS}
    SELECT r.split, ROUND(auroc, 6) AS auroc, ROUND(auprc, 6) AS auprc, ROUND(f1, 6) AS f1, ROUND(accuracy, 6) AS accuracy, n_samples
    FROM report r JOIN curve c ON r.split = c.split
    """
)
def compare_splits(spark, sf_dir):
    groups = metrics.held_groups(_split_labels(spark, sf_dir))
    return _rounded(metrics.compare(groups), "auroc", "auprc", "f1", "accuracy")


@query(
    f"""
    WITH {SPLIT}, {CURVES}, {COUNTS},
    m AS (
      SELECT split, unnest(['auroc', 'auprc', 'f1', 'accuracy', 'n_samples']) AS metric,
             unnest([auroc, auprc, f1, accuracy, n_samples::DOUBLE]) AS value
      FROM (SELECT r.split, auroc, auprc, f1, accuracy, n_samples FROM report r JOIN curve c ON r.split = c.split))
    SELECT metric, ROUND(MAX(CASE WHEN split = 'train' THEN value END), 6) AS train,
           ROUND(MAX(CASE WHEN split = 'val' THEN value END), 6) AS val, ROUND(MAX(CASE WHEN split = 'test' THEN value END), 6) AS test
    FROM m GROUP BY metric
    """
)
def compare_side_by_side(spark, sf_dir):
    """The comparison with one column per split."""
    comparison = metrics.compare(metrics.held_groups(_split_labels(spark, sf_dir)))
    return _rounded(metrics.side_by_side(comparison, ("train", "val", "test")), "train", "val", "test")


@query(
    """
    SELECT event_type AS source, CASE WHEN value > 50 THEN 'FAILED' ELSE 'COMPLETED' END AS status, COUNT(*)::BIGINT AS runs
    FROM events GROUP BY 1, 2
    """
)
def runs_by_status(spark, sf_dir):
    status = F.when(F.col("value") > 50, "FAILED").otherwise("COMPLETED")
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), status.alias("status"))
    return aggregates.runs_by_status(log)


@query(
    """
    WITH e AS (SELECT event_type AS source, CASE WHEN value < 10 THEN 'compound' ELSE 'protein' END AS entity_type,
                      CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
    SELECT source, entity_type, SUM(k)::BIGINT AS records FROM e GROUP BY source, entity_type
    """
)
def records_by_source(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source"),
        F.when(F.col("value") < 10, "compound").otherwise("protein").alias("entity_type"),
        F.get_json_object("props", "$.k").cast("bigint").alias("rows_upserted"),
    )
    return aggregates.records_by_source(log)


@query(
    """
    SELECT event_type AS source, CASE WHEN value < 10 THEN 'sdf' ELSE 'fasta' END AS format,
           SUM(CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) > 90 THEN 1 ELSE 0 END)::BIGINT AS errors
    FROM events GROUP BY 1, 2
    """
)
def parse_errors(spark, sf_dir):
    lost = F.get_json_object("props", "$.k").cast("bigint") > 90
    log = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source"), F.when(F.col("value") < 10, "sdf").otherwise("fasta").alias("format"),
        lost.cast("int").alias("rows_rejected"),
    )
    return aggregates.parse_errors(log)


@query(
    """
    WITH le AS (SELECT * FROM (VALUES ('0.1', 0.1), ('0.5', 0.5), ('1', 1), ('5', 5), ('10', 10), ('30', 30), ('60', 60),
                                      ('120', 120), ('300', 300), ('600', 600), ('+Inf', 1e300)) t(le, bound))
    SELECT event_type AS source, le.le, SUM(CASE WHEN value <= bound THEN 1 ELSE 0 END)::BIGINT AS bucket_count,
           ROUND(SUM(value), 4) AS value_sum, COUNT(value)::BIGINT AS value_count
    FROM events CROSS JOIN le GROUP BY event_type, le.le
    """
)
def latency_histogram(spark, sf_dir):
    seconds = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), "value")
    buckets = aggregates.histogram(seconds, ["source"], "value")
    return buckets.withColumn("value_sum", F.round("value_sum", 4))


# ------------------------------------------------------------- models: no SQL equivalent


def _trained(spark, sf_dir):
    """(model of the default size over whole fingerprints, split rows with both vectors)

    Features are computed once. Line items are spread before the joins, so that the held rows
    need not be by each pass over them.
    """
    compound = cut_lineage(compound_features(spark, sf_dir))
    protein = cut_lineage(protein_features(spark, sf_dir))
    width = protein.agg(F.coalesce(F.max(F.size("emb")), F.lit(0))).first()[0]
    if vector_bytes(protein.count(), width) <= BROADCAST_BYTES:
        protein = F.broadcast(protein)
    keys = keyed.interaction_keys(spread(interactions(spark, sf_dir)), *interaction_parents(spark, sf_dir))
    placed = stratified_split(cut_lineage(keyed.with_features(keys.withColumnRenamed("external_id", "key"), compound, protein)))
    rows = keyed.merge_features(placed, compound, protein).select("key", "label", "split", "fp", "emb")
    model = BoostedTrees(n_bits=N_BITS)
    model.train(rows.filter(F.col("split") == "train"))
    return model, rows


@query()
def train_predict(spark, sf_dir):
    """Boosted trees trained on the train split; val and test scored."""
    model, rows = _trained(spark, sf_dir)
    scored = model.predict(rows.filter(F.col("split") != "train"))
    return scored.select("key", "split", "label", "prediction", F.round("probability", 6).alias("probability"))


@query()
def rank_learned(spark, sf_dir):
    """Ten best proteins for each distinct compound structure, by the trained model."""
    model, _ = _trained(spark, sf_dir)
    path = f"{shared_dir(spark)}/models/{uuid.uuid4().hex}"
    model.save(path)
    scorer = Scorer(n_bits=N_BITS, pair_model=model.trees(spark, path))
    queries = compound_features(spark, sf_dir).select(
        F.array_join("fp", ",").alias("query_id"), F.col("fp").alias("vector")
    ).distinct()
    stored = protein_features(spark, sf_dir).withColumnRenamed("emb", "vector")
    return nearest(queries, stored, scorer, top_k=10).select("query_id", "rank", "source", "external_id", "score")
