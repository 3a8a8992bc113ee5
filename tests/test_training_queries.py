from pairrank.plans.models import DEFAULT_PARAMS, BoostedTrees
from pairrank.workload import training_queries


def test_split_rows_are_whole_and_features_computed_once(spark, tmp_path):
    """Every line item with both vectors is there, copies too; no pass hashes a structure again."""
    folder = tmp_path.as_uri()
    line = spark.range(400).selectExpr(
        "id div 4 AS l_orderkey", "cast(id % 4 as int) AS l_linenumber", "id % 30 AS l_partkey", "id % 7 AS l_suppkey",
        "if(id % 3 = 0, 'R', 'N') AS l_returnflag",
    )
    line.union(line.limit(3)).write.parquet(f"{folder}/lineitem.parquet")
    spark.range(29).selectExpr(
        "id AS p_partkey", "concat('part number ', id) AS p_name", "concat('b', id % 3) AS p_brand", "'t' AS p_type", "1 AS p_size",
    ).write.parquet(f"{folder}/part.parquet")
    spark.range(7).selectExpr(
        "id AS s_suppkey", "'s' AS s_name", "cast(id % 2 as int) AS s_nationkey", "0D AS s_acctbal",
    ).write.parquet(f"{folder}/supplier.parquet")
    spark.range(6).selectExpr("id AS vec_id", "array(cast(id as float), 1f) AS embedding", "0 AS label").write.parquet(f"{folder}/embeddings.parquet")
    model, rows = training_queries._trained(spark, folder)
    want = line.union(line.limit(3)).filter("l_partkey < 29 and l_suppkey < 6").count()
    assert rows.count() == want
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "BroadcastHashJoin" in plan
    scored = model.predict(rows.filter("split <> 'train'"))
    assert scored.filter("probability is null").count() == 0


def test_model_is_of_the_default_size(spark, tmp_path, monkeypatch):
    """Three trees of depth 3 over 64 of 2,048 positions left little of the work."""
    folder, seen = tmp_path.as_uri(), []
    spark.range(40).selectExpr(
        "id AS l_orderkey", "1 AS l_linenumber", "id % 4 AS l_partkey", "id % 3 AS l_suppkey", "if(id % 3 = 0, 'R', 'N') AS l_returnflag",
    ).write.parquet(f"{folder}/lineitem.parquet")
    spark.range(4).selectExpr("id AS p_partkey", "concat('part number ', id) AS p_name", "'b' AS p_brand", "'t' AS p_type", "1 AS p_size").write.parquet(
        f"{folder}/part.parquet"
    )
    spark.range(3).selectExpr("id AS s_suppkey", "'s' AS s_name", "1 AS s_nationkey", "0D AS s_acctbal").write.parquet(f"{folder}/supplier.parquet")
    spark.range(3).selectExpr("id AS vec_id", "array(cast(id as float), 1f) AS embedding", "0 AS label").write.parquet(f"{folder}/embeddings.parquet")
    monkeypatch.setattr(BoostedTrees, "train", lambda model, df: seen.append(df.filter("size(fp) > 0 and size(emb) = 2").count()))
    model, rows = training_queries._trained(spark, folder)
    assert model.params == DEFAULT_PARAMS and (model.params["maxIter"], model.params["maxDepth"]) == (100, 6)
    assert model.n_bits == 2048 and rows.selectExpr("max(array_max(fp))").first()[0] >= 64
    assert rows.count() == 40 and seen == [rows.filter("split = 'train'").count()]
