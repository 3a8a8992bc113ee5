"""The pipeline's stages on the smallest tables, each against what its operator must do."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairrank.llm import decontaminate

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = [{r.doc_id for r in docs.select("doc_id").collect()}]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.columns == (columns if name != "sentencepiece" else [*columns, "ids", "n_ids"])
        docs = docs.cache()
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    for before, after in zip(kept, kept[1:]):
        assert after <= before
    assert kept[1] == kept[2] and kept[4] == kept[5]
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
    assert len(toxic - kept[1]) <= 0.03 * len(toxic)
    items = [decontaminate.normalise(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(i in decontaminate.normalise(r.text) for r in docs.select("text").collect() for i in items)


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF).select("doc_id", "n_ids").collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows)


OWN = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_lines bigint, N_DROPPED string, Matches string"


@pytest.mark.parametrize("name", ["line_dedup", "ngram_join", "decontamination"])
def test_awkward_rows_and_own_columns(spark, name):
    rows = [
        (1, "one long line of words\nown line here ok", "en", "s", 40, 77, "a", "m1"),
        (2, "one long line of words\nanother line there", "en", "s", 41, 78, "b", "m2"),
        (3, None, None, None, None, 79, None, None), (4, "", "en", "s", 0, 80, "d", "m4"),
        (None, "text of no document", "en", "s", 19, 81, "e", "m5"), (5, "word " * 20_000, "en", "s", 100_000, 82, "f", "m6"),
    ]
    docs = spark.createDataFrame(rows + rows[:1], OWN)
    stage = dict(corpus_pipeline.STAGES)[name]
    done = stage(spark, docs, SF)
    assert done.columns == docs.columns
    own = {(r.doc_id, r.n_lines, r["N_DROPPED"], r["Matches"]) for r in done.collect()}
    assert own == {(r[0], *r[5:]) for r in rows} and done.count() == 7
    if name == "line_dedup":
        assert done.where(F.col("doc_id") == 2).first().text == "another line there"
    assert stage(spark, docs.limit(0), SF).count() == 0
