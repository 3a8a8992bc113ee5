"""Ranking and similarity search for whole tables of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairrank.functions.text import is_valid_structure
from pairrank.operators.records import query_reason
from pairrank.operators.topk import Scorer, nearest
from pairrank.plans.featurize import Featurizer, KmerEmbedding, QGramFingerprint
from pairrank.sources.feature_store import FeatureStore


def _require_rows(features: DataFrame, what: str) -> None:
    if features.isEmpty():
        raise ValueError(f"the feature store holds no {what} vectors")


#: What a manifest says about a run rather than about its vectors.
NOT_COMPARED = ("generated_at", "spark_version", "row_count")


def _require_same_space(stored: dict, featurizer: Featurizer, what: str) -> None:
    """Queries must be featurised as the stored vectors were: same kind, same parameters, same width."""
    own = featurizer.feature_manifest()
    other = {k: (stored[k], own[k]) for k in own if k in stored and k not in NOT_COMPARED and stored[k] != own[k]}
    if other:
        told = ", ".join(f"{k} {a!r} against {b!r}" for k, (a, b) in sorted(other.items()))
        raise ValueError(f"the stored {what} vectors were not made as the queries are: {told}")


class Inference:
    """``queries``: query_id, query (text) and, per query, top_k (default 10).

    Result rows echo query and top_k beside rank, external_id, source and score. Queries
    that fail the checks are returned by :meth:`rejected`; the one-query calls raise.
    """

    def __init__(
        self, store: FeatureStore, scorer: Scorer | None = None,
        compound_version: str = "qgram_v1", protein_version: str = "kmer_v1", model_version: str = "v1",
        compound_featurizer: QGramFingerprint | None = None, protein_featurizer: Featurizer | None = None,
    ) -> None:
        self.store = store
        self.scorer = scorer
        self.compound_version = compound_version
        self.protein_version = protein_version
        self.model_version = model_version
        self.compound_featurizer = compound_featurizer or QGramFingerprint()
        self.protein_featurizer = protein_featurizer or KmerEmbedding()

    @staticmethod
    def _marked(queries: DataFrame, entity_type: str) -> DataFrame:
        if "top_k" not in queries.columns:
            queries = queries.withColumn("top_k", F.lit(10))
        marked = queries.withColumn("entity_type", F.lit(entity_type)).withColumn("reason", query_reason())
        if entity_type == "compound":
            marked = marked.withColumn(
                "reason",
                F.coalesce("reason", F.when(~is_valid_structure("query"), "invalid structure")),
            )
        return marked

    def rejected(self, queries: DataFrame, entity_type: str) -> DataFrame:
        return self._marked(queries, entity_type).filter(F.col("reason").isNotNull())

    def _search(self, queries, entity_type: str, featurizer: Featurizer, features: DataFrame, scorer: Scorer) -> DataFrame:
        good = self._marked(queries, entity_type).filter(F.col("reason").isNull())
        texts = good.select(
            F.col("query_id").alias("external_id"), F.lit("query").alias("source"),
            F.col("query").alias(featurizer.text),
        )
        vectors = featurizer.transform(texts).select(F.col("external_id").alias("query_id"), "vector")
        asked = vectors.join(good.select("query_id", "top_k"), "query_id")
        found = nearest(asked, features, scorer)
        return found.join(good.select("query_id", "query"), "query_id")

    def rank(self, queries: DataFrame) -> DataFrame:
        """Protein targets of compound queries, by the configured scorer."""
        if self.scorer is None:
            raise ValueError("ranking needs a scorer")
        features = self.store.load("protein", self.protein_version)
        _require_rows(features, "protein")
        self._check_spaces()
        found = self._search(queries, "compound", self.compound_featurizer, features, self.scorer)
        return found.withColumn("model_version", F.lit(self.model_version))

    def _check_spaces(self) -> None:
        """A plain product needs vectors of one space; learned scorers join two."""
        if self.scorer.pair_model is not None:
            if self.scorer.n_bits and self.scorer.n_bits != self.compound_featurizer.n_bits:
                raise ValueError(
                    f"the model was trained on {self.scorer.n_bits} bits, the queries have {self.compound_featurizer.n_bits}"
                )
            return
        protein = self.store.load_manifest("protein", self.protein_version).get("dim")
        if protein is not None and protein != self.compound_featurizer.n_bits:
            raise ValueError(
                f"cannot compare {self.compound_featurizer.n_bits}-wide queries with "
                f"{protein}-wide candidates; use the learned strategy"
            )

    def similar_proteins(self, queries: DataFrame) -> DataFrame:
        features = self.store.load("protein", self.protein_version)
        _require_rows(features, "protein")
        _require_same_space(self.store.load_manifest("protein", self.protein_version), self.protein_featurizer, "protein")
        found = self._search(queries, "protein", self.protein_featurizer, features, Scorer("cosine"))
        return found.withColumn("similarity_metric", F.lit("cosine"))

    def similar_compounds(self, queries: DataFrame) -> DataFrame:
        features = self.store.load("compound", self.compound_version)
        _require_rows(features, "compound")
        _require_same_space(self.store.load_manifest("compound", self.compound_version), self.compound_featurizer, "compound")
        scorer = Scorer("binary_cosine", n_bits=self.compound_featurizer.n_bits)
        found = self._search(queries, "compound", self.compound_featurizer, features, scorer)
        return found.withColumn("similarity_metric", F.lit("cosine"))

    # ---------------------------------------------------------------- one-query calls

    def _one(self, text: str, top_k: int, entity_type: str) -> DataFrame:
        spark = self.store.spark
        query = spark.createDataFrame([("query", text, top_k)], "query_id string, query string, top_k int")
        bad = self.rejected(query, entity_type).first()
        if bad is not None:
            raise ValueError(f"{bad['reason']}: {text!r}")
        return query

    def rank_one(self, smiles: str, top_k: int = 10) -> list[dict]:
        return _results(self.rank(self._one(smiles, top_k, "compound")))

    def find_similar_proteins(self, sequence: str, top_k: int = 10) -> list[dict]:
        return _results(self.similar_proteins(self._one(sequence, top_k, "protein")))

    def find_similar_compounds(self, smiles: str, top_k: int = 10) -> list[dict]:
        return _results(self.similar_compounds(self._one(smiles, top_k, "compound")))


def _results(found: DataFrame) -> list[dict]:
    """At most 500 rows, the bound on top_k."""
    rows = found.select("rank", "external_id", "source", "score").orderBy("rank").collect()
    return [r.asDict() for r in rows]
