"""Featurisers and the featurising run."""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pairrank.functions.text import is_valid_structure, kmer_frequencies, qgram_bits, truncate
from pairrank.plans.models import utc_now
from pairrank.sources.feature_store import FeatureStore


# Vector widths, and the batch and length limits of sequence models.
N_BITS, DIM = 2048, 320
BATCH_SIZE, MAX_LENGTH = 8, 1024


class Featurizer(ABC):
    """external_id, source and a text column in; external_id, source, ``vector`` out.

    A model that works row by row plugs in by implementing ``transform`` with an iterator
    ``pandas_udf`` or ``mapInArrow``, which load it once per task.
    """

    text: str

    def fit(self, df: DataFrame) -> None:
        """Stateless unless a subclass says otherwise."""

    @abstractmethod
    def transform(self, df: DataFrame) -> DataFrame: ...

    @abstractmethod
    def feature_manifest(self) -> dict: ...


class QGramFingerprint(Featurizer):
    """Distinct q-grams of a structure string, hashed to ``n_bits`` positions.

    ``vector`` holds the on-bits. Structures that fail the lexical check are dropped.
    """

    text = "smiles"

    def __init__(self, n_bits: int | None = None, q: int | None = None) -> None:
        self.n_bits = N_BITS if n_bits is None else n_bits
        self.q = 4 if q is None else q
        if self.n_bits < 1 or self.q < 1:
            raise ValueError(f"n_bits and q must be positive, got {self.n_bits} and {self.q}")

    def transform(self, df: DataFrame) -> DataFrame:
        valid = df.filter(is_valid_structure(self.text))
        return valid.select("external_id", "source", qgram_bits(F.col(self.text), self.n_bits, self.q).alias("vector"))

    def feature_manifest(self) -> dict:
        return {
            "type": "qgram", "q": self.q, "n_bits": self.n_bits,
            "spark_version": pyspark.__version__, "generated_at": utc_now(),
        }


class KmerEmbedding(Featurizer):
    """Shares of hashed k-mers in a sequence, ``dim`` numbers per row.

    ``max_length`` cuts sequences as language models do; by default whole ones are used.
    """

    text = "sequence"

    def __init__(self, dim: int = DIM, k: int = 3, max_length: int | None = None) -> None:
        if dim < 1 or k < 1:
            raise ValueError(f"dim and k must be positive, got {dim} and {k}")
        self.dim, self.k, self.max_length = dim, k, max_length

    def transform(self, df: DataFrame) -> DataFrame:
        sequence = F.col(self.text)
        if self.max_length is not None:
            sequence = truncate(sequence, self.max_length)
        return df.select("external_id", "source", kmer_frequencies(sequence, self.dim, self.k).alias("vector"))

    def feature_manifest(self) -> dict:
        return {
            "type": "kmer", "k": self.k, "dim": self.dim, "pooling": "share",
            "max_seq_length": self.max_length, "generated_at": utc_now(),
        }


class ModelEmbedding(Featurizer):
    """Plug-in for a sequence model: ``load`` runs once per task, ``embed`` once per batch.

    ``embed(model, texts)`` returns one vector per text, for instance the masked mean of
    its token vectors. Texts are cut to ``max_length`` letters, the model's own limit.
    """

    text = "sequence"

    def __init__(
        self, name: str, dim: int, load: Callable[[], object],
        embed: Callable[[object, list[str]], Iterable[Sequence[float]]], batch_size: int = BATCH_SIZE, max_length: int = MAX_LENGTH,
    ) -> None:
        self.name, self.dim = name, dim
        self.load, self.embed = load, embed
        self.batch_size, self.max_length = batch_size, max_length

    def transform(self, df: DataFrame) -> DataFrame:
        load, embed, size, dim = self.load, self.embed, self.batch_size, self.dim

        @F.arrow_udf("array<double>")
        def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = load()
            for batch in batches:
                texts = batch.to_pylist()
                rows = [v for start in range(0, len(texts), size) for v in embed(model, texts[start:start + size])]
                if len(rows) != len(texts) or any(len(row) != dim for row in rows):
                    raise ValueError(f"the model must give {dim} numbers for each of {len(texts)} texts")
                flat = np.asarray(rows, np.float64).ravel()
                yield pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dim), pa.int32()), pa.array(flat))

        cut = truncate(F.col(self.text), self.max_length)
        return df.select("external_id", "source", vectors(cut).alias("vector"))

    def feature_manifest(self) -> dict:
        return {
            "type": self.name, "dim": self.dim, "pooling": "mean",
            "max_seq_length": self.max_length, "generated_at": utc_now(),
        }


class Featurization:
    """Featurises both entity tables into the store.

    ``compounds`` needs external_id, source, smiles and ``proteins`` external_id, source,
    sequence; the scan reads those columns only. With ``compound_buckets`` the compounds'
    vectors are stored in buckets, for training data without a shuffle of the interactions.
    """

    def __init__(
        self, store: FeatureStore, compounds: DataFrame, proteins: DataFrame,
        compound_featurizer: Featurizer | None = None, protein_featurizer: Featurizer | None = None,
        compound_buckets: int | None = None,
    ) -> None:
        self.store = store
        self.compounds = compounds
        self.proteins = proteins
        self.compound_featurizer = compound_featurizer or QGramFingerprint()
        self.protein_featurizer = protein_featurizer or KmerEmbedding()
        self.buckets = {"compound": compound_buckets}

    def run(self, version: str = "v1") -> dict:
        start = time.monotonic()
        compounds = self.featurize_compounds(version)
        proteins = self.featurize_proteins(version)
        return {
            "version": version, "compounds": compounds, "proteins": proteins,
            "elapsed_seconds": round(time.monotonic() - start, 2),
        }

    def featurize_compounds(self, version: str) -> dict:
        return self._featurize("compound", self.compounds, self.compound_featurizer, version)

    def featurize_proteins(self, version: str) -> dict:
        return self._featurize("protein", self.proteins, self.protein_featurizer, version)

    def _featurize(self, entity_type: str, table: DataFrame, featurizer: Featurizer, version: str) -> dict:
        rows = table.select("external_id", "source", featurizer.text)
        if rows.isEmpty():
            return {"count": 0, "total": 0, "uri": None}
        featurizer.fit(rows)
        seen = Observation(f"{entity_type}_input")
        features = featurizer.transform(rows.observe(seen, F.count(F.lit(1)).alias("total")))
        manifest = featurizer.feature_manifest()
        kind = manifest["type"]
        uri = self.store.save(entity_type, f"{kind}_{version}", features, manifest, self.buckets.get(entity_type))
        saved = self.store.load_manifest(entity_type, f"{kind}_{version}")
        return {"count": saved["row_count"], "total": seen.get["total"], "uri": uri}
