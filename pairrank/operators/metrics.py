"""Ranking and classification metrics over scored rows, per split.

Rows are reduced to one per (split, score) first; everything threshold-free is computed
from those groups, so ties count as ties. The global order the curves need comes from one
range partitioning: counts run on inside each range as it is written, and the totals of the
ranges before are added when it is read. No window ever sees a whole split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairrank.operators.topk import top_k_rows
from pairrank.session import cut_lineage

# Class threshold and default k.
THRESHOLD = 0.5
K_VALUES = (10, 50, 100)
# Totals of ranges are broadcast up to this many rows: one for each range, and for each split that ends in one.
BROADCAST_TOTALS = 100_000


def threshold_class(probability, threshold: float = THRESHOLD) -> Column:
    """1 from the threshold on, inclusive."""
    return (probability >= F.lit(threshold)).cast("int")


def score_groups(scored: DataFrame, split="split", score="score", label="label") -> DataFrame:
    """split, score, pos, neg: one row per distinct score."""
    return scored.groupBy(F.col(split).alias("split"), F.col(score).cast("double").alias("score")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"),
    )


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Appends run_pos and run_neg: counts of the split so far in this partition, in its order."""
    last, carried = None, np.zeros(2, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        split = batch.column("split").dictionary_encode()
        code = split.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.diff(code, prepend=code[0] - 1))
        counts = np.stack([batch.column(c).to_numpy() for c in ("pos", "neg")])
        run = np.cumsum(counts, axis=1)
        before = run[:, starts] - counts[:, starts]
        first = split[0].as_py()
        if last is not None and last[0] == first:
            before[:, 0] -= carried
        run -= np.repeat(before, np.diff(starts, append=len(code)), axis=1)
        last, carried = (split[len(code) - 1].as_py(),), run[:, -1].copy()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(run[0]), pa.array(run[1])], names=[*batch.schema.names, "run_pos", "run_neg"])


def held_groups(scored: DataFrame, ranges: int | None = None, **names: str) -> DataFrame:
    """Score groups in the order of the curves, computed once and kept: scoring is usually the costly part.

    Adds ``range``, the range partition of a group (by split, then falling score), and
    run_pos, run_neg, the counts of its split inside that range up to it. ``ranges`` is the
    number of partitions, by default the session's; the metrics do not depend on it.
    """
    groups = score_groups(scored, **names)
    order = [F.col("split"), F.col("score").desc()]
    placed = groups.repartitionByRange(ranges, *order) if ranges else groups.repartitionByRange(*order)
    marked = placed.withColumn("range", F.spark_partition_id()).sortWithinPartitions(*order)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in marked.schema)
    return cut_lineage(marked.mapInArrow(_running, f"{schema}, run_pos bigint, run_neg bigint"))


def running_counts(groups: DataFrame) -> DataFrame:
    """Adds cum_pos, cum_neg (this score and above) and the split's totals to :func:`held_groups`.

    Only the totals of the ranges are put in order; the groups stay where they are.
    """
    whole = Window.partitionBy("_split")
    above = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per_range = groups.groupBy(F.col("split").alias("_split"), F.col("range").alias("_range")).agg(
        F.max("run_pos").alias("p"), F.max("run_neg").alias("n")
    )
    totals = per_range.select(
        "_split", "_range",
        F.coalesce(F.sum("p").over(above), F.lit(0)).alias("_pos_above"),
        F.coalesce(F.sum("n").over(above), F.lit(0)).alias("_neg_above"),
        F.sum("p").over(whole).alias("total_pos"),
        F.sum("n").over(whole).alias("total_neg"),
    )
    if per_range.count() <= BROADCAST_TOTALS:
        totals = F.broadcast(totals)
    same = F.col("split").eqNullSafe(F.col("_split")) & (F.col("range") == F.col("_range"))
    return groups.join(totals, same).select(
        "split", "score", "pos", "neg", "total_pos", "total_neg",
        (F.col("_pos_above") + F.col("run_pos")).alias("cum_pos"),
        (F.col("_neg_above") + F.col("run_neg")).alias("cum_neg"),
    )


def _ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 where the denominator is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top.cast("double") / bottom.cast("double"))


def classification(groups: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Counts, accuracy, precision, recall and F1 of each split, one pass."""
    chosen = F.col("score") >= threshold
    sums = groups.groupBy("split").agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n_samples"),
        F.sum("pos").alias("n_positive"),
        F.sum("neg").alias("n_negative"),
        F.sum(F.when(chosen, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(chosen, F.col("neg")).otherwise(0)).alias("fp"),
    )
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("n_positive") - tp, F.col("n_negative") - fp
    return sums.select(
        "split", "n_samples", "n_positive", "n_negative",
        _ratio(tp + tn, F.col("n_samples")).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def curves(groups: DataFrame) -> DataFrame:
    """AUROC (ties count half) and average precision (step sum) of :func:`held_groups`; null with one class."""
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    total_pos, total_neg = F.col("total_pos"), F.col("total_neg")
    below = total_neg - F.col("cum_neg")
    sums = running_counts(groups).groupBy("split").agg(
        F.max("total_pos").alias("total_pos"),
        F.max("total_neg").alias("total_neg"),
        F.sum(pos * (below + neg / 2)).alias("won"),
        F.sum(pos * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("steps"),
    )
    both = (total_pos > 0) & (total_neg > 0)
    return sums.select(
        "split",
        F.when(both, F.col("won") / (total_pos.cast("double") * total_neg)).alias("auroc"),
        F.when(both, F.col("steps") / total_pos).alias("auprc"),
    )


def at_k(
    scored: DataFrame, k_values=K_VALUES, split="split", score="score", label="label", key="key"
) -> DataFrame:
    """split, k, precision, recall: top k by score, ties by key; k > n is left out."""
    rows = scored.select(
        F.col(split).alias("split"), F.col(score).cast("double").alias("score"),
        F.col(label).alias("label"), F.col(key).alias("key"),
    )
    totals = rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("total_pos"),
    )
    top = top_k_rows(rows, ["split"], [F.col("score").desc(), F.col("key")], max(k_values), F.col("key"))
    hits = top.groupBy("split").agg(
        F.array(
            *[
                F.struct(
                    F.lit(k).alias("k"),
                    F.sum(F.when((F.col("rank") <= k) & (F.col("label") == 1), 1).otherwise(0)).alias("tp"),
                )
                for k in k_values
            ]
        ).alias("hits")
    )
    return (
        totals.join(hits, "split")
        .select("split", "n", "total_pos", F.inline("hits"))
        .filter(F.col("k") <= F.col("n"))
        .select(
            "split", "k",
            F.round(F.col("tp") / F.col("k"), 4).alias("precision"),
            F.round(F.col("tp") / F.greatest("total_pos", F.lit(1)), 4).alias("recall"),
        )
    )


def compare(groups: DataFrame) -> DataFrame:
    """One row per split: auroc, auprc, f1, accuracy, n_samples. Pass held groups."""
    return (
        classification(groups)
        .join(curves(groups), "split")
        .select("split", "auroc", "auprc", "f1", "accuracy", "n_samples")
    )


def headline() -> Column:
    """What splits are compared by, out of a row of :func:`evaluate`."""
    return F.struct("threshold_free.auroc", "threshold_free.auprc", "threshold_based.f1", "threshold_based.accuracy", "n_samples")


def side_by_side(comparison: DataFrame, splits: tuple[str, ...]) -> DataFrame:
    """A comparison turned: one row per metric, one column per split."""
    names = [c for c in comparison.columns if c != "split"]
    numbers = comparison.select("split", *[F.col(c).cast("double").alias(c) for c in names])
    long = numbers.unpivot("split", names, "metric", "value")
    return long.groupBy("metric").pivot("split", list(splits)).agg(F.first("value"))


def evaluate(scored: DataFrame, k_values=K_VALUES, **names: str) -> DataFrame:
    """Whole report, one row per split, nested as threshold_free, threshold_based, ranking."""
    keyless = {k: v for k, v in names.items() if k != "key"}
    groups = held_groups(scored, **keyless)
    ranking = (
        at_k(scored, k_values, **names)
        .select(
            "split",
            F.explode(
                F.create_map(
                    F.concat(F.lit("precision@"), "k"), F.col("precision"),
                    F.concat(F.lit("recall@"), "k"), F.col("recall"),
                )
            ).alias("name", "value"),
        )
        .groupBy("split")
        .agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("ranking"))
    )
    return (
        classification(groups)
        .join(curves(groups), "split")
        .join(ranking, "split", "left")
        .select(
            "split", "n_samples", "n_positive", "n_negative",
            F.struct("auroc", "auprc").alias("threshold_free"),
            F.struct("accuracy", "precision", "recall", "f1").alias("threshold_based"),
            F.coalesce("ranking", F.create_map().cast("map<string,double>")).alias("ranking"),
        )
    )
