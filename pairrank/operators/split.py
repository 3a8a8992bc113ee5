"""Stratified train / val / test split with exact sizes and no shuffle of the rows.

Inside each label, rows are ordered by the md5 of seed and key: the first ones are test,
the next val, the rest train. Only two cut points per label are needed, so the plan

1. counts rows per (label, hash prefix), reduced map-side;
2. finds the prefix each cut falls into, and ranks only the rows of that prefix;
3. compares every row's hash with its label's cut points.

The hash spreads any label evenly over the prefixes, so a hot label is no hot task.

Where rows of a group must stay together, groups of equal size are the classes: seats are
dealt to group sizes until the rows wanted are met, and each size's groups are cut in the
same way. Sizes of groups that add up to n rows are at most sqrt(2n) in number, so the
driver sees a short table whatever the number of groups.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairrank.session import cut_lineage

PREFIX_DIGITS = 4
SPLITS = ("train", "val", "test")
# Default shares and seed.
TEST_SIZE, VAL_SIZE, SEED = 0.15, 0.15, 42
SIZES = "label int, n long, n_test long, n_val long"


def _shares(counts: dict, total: int, wanted: int) -> dict:
    """Largest-remainder seats of ``wanted`` among the classes; ties to the smaller label."""
    ideal = {label: c * float(wanted) / total for label, c in counts.items()}
    seats = {label: math.floor(x) for label, x in ideal.items()}
    left = wanted - sum(seats.values())
    order = sorted(ideal, key=lambda label: (seats[label] - ideal[label], label))
    for label in order[:left]:
        seats[label] += 1
    return seats


def split_sizes(counts: dict, test_size: float = TEST_SIZE, val_size: float = VAL_SIZE) -> dict:
    """label -> (n, n_test, n_val) from the class counts."""
    small = [label for label, c in counts.items() if c < 2]
    if small:
        raise ValueError(f"classes with fewer than 2 rows cannot be stratified: {small}")
    total = sum(counts.values())
    n_test = math.ceil(test_size * total)
    rest = total - n_test
    n_val = math.ceil(val_size / (1 - test_size) * rest)
    if n_test >= total or n_val >= rest:
        raise ValueError("test and val leave no training rows")
    test = _shares(counts, total, n_test)
    remaining = {label: c - test[label] for label, c in counts.items()}
    val = _shares(remaining, rest, n_val)
    return {label: (counts[label], test[label], val[label]) for label in counts}


def hash_order(key, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def stratified_split(
    df: DataFrame, label: str = "label", key: str = "key", test_size: float = TEST_SIZE,
    val_size: float = VAL_SIZE, seed: int = SEED, group_key: str | Column | None = None,
    max_classes: int = 1_000_000,
) -> DataFrame:
    """Adds ``split``. ``key`` must be unique; the result depends on nothing else.

    A null label or a null key is an error: such a row has no class or no place. So are more
    than ``max_classes`` labels, since one row for each reaches the driver.

    ``group_key`` keeps rows of one group (say, one compound) in one split instead: labels
    and row keys then play no part, see :func:`grouped_split`.
    """
    if group_key is not None:
        return grouped_split(df, group_key, test_size, val_size, seed)
    keyed = df.select(F.col(label).alias("_l"), hash_order(F.col(key), seed).alias("_h")).withColumn(
        "_p", F.substring("_h", 1, PREFIX_DIGITS)
    )
    # At most 65,536 rows per class, used twice.
    prefixes = keyed.groupBy("_l", "_p").agg(F.count(F.lit(1)).alias("_n")).persist()
    try:
        class_rows = prefixes.groupBy("_l").agg(
            F.sum("_n").alias("n"), F.sum(F.when(F.col("_p").isNull(), F.col("_n")).otherwise(0)).alias("keyless"),
        ).limit(max_classes + 1).collect()
        if len(class_rows) > max_classes:
            raise ValueError(f"more than {max_classes} classes: is this a class column?")
        if not class_rows:
            return df.withColumn("split", F.lit(None).cast("string"))
        if any(r["_l"] is None or r["keyless"] for r in class_rows):
            raise ValueError("rows without a label or a key cannot be split: drop them first")
        sizes = split_sizes({r["_l"]: r["n"] for r in class_rows}, test_size, val_size)
        cuts = _cut_points(df.sparkSession, keyed, prefixes, sizes, df.schema[label].dataType)
    finally:
        prefixes.unpersist()
    rows = df.withColumn("_h", hash_order(F.col(key), seed))
    placed = rows.join(F.broadcast(cuts), F.col(label).eqNullSafe(F.col("_l")))
    split = (
        F.when(F.col("_h") <= F.col("_test_cut"), "test")
        .when(F.col("_h") <= F.col("_val_cut"), "val")
        .otherwise("train")
    )
    return placed.withColumn("split", split).select(*df.columns, "split")


def _cut_points(spark: SparkSession, keyed, prefixes, sizes: dict, label_type) -> DataFrame:
    """Per label, the hash of its last test row and of its last val row ('' for none).

    The result has one row per class and is fetched, so later passes need not find it again.
    """
    wanted = [
        (label, name, seats)
        for label, (_, test, val) in sizes.items()
        for name, seats in (("_test_cut", test), ("_val_cut", test + val))
    ]
    kind = label_type.simpleString()
    target = spark.createDataFrame(wanted, f"_l {kind}, _cut string, _seats long")
    upto = Window.partitionBy("_l").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    summed = prefixes.withColumn("_end", F.sum("_n").over(upto))
    hit = summed.join(F.broadcast(target), "_l").filter(
        (F.col("_seats") > F.col("_end") - F.col("_n")) & (F.col("_seats") <= F.col("_end"))
    ).select("_l", "_p", "_cut", (F.col("_seats") - F.col("_end") + F.col("_n")).alias("_place"))
    order = Window.partitionBy("_l", "_p", "_cut").orderBy("_h")
    found = (
        keyed.join(F.broadcast(hit), ["_l", "_p"])
        .withColumn("_rn", F.row_number().over(order))
        .filter(F.col("_rn") == F.col("_place"))
    )
    at = {(r["_l"], r["_cut"]): r["_h"] for r in found.select("_l", "_cut", "_h").collect()}
    rows = [(label, at.get((label, "_test_cut"), ""), at.get((label, "_val_cut"), "")) for label in sizes]
    return spark.createDataFrame(rows, f"_l {kind}, _test_cut string, _val_cut string")


def deal_groups(counts: dict[int, int], wanted: int) -> dict[int, int]:
    """How many groups of each size to take, so that their rows come as near to ``wanted`` as they can from below.

    Each size first gives its share, rounded down. What is missing is made up by one group
    more of the sizes that lost most by rounding, then by groups from the largest size that
    still fits to the smallest. If any groups of one row are left, the rows are met exactly.
    """
    total = sum(size * n for size, n in counts.items())
    taken = {size: n * wanted // total for size, n in counts.items()} if total else {}
    missing = wanted - sum(size * n for size, n in taken.items())
    for size in sorted(taken, key=lambda size: (-(counts[size] * wanted % total), size)):
        if size <= missing and taken[size] < counts[size]:
            taken[size] += 1
            missing -= size
    for size in sorted(taken, reverse=True):
        more = min(counts[size] - taken[size], missing // size)
        taken[size] += more
        missing -= more * size
    return taken


def group_seats(counts: dict[int, int], test_size: float = TEST_SIZE, val_size: float = VAL_SIZE) -> dict[int, tuple[int, int, int]]:
    """group size -> (groups, those in test, those in val)"""
    total = sum(size * n for size, n in counts.items())
    n_test = math.ceil(test_size * total)
    n_val = math.ceil(val_size / (1 - test_size) * (total - n_test))
    test = deal_groups(counts, n_test)
    val = deal_groups({size: n - test[size] for size, n in counts.items()}, n_val)
    return {size: (n, test[size], val[size]) for size, n in counts.items()}


def grouped_split(
    df: DataFrame, group_key: str | Column, test_size: float = TEST_SIZE, val_size: float = VAL_SIZE, seed: int = SEED,
) -> DataFrame:
    """Adds ``split``; all rows of a group get the same. A null group is an error.

    Test and val hold the rows wanted, or fewer by less than the smallest group left over. A
    group larger than its split's share, such as one with a third of all rows, is in train.
    Only groups outside train meet the rows again, in one equi-join; the rest is train.
    """
    spark = df.sparkSession
    group = F.col(group_key) if isinstance(group_key, str) else group_key
    keyed = df.withColumn("_g", group)
    groups = cut_lineage(
        keyed.groupBy("_g").agg(F.count(F.lit(1)).alias("_l"))
        .withColumn("_h", hash_order(F.col("_g"), seed)).withColumn("_p", F.substring("_h", 1, PREFIX_DIGITS))
    )
    counts = {r["_l"]: r["n"] for r in groups.groupBy("_l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not groups.where(F.col("_g").isNull()).isEmpty():
        raise ValueError("rows without a group cannot be split: drop them first")
    sizes = {size: seats for size, seats in group_seats(counts, test_size, val_size).items() if seats[1] or seats[2]}
    if not sizes:
        return df.withColumn("split", F.lit("train"))
    prefixes = groups.groupBy("_l", "_p").agg(F.count(F.lit(1)).alias("_n"))
    cuts = _cut_points(spark, groups, prefixes, sizes, groups.schema["_l"].dataType)
    chosen = groups.join(F.broadcast(cuts), "_l").where(F.col("_h") <= F.greatest("_test_cut", "_val_cut")).select(
        F.col("_g").alias("_chosen"), F.when(F.col("_h") <= F.col("_test_cut"), "test").otherwise("val").alias("_part")
    )
    placed = keyed.join(chosen, F.col("_g") == F.col("_chosen"), "left")
    return placed.withColumn("split", F.coalesce("_part", F.lit("train"))).select(*df.columns, "split")


def split_overlap(rows: DataFrame, content: list[str], split: str = "split") -> DataFrame:
    """Distinct row contents that two splits share, per pair of splits.

    One aggregation on the content instead of three intersections.
    """
    present = rows.groupBy(*content).agg(
        *[F.max((F.col(split) == name).cast("int")).alias(name) for name in SPLITS]
    )
    pairs = [("train", "val"), ("train", "test"), ("val", "test")]
    shared = present.agg(
        *[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs]
    )
    return shared.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(a).alias("split_a"), F.lit(b).alias("split_b"),
                        F.coalesce(F.col(f"{a}_{b}"), F.lit(0)).cast("bigint").alias("overlap"),
                    )
                    for a, b in pairs
                ]
            )
        )
    )


def split_metadata(rows: DataFrame, dimension: Column, versions: dict[str, str]) -> DataFrame:
    """Sizes per split, feature dimension and label distribution, in one row."""
    by_label = rows.groupBy("label", "split").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(dimension).alias("dim"),
    )
    per_label = by_label.groupBy("label").agg(
        F.sum("n").alias("n"), F.max("dim").alias("dim"),
        *[F.sum(F.when(F.col("split") == s, F.col("n")).otherwise(0)).alias(s) for s in SPLITS],
    )
    return per_label.agg(
        F.sum("n").alias("total_samples"),
        *[F.sum(s).alias(f"{s}_samples") for s in SPLITS],
        F.max("dim").alias("feature_dim"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("label").cast("string"), "n")))).alias(
            "label_distribution"
        ),
    ).select("*", *[F.lit(v).alias(k) for k, v in versions.items()])
