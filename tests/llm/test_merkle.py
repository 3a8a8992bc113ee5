"""The manifest against a plain tree built in memory, and what tampering does to it."""

import hashlib

from pyspark.sql import functions as F

from pairrank.llm import merkle
from test_operators import COLUMNS, awkward


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[c] for c in merkle.FIELDS)))


def climb(nodes):
    """{place: [(left, right), ...]} and the root, level by level over whole lists."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k:k + 8] for k in range(0, len(nodes), 8)]
        for k, p in enumerate(at):
            run, own = runs[p // 8], p % 8
            paths[k].append(("".join(run[:own]), "".join(run[own + 1:])))
            at[k] = p // 8
        nodes = [sha("".join(run)) for run in runs]
    return paths, nodes[0]


def brute(rows):
    trees = {}
    for row in rows:
        name = b"" if row["lang"] is None else b"+" + row["lang"].encode()
        trees.setdefault(name, []).append((row["doc_id"] is not None, row["doc_id"] or 0, leaf_of(row)))
    made = {name: (sorted(leaves), *climb([x[2] for x in sorted(leaves)])) for name, leaves in trees.items()}
    names = sorted(made)
    up, root = climb([made[n][2] for n in names])
    out = []
    for name, over in zip(names, up):
        leaves, paths, subroot = made[name]
        for (known, number, digest), path in zip(leaves, paths):
            out.append((number if known else None, digest, subroot, root, tuple(path + over)))
    return sorted(out, key=str)


def rows_of(found):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.witness)) for r in found.collect()), key=str)


def test_awkward_tables(spark):
    rows = awkward()
    odd = spark.createDataFrame(rows, COLUMNS)
    wanted = brute([dict(zip([c.split()[0] for c in COLUMNS.split(", ")], r)) for r in rows])
    assert rows_of(merkle.manifest(odd)) == wanted
    assert merkle.manifest(odd).columns == ["doc_id", "leaf", "witness", "subroot", "root"]
    none = merkle.manifest(spark.createDataFrame([], COLUMNS))
    assert none.count() == 0 and none.columns == ["doc_id", "leaf", "witness", "subroot", "root"]


def test_trees_of_each_size(spark):
    """Trees that are one leaf, a full run, a full second level, and one row more or less."""
    sizes = (1, 2, 7, 8, 9, 63, 64, 65, 513)
    rows = [(k, "s", f"n{n}", 3, str(k)) for n in sizes for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id int, source string, lang string, n_chars int, text string")
    assert rows_of(merkle.manifest(docs)) == brute([r.asDict() for r in docs.collect()])
    alone = docs.where("lang = 'n1'")
    assert [(r.leaf == r.root, r.witness) for r in merkle.manifest(alone).collect()] == [(True, [])]


def test_more_than_a_block_a_hot_group_and_many_groups(spark):
    """One language holds most rows, over several blocks; seventy others hold a few."""
    docs = spark.range(9_500).select(
        (F.col("id") * 7 % 9_500).alias("doc_id"), F.lit("s").alias("source"),
        F.when(F.col("id") >= 700, "en").when(F.col("id") > 0, F.concat(F.lit("l"), F.col("id") % 70)).alias("lang"),
        F.length(F.col("id").cast("string")).alias("n_chars"), F.concat(F.lit("text "), "id").alias("text"),
    )
    assert rows_of(merkle.manifest(docs)) == brute([r.asDict() for r in docs.collect()])


def test_equal_rows_are_leaves_each(spark):
    docs = spark.range(5_000).select(F.lit(1).alias("doc_id"), F.lit(None).cast("string").alias("source"), F.lit("en").alias("lang"), F.lit(None).cast("int").alias("n_chars"), F.lit("copy").alias("text"))
    found = merkle.manifest(docs)
    assert rows_of(found) == brute([r.asDict() for r in docs.collect()])


def test_a_changed_row_leads_to_another_root(spark):
    odd = spark.createDataFrame(awkward(), COLUMNS)
    changed = F.when(F.col("doc_id") % 2 == 0, merkle.leaf_digest(*merkle.FIELDS[:-1], F.concat(F.coalesce("text", F.lit("")), F.lit("!"))))
    rows = merkle.manifest(odd, also={"changed": changed}).withColumn("end", merkle.folded(F.coalesce("changed", "leaf"), F.col("witness")))
    for row in rows.collect():
        assert (row.end == row.root) == (row.changed is None)


def test_witnesses_grow_with_later_appends():
    tree = merkle.Appender(2)
    first, seen = tree.append(sha("0")), []
    for k in range(1, 20):
        tree.append(sha(str(k)))
        seen.append(sum(len(s["left"]) + len(s["right"]) for s in merkle.witness(first)) // 64)
    # Seven siblings as they come, then a parent's sibling for each run that ends.
    assert seen == [*range(1, 8), *[7] * 7, *[8] * 5]

    whole = merkle.Appender(2)
    places = [whole.append(sha(str(k))) for k in range(20)]
    root = whole.finish()
    paths, wanted = climb([sha(str(k)) for k in range(20)])
    assert root == wanted and [[(s["left"], s["right"]) for s in merkle.witness(p)] for p in places] == paths
