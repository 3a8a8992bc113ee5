"""A Merkle manifest of a table: a digest of all rows, and for each row a witness that proves it.

Rows are leaves, in trees by group (a document's language); eight consecutive nodes have one
parent, and the roots of the groups are the leaves of one last tree. Witnesses grow as rows
are appended, as in a log that is never rebuilt:

* An appended node joins the open run of its level. Its witness is a reference to that run,
  so each later sibling extends it; the eighth, or the end, closes the run, and its parent is
  appended one level up, where the same goes on.
* Work is dealt to tasks in blocks of 4,096 consecutive nodes, aligned so that each block is
  one whole subtree. A block's root is one more append to the tree above, which is again cut
  into blocks. So a table of 10^11 rows takes four rounds, each 4,096 times smaller.
* On the way back the witness of a block's root extends the witnesses of the block's nodes.

Positions come from a range partitioning of the narrow leaves (never the texts) and the
counts of its partitions; a group that holds most rows is many partitions and many blocks.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairrank.llm.common import held, hold

#: Children of a node, and the levels that a task closes.
ARITY, LEVELS = 8, 4
BLOCK = ARITY**LEVELS
#: What a row's digest covers, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
WITNESS = "array<struct<left:string,right:string>>"
_SIDES = pa.struct([("left", pa.string()), ("right", pa.string())])


def leaf_digest(*columns: Column | str) -> Column:
    """Lowercase hex SHA-256 of the columns: ``-`` for null, else the byte count, ``:`` and the value as text."""

    def field(column):
        shown = (F.col(column) if isinstance(column, str) else column).cast("string")
        return F.when(shown.isNull(), "-").otherwise(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown))

    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def parent(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class Run:
    """The children of one node; open until ``up``, the node's own place, is known."""

    __slots__ = ("digests", "up", "_sides")

    def __init__(self):
        self.digests: list[str] = []
        self.up: tuple[Run, int] | None = None
        self._sides: list[dict] | None = None

    def sides(self, place: int) -> dict:
        """The siblings left and right of a child, each side as one text."""
        if self._sides is None or len(self._sides) < len(self.digests):
            self._sides = [
                {"left": "".join(self.digests[:k]), "right": "".join(self.digests[k + 1:])} for k in range(len(self.digests))
            ]
        return self._sides[place]


class Appender:
    """An aligned subtree of ``levels`` levels that grows by appends."""

    def __init__(self, levels: int):
        self.open = [Run() for _ in range(levels)]
        self.root: str | None = None

    def append(self, digest: str, level: int = 0) -> tuple[Run, int] | None:
        """Where the node went: the handle of its witness, which later appends extend."""
        if level == len(self.open):
            self.root = digest
            return None
        run = self.open[level]
        run.digests.append(digest)
        place = (run, len(run.digests) - 1)
        if len(run.digests) == ARITY:
            self._close(level)
        return place

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], Run()
        run.up = self.append(parent(run.digests), level + 1)

    def finish(self) -> str:
        """Closes what is open, from below; the root."""
        for level, run in enumerate(self.open):
            if self.open[level].digests:
                self._close(level)
        return self.root


def witness(place: tuple[Run, int] | None) -> list[dict]:
    steps = []
    while place is not None:
        steps.append(place[0].sides(place[1]))
        place = place[0].up
    return steps


def height(n: int) -> int:
    """Levels above n nodes; none above one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def _grown(nodes: pa.Table) -> tuple[Appender, list]:
    """One block appended in order. ``n`` counts the nodes of its whole tree at this level."""
    tree = Appender(min(LEVELS, height(nodes.column("n")[0].as_py())))
    places = [tree.append(digest) for digest in nodes.column("digest").to_pylist()]
    tree.finish()
    return tree, places


def _roots(nodes: pa.Table) -> pa.Table:
    nodes = nodes.sort_by("pos")
    made = {
        "tree": nodes.column("tree")[:1], "pos": nodes.column("block")[:1],
        "n": pa.array([-(-nodes.column("n")[0].as_py() // BLOCK)], pa.int64()), "digest": pa.array([_grown(nodes)[0].root]),
    }
    return pa.table(made)


def _witnessed(nodes: pa.Table, above: pa.Table) -> pa.Table:
    """The nodes of a block with their witnesses, extended by that of the block's root."""
    nodes = nodes.sort_by("pos")
    _, places = _grown(nodes)
    further = above.column("witness")[0].as_py()
    steps, ends = [], [0]
    for place in places:
        steps += witness(place)
        steps += further
        ends.append(len(steps))
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(steps, _SIDES))
    same = [pa.array([above.column(c)[0].as_py()] * len(nodes), pa.string()) for c in ("subroot", "root")]
    return pa.table([*(nodes.column(c) for c in ("tree", "pos", "row")), lists, *same], names=["tree", "pos", "row", "witness", "subroot", "root"])


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``pos`` within the tree and ``n``, the tree's size. Rows equal in ``order`` may lie anywhere among themselves."""
    rows = hold(rows).withColumn("tie", F.monotonically_increasing_id())
    dealt = hold(
        rows.repartitionByRange("tree", *order, "tie").sortWithinPartitions("tree", *order, "tie").drop("tie")
        .withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    )
    # A row for each partition and tree in it.
    runs = hold(dealt.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows")))
    whole = Window.partitionBy("tree")
    before = F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("rows")
    runs = runs.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(whole).alias("n"))
    return dealt.join(runs, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _climb(nodes: DataFrame, top) -> DataFrame:
    """(tree, pos, row, witness, subroot, root) for ``nodes`` (tree, pos, n, digest, row).

    ``top`` gets the roots of all trees (tree, pos, n, digest, row) and returns what is above
    them (tree, pos, witness, subroot, root).
    """
    blocks = nodes.select("tree", "pos", "n", "digest", "row", F.expr(f"pos div {BLOCK}").alias("block"))
    roots = held(
        blocks.select("tree", "pos", "n", "digest", "block").groupBy("tree", "block").applyInArrow(_roots, "tree string, pos bigint, n bigint, digest string")
    ).df.withColumn("row", F.struct("pos"))
    largest = roots.agg(F.max("n")).first()[0] or 0
    above = top(roots) if largest <= 1 else _climb(roots, top)
    above = above.select("tree", F.col("pos").alias("block"), "witness", "subroot", "root")
    row = blocks.schema["row"].dataType.simpleString()
    schema = f"tree string, pos bigint, row {row}, witness {WITNESS}, subroot string, root string"
    return blocks.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(_witnessed, schema)


def _nothing() -> Column:
    return F.array().cast(WITNESS)


def _top(subroots: DataFrame) -> DataFrame:
    """What is above the roots of the groups: one tree over them, in the order of their names."""
    leaves = subroots.select(F.lit("").alias("tree"), "digest", F.struct(F.col("tree").alias("of"), F.col("digest").alias("subroot")).alias("row"), F.col("tree").alias("name"))
    up = _climb(
        _placed(leaves, ["name"]),
        lambda roots: roots.select("tree", "pos", _nothing().alias("witness"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root")),
    )
    return hold(up.select(F.col("row.of").alias("tree"), F.lit(0).cast("long").alias("pos"), "witness", "row.subroot", "root"))


def manifest(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, order: str = "doc_id", group: str = "lang", also: dict[str, Column] | None = None,
) -> DataFrame:
    """(``order``, *also, leaf, witness, subroot, root): one row for each row of ``docs``.

    ``witness`` lists, from the leaf's level to the last below ``root``, the digests of the
    siblings left and right of the path, each side as one text (both empty for an only
    child). ``fields`` are what a leaf covers; ``also`` names further columns to carry along.

    Any field may be null; an empty text is ``0:`` and a text of any length is hashed whole.
    Rows with a null group are a tree of their own, before the others; a null ``order`` comes
    first. Rows that share ``order`` lie in the order of their leaves, and wholly equal rows
    are leaves each. An empty table has no leaves and gives no rows. Other columns are
    ignored, whatever their names.
    """
    also = also or {}
    tree = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("+"), F.col(group).cast("string")))
    carried = F.struct(F.col(order), *[c.alias(f"also{k}") for k, c in enumerate(also.values())])
    leaves = docs.select(tree.alias("tree"), F.col(order).alias("key"), leaf_digest(*fields).alias("digest"), carried.alias("row"))
    rows = _climb(_placed(leaves.withColumn("row", F.struct("row", "digest")), ["key", "digest"]), _top)
    inner = F.col("row.row")
    return rows.select(
        inner[order].alias(order), *[inner[f"also{k}"].alias(name) for k, name in enumerate(also)],
        F.col("row.digest").alias("leaf"), "witness", "subroot", "root",
    )


def proof(steps: Column) -> Column:
    """All siblings of a witness, from the leaf up and from left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and a witness lead to; a row is verified if it is the manifest's."""
    return F.aggregate(steps, leaf, lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]), 256))
