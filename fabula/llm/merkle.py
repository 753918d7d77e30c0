"""Merkle manifest of a table: a leaf for each row, a tree for each group, a tree over the groups' roots,
and for each row the siblings that lead from its leaf to the root.

A level is one window: partitioned by group and parent index, an ordered collect_list over the whole
frame (at most ``FAN`` digests) holds both the parent's preimage and a node's siblings.  Parents are
one row for each run, so that a level has an eighth of the rows of the one below.  No group is ever
in one task: leaves are numbered in ranges of (group, order), and every join is by group and parent.

The way to the root is shared by all rows of a run, so it is put together from the top down, once for
each node, and reaches the leaves in a single join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.llm.shared import written

#: Consecutive nodes that become one.
FAN = 8


def sha256(*parts: Column) -> Column:
    """Lowercase hex digest of the parts one after another."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return sha256(*map(field, values))


def folded(start: Column, path: Column) -> Column:
    """The root that ``start`` leads to with the siblings of ``path``."""
    return F.aggregate(path, start, lambda h, p: sha256(p["before"], h, p["after"]))


def proof(path: Column) -> Column:
    """Digest of all siblings, from the leaf's to the last, each level from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), ""), 256)


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``index`` (place in the ``group``, from 0) and ``n`` (size of the group).

    Rows are dealt out by ranges of group and order, written with the number of their range, and then
    numbered range by range: the ranges of a group, however large, are numbered at the same time.
    ``rows`` is read twice (once to find the ranges)."""
    ranges = rows.repartitionByRange("group", *order).withColumn("range", F.spark_partition_id())
    ranges = written(ranges, "ranges")
    sizes = ranges.groupBy("group", "range").agg(F.count(F.lit(1)).alias("size"))
    group = Window.partitionBy("group")
    before = group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("group", "range", F.sum("size").over(group).alias("n"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("group", "range").orderBy(*order)
    placed = ranges.withColumn("within", F.row_number().over(within)).join(sizes.hint("merge"), ["group", "range"])
    return written(placed.withColumn("index", F.col("first") + F.col("within") - 1).drop("range", "first", "within"), "leaves")


def _runs(nodes: DataFrame) -> DataFrame:
    """Add ``parent`` and ``run``: the digests of a node's run, its own among them."""
    nodes = nodes.withColumn("parent", F.expr(f"index div {FAN}"))
    frame = Window.partitionBy("group", "parent").orderBy("index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return nodes.withColumn("run", F.collect_list("node").over(frame))


def _levels(leaves: DataFrame) -> list[DataFrame]:
    """The nodes of each level: group, n, index, node (the leaves with all their columns).  A group ends at the level where it has one node."""
    levels = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 1  # one number
    while most > 1:
        runs = _runs(levels[-1].filter("n > 1").select("group", "n", "index", "node"))
        parents = runs.filter(f"index % {FAN} = 0")  # one row for each run
        above = parents.select("group", F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), F.col("parent").alias("index"), sha256(F.array_join("run", "")).alias("node"))
        levels.append(written(above, "level"))
        most = -(-most // FAN)
    return levels


def _descended(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves with ``path``, ``subroot`` and ``root``; ``tops`` has these for each group's last node."""
    place = F.expr(f"cast(index % {FAN} as int)")
    step = F.struct(F.array_join(F.slice("run", F.lit(1), place), "").alias("before"), F.array_join(F.slice("run", place + 2, F.lit(FAN)), "").alias("after"))
    found: DataFrame | None = None
    for k in range(len(levels) - 1, -1, -1):
        last = levels[k].filter("n = 1").join(tops, "group")
        if found is None:
            found = last
        else:
            above = found.select("group", F.col("index").alias("parent"), F.col("path").alias("above"), "subroot", "root")
            inner = _runs(levels[k].filter("n > 1")).join(above, ["group", "parent"])
            found = inner.withColumn("path", F.concat(F.array(step), "above")).drop("parent", "run", "above").unionByName(last)
        if k:
            found = written(found, "paths")
    return found


def manifest(rows: DataFrame, group: Column, order: str, leaf: Column, carry: dict[str, Column] | None = None) -> DataFrame:
    """For each row: ``order``'s column, ``leaf``, ``subroot`` (of its group), ``root``, ``path`` (an array of
    the digests before and after it, level by level) and the columns of ``carry``.

    Within a group, leaves ascend by ``order`` (null first), ties by leaf and the carried columns; rows alike in all of them
    are interchangeable and each have a leaf.  Groups are ordered by name, null first, bytewise; a null group is a group of
    its own and not the empty one.  A group of one row has its leaf as its subroot, a table of one group its subroot as its
    root.  An empty table gives an empty result.  Other columns of ``rows`` take no part, whatever their names.
    """
    carried = {order: F.col(f"`{order}`"), **(carry or {})}
    own = {f"own{i}": c for i, c in enumerate(carried.values())}
    # Null, then names, in bytewise order.
    name = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))
    leaves = written(rows.select(name.alias("group"), leaf.alias("node"), *[c.alias(k) for k, c in own.items()]), "digests")
    levels = _levels(_numbered(leaves, ["own0", "node", *list(own)[1:]]))

    subroots = reduce(DataFrame.unionByName, [x.filter("n = 1").select("group", "node") for x in levels])
    roots = _levels(_numbered(subroots.select(F.lit("").alias("group"), F.col("group").alias("name"), "node"), ["name"]))
    nothing = F.expr("cast(array() as array<struct<before:string,after:string>>)")
    top = roots[-1].filter("n = 1").select("group", nothing.alias("path"), F.col("node").alias("subroot"), F.col("node").alias("root"))
    tops = _descended(roots, top).select(F.col("name").alias("group"), F.col("node").alias("subroot"), "path", "root")

    found = _descended(levels, written(tops, "tops"))
    return found.select(F.col("own0").alias(order), F.col("node").alias("leaf"), "subroot", "root", "path", *[F.col(k).alias(c) for k, c in list(zip(own, carried, strict=True))[1:]])
