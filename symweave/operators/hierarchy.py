"""Parent-child links to full hierarchies (problem 4).

Leaves are peeled off and only add weight to their parents. What is left forms Euler tours, linked lists whose parallel
ranking gives each node's entry and exit, from which follow depth, ancestors and descendants. The tour of a tree begins
at its root; one that leads around a cycle never begins, which is how cycles come out, with all that hangs below them.
An element is followed by one other at most, so no key of the ranking is hot, whatever the shape of the trees.

Nodes with several parents are the roots of parts of their own at first. Between the parts there is one link for each
of these parents, and taking away parts without a parent, again and again, leaves those on or below a cycle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symweave.operators.lists import rank_lists
from symweave.session import cut, cut_counted

#: Stands for all nodes of tours that never begin.
RING = -1


def parent_links(edges: DataFrame, kind: str = "DECLARES") -> DataFrame:
    """(project, parent, child): the distinct links of the kind, whatever its case and surrounding spaces."""
    named = F.upper(F.trim("kind")) == kind
    present = F.col("project").isNotNull() & F.col("source_stable_id").isNotNull() & F.col("target_stable_id").isNotNull()
    return edges.where(named & present).select("project", F.col("source_stable_id").alias("parent"), F.col("target_stable_id").alias("child")).distinct()


@dataclass
class Forest:
    """nodes (project, stable_id, id) and arcs (parent, child) by id."""

    nodes: DataFrame
    arcs: DataFrame


def forest(links: DataFrame) -> Forest:
    """The links by id."""
    links = cut(links)
    names = links.select("project", F.col("parent").alias("stable_id")).union(links.select("project", "child")).distinct()
    nodes = cut(names.withColumn("id", F.monotonically_increasing_id()))
    by = lambda end: nodes.select("project", F.col("stable_id").alias(end), F.col("id").alias(f"{end}_id"))
    arcs = cut(links.join(by("parent"), ["project", "parent"]).join(by("child"), ["project", "child"]).select(F.col("parent_id").alias("parent"), F.col("child_id").alias("child")))
    return Forest(nodes, arcs)


def _below_cycles(arcs: DataFrame) -> DataFrame:
    """(id) of the nodes on and below cycles: what is left after nodes without a parent were taken away, again and again."""
    arcs, n = cut_counted(arcs, F.lit(True))
    while n:
        left = arcs
        for _ in range(2):
            left = left.join(left.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi")
        arcs, now = cut_counted(left.select("parent", "child"), F.lit(True))
        if now == n:
            break
        n = now
    return arcs.select(F.col("child").alias("id")).distinct()


def _siblings(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with nth, parts) of children (parent, child, name): each one's place among its siblings, from 0.

    Siblings follow each other by a hash prefix of their name, then by name: the prefix splits a parent with any
    number of children into bounded parts, which are put in order afterwards. parts are (parent, n_children).
    """
    salted = rows.withColumn("salt", F.substring(F.md5("name"), 1, 2))
    within = Window.partitionBy("parent", "salt").orderBy("name")
    order = Window.partitionBy("parent").orderBy("salt")
    sizes = salted.groupBy("parent", "salt").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("parent", "salt", (F.sum("n").over(order) - F.col("n")).alias("offset"))
    placed = salted.withColumn("own", F.row_number().over(within) - 1).join(offsets, ["parent", "salt"])
    return placed.withColumn("nth", F.col("offset") + F.col("own")).drop("salt", "own", "offset"), sizes.groupBy("parent").agg(F.sum("n").alias("n_children"))


def _tours(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, root, entry, exit, depth) of every node, from the Euler tours of (parent, child, name), where a node has one parent.

    The children of a node come leaves first. Leaves need no elements of their own: those of a node only add to its
    weight, and their places follow from their parent's. A node v with further inner nodes below enters as element
    2 v and leaves as 2 v + 1; one with leaves alone is the one element 2 v. Where a tour leads around a cycle, root is
    null and the numbers say nothing.
    """
    parents = tree.select(F.col("parent").alias("child")).distinct().withColumn("inner", F.lit(True))
    marked = cut(tree.join(parents, "child", "left"))
    leaves, n_leaves = _siblings(marked.where("inner IS NULL").drop("inner"))
    branches, n_branches = _siblings(marked.where("inner").drop("inner"))
    branches = cut(branches)
    # Each inner node and each root, with the number of its leaves and of its inner children.
    inner = parents.select(F.col("child").alias("id")).union(nodes.join(tree.select(F.col("child").alias("id")), "id", "left_anti")).distinct()
    count = lambda df, name: df.select(F.col("parent").alias("id"), F.col("n_children").alias(name))
    inner = cut(inner.join(count(n_leaves, "n_leaves"), "id", "left").join(count(n_branches, "n_branches"), "id", "left").fillna(0))
    # The element with which a node ends: its leaving, or its only one.
    end = (2 * F.col("id") + F.when(F.col("n_branches") > 0, 1).otherwise(0)).alias("end")
    ended = branches.join(inner.select(F.col("id").alias("child"), end), "child")
    before = ended.select("parent", (F.col("nth") + 1).alias("nth"), F.col("end").alias("before"))
    linked = ended.join(before, ["parent", "nth"], "left").select(F.col("child").alias("id"), F.coalesce("before", 2 * F.col("parent")).alias("previous"))
    whole = F.col("n_branches") == 0
    entering = inner.join(linked, "id", "left").select(
        (2 * F.col("id")).alias("id"), "previous", (F.when(whole, 2).otherwise(1) + 2 * F.col("n_leaves")).cast("bigint").alias("at"), F.when(whole, 0).otherwise(1).cast("bigint").alias("depth")
    )
    last = ended.join(count(n_branches, "n").select(F.col("id").alias("parent"), (F.col("n") - 1).alias("nth")), ["parent", "nth"])
    leaving = last.select((2 * F.col("parent") + 1).alias("id"), F.col("end").alias("previous"), F.lit(1).cast("bigint").alias("at"), F.lit(-1).cast("bigint").alias("depth"))
    ranks = rank_lists(entering.unionByName(leaving), ["at", "depth"])

    even = F.col("id") % 2 == 0
    spans = ranks.groupBy(F.shiftright("id", 1).alias("id")).agg(
        F.max(F.when(even, F.shiftright("head", 1))).alias("root"), F.max(F.when(even, F.col("at"))).alias("a"), F.max(F.when(~even, F.col("at"))).alias("b"), F.max(F.when(even, F.col("depth"))).alias("d")
    )
    # The sums count the element itself: what a node enters with, or all of it.
    own = F.when(whole, 2).otherwise(1) + 2 * F.col("n_leaves")
    placed = cut(spans.join(inner, "id").select(
        "id", "root", (F.col("a") - own).alias("entry"), F.when(whole, F.col("a") - 1).otherwise(F.col("b") - 1).alias("exit"), (F.col("d") - F.when(whole, 0).otherwise(1)).alias("depth")
    ))
    under = leaves.select("parent", "child", "nth").join(placed.withColumnRenamed("id", "parent"), "parent")
    first = F.col("entry") + 1 + 2 * F.col("nth")
    return placed.unionByName(under.select(F.col("child").alias("id"), "root", first.alias("entry"), (first + 1).alias("exit"), (F.col("depth") + 1).alias("depth")))


def toured(f: Forest) -> DataFrame:
    """(id, parent, root, depth, entry, exit, in_cycle) of every node of the links.

    in_cycle holds for nodes on a cycle or below one, over all parents; these have no place. The tree takes the parent
    of least id where a node has several.
    """
    names = f.nodes.select(F.col("id").alias("child"), F.col("stable_id").alias("name"))
    parents, several = cut_counted(f.arcs.groupBy("child").agg(F.min("parent").alias("parent"), F.count(F.lit(1)).alias("n")).join(names, "child"), F.col("n") > 1)
    spans = _tours(parents.where("n = 1").select("parent", "child", "name"), f.nodes.select("id"))
    if several:
        parts = cut(spans.select("id", F.coalesce("root", F.lit(RING)).alias("part")))
        between = f.arcs.join(parents.where("n > 1").select("child"), "child", "left_semi").join(parts.withColumnRenamed("id", "parent"), "parent").select(F.col("part").alias("parent"), "child").distinct()
        ring = f.nodes.sparkSession.range(RING, RING + 1).select(F.col("id").alias("parent"), F.col("id").alias("child"))
        bad = cut(parts.join(_below_cycles(between.union(ring)).withColumnRenamed("id", "part"), "part", "left_semi").select("id"))
        placed = _tours(parents.join(bad.withColumnRenamed("id", "child"), "child", "left_anti").select("parent", "child", "name"), f.nodes.select("id").join(bad, "id", "left_anti"))
        spans = placed.unionByName(bad, allowMissingColumns=True)
    return spans.join(parents.select(F.col("child").alias("id"), "parent"), "id", "left").withColumn("in_cycle", F.col("root").isNull())


def paths(tour: DataFrame) -> DataFrame:
    """(id, path): the stable_ids from the root down to each node of a tour without cycles, by pointer jumping.

    A node that many others look back to at once is split by Spark's own handling of skewed joins.
    """
    more = F.col("parent").isNotNull()
    state, left = cut_counted(tour.select("id", "parent", F.array("stable_id").alias("path")), more)
    while left:
        above = state.select(F.col("id").alias("parent"), F.col("parent").alias("next"), F.col("path").alias("upper"))
        longer = state.where(more).join(above, "parent").select("id", F.col("next").alias("parent"), F.concat("upper", "path").alias("path"))
        state, left = cut_counted(state.where(~more).unionByName(longer), more, bounded=True)
    return state.select("id", "path")


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """(project, stable_id): the nodes on a cycle of parent links (a link to itself is one) or below such a cycle.

    Links with a null project or endpoint are none; repeated links count once.
    """
    f = forest(parent_links(edges))
    return f.nodes.join(toured(f).where("in_cycle").select("id"), "id").select("project", "stable_id")


def hierarchies(edges: DataFrame) -> DataFrame:
    """(project, stable_id, root, depth, path, entry, exit, n_descendants) of every node without a cycle above it.

    path holds the stable_ids from the root to the node. The descendants of a node are the nodes of the same root with
    an entry between its entry and exit. Nodes on or below a cycle have none of this and are given by cyclic_nodes.
    """
    f = forest(parent_links(edges))
    tour = cut(f.nodes.join(toured(f).where("NOT in_cycle"), "id"))
    placed = tour.join(paths(tour), "id")
    return placed.select("project", "stable_id", F.col("path")[0].alias("root"), "depth", "path", "entry", "exit", F.expr("(exit - entry - 1) div 2").alias("n_descendants"))


def descendants(hierarchy: DataFrame) -> DataFrame:
    """(project, ancestor, descendant, distance) of every pair in hierarchies(), from the paths."""
    pairs = hierarchy.select("project", F.col("stable_id").alias("descendant"), "depth", F.posexplode("path").alias("at", "ancestor")).where("at < depth")
    return pairs.select("project", "ancestor", "descendant", (F.col("depth") - F.col("at")).alias("distance"))
