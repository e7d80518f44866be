"""Bounded traversals of many start nodes at once: one join for each level.

A level is a join of the frontier with the edges and is written to the shared folder, so the plan stays flat and a
lost executor repeats no earlier level.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.session import cut

# Named groups of edge kinds.
GROUPS = {
    "calls": ("CALLS", "CONSTRUCTS"), "data_access": ("READS_ENTITY", "WRITES_ENTITY", "READS", "WRITES", "USES_REPOSITORY", "REPOSITORY_FOR"),
    "events": ("PUBLISHES_EVENT", "LISTENS_TO_EVENT"), "dependencies": ("INJECTS", "SELECTED_BEAN", "BEAN_CANDIDATE"),
    "routes": ("EXPOSES_ROUTE", "HANDLED_BY"), "types": ("REFERENCES_TYPE", "ACCEPTS_TYPE", "RETURNS_TYPE", "EXTENDS", "IMPLEMENTS"), "imports": ("IMPORTS",),
}


def edge_kinds(groups: list[str], kinds: list[str]) -> list[str]:
    """The kinds of the named groups and the given ones, each once. Unknown groups are an error."""
    if unknown := sorted(set(groups) - set(GROUPS)):
        raise ValueError(f"unknown edge groups: {unknown}")
    return sorted({k for g in groups for k in GROUPS[g]} | set(kinds))


def steps(edges: DataFrame, kinds: list[str], inbound: bool = False) -> DataFrame:
    """(project, node, next, kind): the edges of the kinds, in the direction of the traversal."""
    ends = ("target", "source") if inbound else ("source", "target")
    return edges.where(F.col("kind").isin(*kinds)).select("project", F.col(ends[0]).alias("node"), F.col(ends[1]).alias("next"), "kind")


def all_paths(starts: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(project, start, node, depth, path, closed) of every path without a repeated node, up to the depth.

    closed holds if the path can't be continued: no further edge, or only ones back into it. Edges back into the path
    are left out. edges are steps(); hidden neighbours are left out by filtering them before.
    """
    live = starts.select("project", F.col("stable_id").alias("start"), F.col("stable_id").alias("node"), F.lit(0).alias("depth"), F.array("stable_id").alias("path"))
    found = []
    hops = cut(edges.select("project", "node", "next").distinct())
    for _ in range(depth + 1):
        live = cut(live)
        found.append(live)
        live = live.join(hops, ["project", "node"]).where(~F.array_contains("path", F.col("next"))).select(
            "project", "start", F.col("next").alias("node"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("next")).alias("path")
        )
    paths = found[0]
    for level in found[1:]:
        paths = paths.unionByName(level)
    onward = paths.where("depth > 0").select("project", F.slice("path", F.lit(1), F.size("path") - 1).alias("path")).distinct().withColumn("on", F.lit(True))
    return paths.join(onward, ["project", "path"], "left").select("project", "start", "node", "depth", "path", F.col("on").isNull().alias("closed"))


def traces(starts: DataFrame, hops: DataFrame, depth: int, shortest: bool = False) -> tuple[DataFrame, DataFrame]:
    """Paths with the kinds of their edges, and counts of what was left out.

    hops are (project, node, next, kind, hidden, wanted): hidden neighbours are counted and left out, then those that
    aren't wanted, then those that lead back into the path, which are counted. The first result is (project, start, node,
    depth, path, kinds) of the paths that can't be continued, the second (project, start, n_cycles, n_hidden, n_visited).
    With shortest a node continues only the first path on which a start meets it: at the least depth, then in order of
    the edges' kinds and nodes.
    """
    hops = cut(hops.select("project", "node", "next", "kind", "hidden", "wanted").distinct())
    live = cut(starts.select("project", F.col("stable_id").alias("start"), F.col("stable_id").alias("node"), F.lit(0).alias("depth"), F.array("stable_id").alias("path"), F.array().cast("array<string>").alias("kinds")).distinct())
    seen, tallies, ended, visited = live.select("project", "start", "node"), [], [], [live.select("project", "start", "node")]
    for level in range(1, depth + 1):
        onward = cut(live.join(hops, ["project", "node"]).withColumn("back", F.array_contains("path", F.col("next"))))
        shown = onward.where("NOT hidden AND wanted")
        tallies.append(onward.where("hidden OR wanted").groupBy("project", "start").agg(F.count_if(~F.col("hidden") & F.col("back")).alias("n_cycles"), F.count_if("hidden").alias("n_hidden")))
        further = shown.where("NOT back").select(
            "project", "start", F.col("next").alias("node"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("next")).alias("path"), F.concat("kinds", F.array("kind")).alias("kinds"), F.col("path").alias("before")
        )
        if shortest:
            first = F.struct(F.zip_with(F.col("kinds"), F.slice("path", 2, depth + 1), lambda k, n: F.struct(k.alias("k"), n.alias("n"))).alias("order"), "depth", "path", "kinds", "before")
            met = further.join(seen, ["project", "start", "node"], "left_anti").groupBy("project", "start", "node").agg(F.min(first).alias("f"))
            further = met.select("project", "start", "node", "f.depth", "f.path", "f.kinds", "f.before")
        further = cut(further)
        ended.append(live.join(further.select("project", "start", F.col("before").alias("path")).distinct(), ["project", "start", "path"], "left_anti"))
        live = further.drop("before")
        visited.append(live.select("project", "start", "node"))
        if shortest:
            seen = cut(seen.unionByName(visited[-1]), bounded=True)
    paths = functools.reduce(DataFrame.unionByName, ended, live)
    met = functools.reduce(DataFrame.unionByName, visited).distinct().groupBy("project", "start").agg(F.count(F.lit(1)).alias("n_visited"))
    counts = functools.reduce(DataFrame.unionByName, tallies).groupBy("project", "start").agg(F.sum("n_cycles").alias("n_cycles"), F.sum("n_hidden").alias("n_hidden"))
    return paths.select("project", "start", "node", "depth", "path", "kinds").distinct(), met.join(counts, ["project", "start"], "left").fillna({"n_cycles": 0, "n_hidden": 0})


def reached(starts: DataFrame, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(project, start, node, depth): each node that a start reaches, with the least number of edges; not the start itself.

    Without a depth the closure is complete. edges are steps().
    """
    hops = cut(edges.select("project", "node", "next").distinct())
    live = starts.select("project", F.col("stable_id").alias("start"), F.col("stable_id").alias("node")).distinct()
    seen = cut(live.withColumn("depth", F.lit(0)))
    live, level = seen, 0
    while (depth is None or level < depth) and live.head(1):
        level += 1
        new = live.join(hops, ["project", "node"]).select("project", "start", F.col("next").alias("node")).distinct()
        live = cut(new.join(seen, ["project", "start", "node"], "left_anti").withColumn("depth", F.lit(level)))
        seen = cut(seen.unionByName(live), bounded=True)
    return seen.where("depth > 0")


def entry_points(nodes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """(project, stable_id) of the nodes with outgoing but without incoming edges of the kind."""
    own = edges.where(F.col("kind") == kind)
    out = own.select("project", F.col("source").alias("stable_id"))
    into = own.where("source <> target").select("project", F.col("target").alias("stable_id"))
    return nodes.select("project", "stable_id").join(out, ["project", "stable_id"], "left_semi").join(into, ["project", "stable_id"], "left_anti")


def branch_points(edges: DataFrame) -> DataFrame:
    """(project, node, n_next): the nodes of steps() with more than one way on."""
    return edges.groupBy("project", "node").agg(F.count_distinct("next").alias("n_next")).where("n_next > 1")


def injection_candidates(edges: DataFrame) -> DataFrame:
    """(project, consumer, required, n_candidates, candidate): the types that can be injected for each INJECTS edge.

    Candidates are the required type's known subtypes, over EXTENDS and IMPLEMENTS in any number of steps; candidate is
    the only one, and null where there is none or several.
    """
    wanted = edges.where("kind = 'INJECTS'").select("project", F.col("source").alias("consumer"), F.col("target").alias("required"))
    needed = wanted.select("project", F.col("required").alias("stable_id")).distinct()
    subtypes = reached(needed, steps(edges, ["EXTENDS", "IMPLEMENTS"], inbound=True))
    per = subtypes.where("node <> start").groupBy("project", F.col("start").alias("required")).agg(F.count(F.lit(1)).alias("n_candidates"), F.min("node").alias("only"))
    both = wanted.join(per, ["project", "required"], "left").fillna({"n_candidates": 0})
    return both.select("project", "consumer", "required", "n_candidates", F.when(F.col("n_candidates") == 1, F.col("only")).alias("candidate"))
