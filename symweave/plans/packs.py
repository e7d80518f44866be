"""The public answers, each composed of operators: project map, symbol, trace, evidence and status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.functions import names
from symweave.operators import counts, symbols, traverse
from symweave.operators import evidence as ev
from symweave.plans import graph


def _section(df: DataFrame, name: str, item: str, n: str) -> DataFrame:
    return df.select("project", F.lit(name).alias("section"), F.col(item).alias("item"), F.col(n).cast("bigint").alias("n"))


def project_map(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, section, item, n): kinds of symbols and edges, the first areas, framework roles, modules and source sets of every project.

    nodes and edges are rows as loaded.
    """
    current, merged = graph.current_nodes(nodes), graph.merged_edges(edges)
    areas = counts.application_areas(counts.package_metrics(current, merged))
    modules = counts.kind_counts(current.where("module_name IS NOT NULL"), ["project", "module_name"])
    sets = counts.test_symbols(current).where("source_set IS NOT NULL")
    parts = [
        _section(counts.kind_counts(current, ["project", "kind"]), "symbols", "kind", "n"), _section(counts.kind_counts(merged, ["project", "kind"]), "edges", "kind", "n"),
        _section(areas, "areas", "package", "n_components"), _section(counts.framework_counts(current, merged), "framework", "role", "n"), _section(modules, "modules", "module_name", "n"), _section(sets, "source sets", "source_set", "n"),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def symbol(nodes: DataFrame, edges: DataFrame, project: str, stable_id: str, depth: int = 1, occurrences: int = 10) -> dict[str, DataFrame]:
    """One symbol's row, its counts of context, its edges with the first rows of evidence, and what it calls within the application.

    An unknown symbol gives empty results.
    """
    own_nodes, own_edges = nodes.where(F.col("project") == project), edges.where(F.col("project") == project)
    touching = own_edges.where((F.col("source_stable_id") == stable_id) | (F.col("target_stable_id") == stable_id))
    current = graph.current_nodes(own_nodes)
    start = current.where(F.col("stable_id") == stable_id)
    shown = current.where(names.is_application(F.col("file_path"), F.col("stable_id"))).select("project", F.col("stable_id").alias("next"))
    calls = traverse.steps(graph.merged_edges(own_edges), ["CALLS"]).join(shown, ["project", "next"], "left_semi")
    return {
        "symbol": start,
        "context": symbols.context_counts(start, graph.merged_edges(touching)),
        "evidence": ev.first_occurrences(graph.edge_occurrences(touching), occurrences),
        "callees": traverse.reached(start.select("project", "stable_id"), calls, depth),
    }


def trace(nodes: DataFrame, edges: DataFrame, starts: DataFrame, kinds: list[str] | None = None, groups: list[str] | None = None, inbound: bool = False, depth: int = 3, application_only: bool = True) -> DataFrame:
    """All bounded paths from the given (project, stable_id), over the named kinds and groups of edges.

    With application_only neighbours without a file are hidden. depth is 1 to 5.
    """
    if not 1 <= depth <= 5:
        raise ValueError("depth is 1 to 5")
    hops = traverse.steps(graph.merged_edges(edges), traverse.edge_kinds(groups or [], kinds or []), inbound)
    if application_only:
        shown = graph.current_nodes(nodes).where("file_path IS NOT NULL").select("project", F.col("stable_id").alias("next"))
        hops = hops.join(shown, ["project", "next"], "left_semi")
    return traverse.all_paths(starts, hops, depth)


def index_status(projects: DataFrame, generations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per registered project: its name and language, its active generation and how that agrees with its summary."""
    active = counts.active_generations(generations)
    said = counts.generation_reconciliation(nodes, generations).select("project_id", F.col("generation").alias("active_generation"), "n_emitted", "n_nodes", "agrees")
    named = projects.select("project_id", "display_name", "language")
    return named.join(active, "project_id", "left").join(said.distinct(), ["project_id", "active_generation"], "left").select(
        "project_id", "display_name", "language", "active_generation", "stale", "n_failed_since", "n_emitted", "n_nodes", "agrees"
    )


def evidence(asked: DataFrame, places: DataFrame, texts: DataFrame, budget: int, context: int = 2, generation: int = 1) -> DataFrame:
    """(repo, evidence_id, file_path, start_line, end_line, n_context, line, text): the lines of evidence asked for by identifier, with lines around them.

    asked are (repo, nth, evidence_id), places (repo, file_path, start_line, end_line), texts (repo, file_path, text). A
    repository's requests share so many lines of context, used up in order; identifiers without a place give no rows.
    """
    known = ev.with_evidence_id(places.select("repo", "file_path", "start_line", "end_line").distinct(), generation)
    found = asked.select("repo", "nth", "evidence_id").distinct().join(known, ["repo", "evidence_id"]).where("start_line > 0 AND end_line >= start_line")
    given = ev.shared_budget(found.withColumn("want", F.lit(2 * context)), ["repo"], ["nth", "evidence_id", "file_path"], "want", budget).withColumn("n_context", F.expr("taken div 2"))
    wide = given.select("repo", "evidence_id", "file_path", F.greatest(F.col("start_line") - F.col("n_context"), F.lit(1)).cast("int").alias("start_line"), (F.col("end_line") + F.col("n_context")).cast("int").alias("end_line"))
    lines = ev.numbered_lines(wide, texts, ["repo", "file_path"], 0).withColumnsRenamed({"start_line": "from_line", "end_line": "to_line"})
    keyed = given.withColumns({"from_line": F.greatest(F.col("start_line") - F.col("n_context"), F.lit(1)).cast("int"), "to_line": (F.col("end_line") + F.col("n_context")).cast("int")})
    return keyed.join(lines, ["repo", "file_path", "from_line", "to_line"]).select("repo", "evidence_id", "file_path", "start_line", "end_line", F.col("n_context").cast("int").alias("n_context"), "line", "text")
