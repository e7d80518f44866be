"""Counts and metrics of the graph, its diagnostics and its generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symweave.functions import names


def kind_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def kind_sums(rows: DataFrame, by: list[str], sums: dict[str, tuple[str, ...]]) -> DataFrame:
    """(by, ..): how many rows are of some kinds together, whatever their case."""
    return rows.groupBy(*by).agg(*(F.count_if(F.lower("kind").isin(*kinds)).alias(name) for name, kinds in sums.items()))


def generation_lifecycle(generations: DataFrame, longest: int) -> DataFrame:
    """Per project: the number of its next generation, those being built, whether one may begin, stale ones, and a bounded failure."""
    once = generations.select("project_id", "generation", "state", "failure_summary").distinct()
    building = F.count_if(F.col("state") == "BUILDING")
    return once.groupBy("project_id").agg(
        (F.coalesce(F.max("generation"), F.lit(0)) + 1).alias("next_generation"), building.alias("n_building"), (building == 0).alias("may_begin"), F.count_if(F.col("state") == "STALE").alias("n_stale"),
        F.max(F.when(F.col("state") == "FAILED", names.bounded(F.col("failure_summary"), longest))).alias("last_failure"),
    )


def diagnostic_counts(diagnostics: DataFrame) -> DataFrame:
    """Per repo, kind and severity; rows delivered twice count once, the severity may be null."""
    once = diagnostics.select("request_id", "ordinal", "repo", F.upper(F.trim("kind")).alias("kind"), "severity").distinct()
    return kind_counts(once, ["repo", "kind", "severity"])


def graph_status(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per project: nodes, nodes with something unresolved, edges, and their evidence rows."""
    zero = F.lit(0).cast("bigint")
    n = nodes.groupBy("project").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.size("unresolved") > 0).alias("n_unresolved"), zero.alias("n_edges"), zero.alias("n_occurrences"))
    e = edges.groupBy("project").agg(zero.alias("n_nodes"), zero.alias("n_unresolved"), F.count(F.lit(1)).alias("n_edges"), F.sum("n_occurrences").alias("n_occurrences"))
    return n.unionByName(e).groupBy("project").agg(*(F.sum(c).alias(c) for c in ("n_nodes", "n_unresolved", "n_edges", "n_occurrences")))


#: Counts of package_metrics by the kind of component.
COMPONENTS = {"ROUTE": "n_routes", "REPOSITORY": "n_repositories", "ENTITY": "n_entities", "BEAN": "n_beans", "EVENT_TYPE": "n_events", "CONFIG_PROPERTY": "n_configuration"}


def package_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per project and package with located symbols: framework components, in all and by kind, inner edges, and its roles.

    Edges count whether their ends have a file or not. roles are names between commas.
    """
    located = nodes.where("file_path IS NOT NULL AND package_name IS NOT NULL").groupBy("project", F.col("package_name").alias("package")).agg(
        F.count_if(F.col("kind").isin(*COMPONENTS)).alias("n_components"), *(F.count_if(F.col("kind") == k).alias(name) for k, name in COMPONENTS.items())
    )
    place = lambda end: nodes.select("project", F.col("stable_id").alias(end), F.col("package_name").alias(f"{end}_package"))
    internal = (
        edges.select("project", "source", "target").join(place("source"), ["project", "source"]).join(place("target"), ["project", "target"])
        .where("source_package = target_package").groupBy("project", F.col("source_package").alias("package")).agg(F.count(F.lit(1)).alias("n_internal"))
    )
    roles = {"web": "n_routes > 0", "service": "n_beans > 0", "data": "n_repositories + n_entities > 0", "events": "n_events > 0", "configuration": "n_configuration > 0"}
    named = F.concat_ws(",", *(F.when(F.expr(condition), name) for name, condition in roles.items()))
    return located.join(internal, ["project", "package"], "left").fillna({"n_internal": 0}).withColumn("roles", named)


def application_areas(metrics: DataFrame, limit: int = 12) -> DataFrame:
    """The first packages of each project by components, inner edges and routes; those of libraries and those with nothing are left out after the cut."""
    w = Window.partitionBy("project").orderBy(F.desc("n_components"), F.desc("n_internal"), F.desc("n_routes"), "package")
    ranked = metrics.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= limit)
    outside = F.lit(False)
    for prefix in names.EXTERNAL:
        outside = outside | F.col("package").startswith(prefix)
    return ranked.where(~outside & ((F.col("n_components") > 0) | (F.col("n_internal") > 0)))


def framework_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, role, n) of every project with symbols: controllers (types that expose a route), services, repositories, entities, routes and beans."""
    service = (F.col("kind") == "BEAN") & F.coalesce(F.lower(F.get_json_object("metadata", "$.stereotype")).contains("service"), F.lit(False))
    by_kind = nodes.groupBy("project").agg(
        F.count_if(service).alias("services"), *(F.count_if(F.col("kind") == k).alias(n) for k, n in (("REPOSITORY", "repositories"), ("ENTITY", "entities"), ("ROUTE", "routes"), ("BEAN", "beans")))
    )
    exposing = edges.where("kind = 'EXPOSES_ROUTE'").groupBy("project").agg(F.count_distinct("source").alias("controllers"))
    both = by_kind.join(exposing, "project", "left").fillna({"controllers": 0})
    return both.unpivot("project", ["controllers", "services", "repositories", "entities", "routes", "beans"], "role", "n")


def test_symbols(nodes: DataFrame) -> DataFrame:
    """Per project: symbols by source set, and those that are tests by their path or metadata."""
    path = F.replace("file_path", F.lit("\\"), F.lit("/"))
    is_test = F.coalesce(path.startswith("tests/"), F.lit(False)) | F.coalesce(F.get_json_object("metadata", "$.test") == "true", F.lit(False))
    return nodes.groupBy("project", F.get_json_object("metadata", "$.source_set").alias("source_set")).agg(F.count(F.lit(1)).alias("n"), F.count_if(is_test).alias("n_tests"))


def upper_median(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, median) with the element at n div 2 of the ordered numbers, nulls dropped; exact.

    The values are counted by steps of their order of magnitude first, some hundred for each group; only those of the
    step with the median are put in order, after equal ones were counted, so no task orders a whole group.
    """
    v = F.col(value)
    # Eighths of a binary order of magnitude; the sign comes first.
    step = (F.signum(v) * (1 + F.floor(8 * F.log2(F.greatest(F.abs(v.cast("double")), F.lit(1.0)))))).cast("int")
    present = rows.where(v.isNotNull()).select(*by, v, step.alias("step"))
    counted = present.groupBy(*by, "step").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*by)
    steps = counted.select(*by, "step", F.sum("c").over(w).alias("n"), (F.sum("c").over(w.orderBy("step")) - F.col("c")).alias("below"), "c")
    middle = steps.where("below <= n div 2 AND below + c > n div 2").select(*(F.col(b).alias(f"m_{b}") for b in by), F.col("step").alias("m_step"), "n", "below")
    same = F.col("step") == F.col("m_step")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"m_{b}"))
    values = present.join(middle, same).groupBy(*by, value, "n", "below").agg(F.count(F.lit(1)).alias("c"))
    upto = values.withColumn("upto", F.col("below") + F.sum("c").over(w.orderBy(value)))
    return upto.where("upto > n div 2 AND upto - c <= n div 2").select(*by, "n", v.alias("median"))


def paired_reduction(medians: DataFrame, by: list[str], mode: str, base: str, other: str) -> DataFrame:
    """100 * (base - other) / base of the medians of two modes; pairs without a positive base are left out."""
    wide = medians.groupBy(*by).agg(*(F.max(F.when(F.col(mode) == m, F.col("median"))).alias(n) for n, m in (("base", base), ("other", other))))
    return wide.where("base > 0 AND other IS NOT NULL").withColumn("reduction", 100.0 * (F.col("base") - F.col("other")) / F.col("base"))


def generation_reconciliation(nodes: DataFrame, generations: DataFrame) -> DataFrame:
    """Per generation: its state, the nodes its summary speaks of, those there are, and whether they agree."""
    there = nodes.groupBy("project_id", "generation").agg(F.count_distinct("stable_id").alias("n_nodes"))
    said = generations.select("project_id", "generation", "state", F.get_json_object("summary_json", "$.nodes_emitted").cast("bigint").alias("n_emitted")).distinct()
    both = said.join(there, ["project_id", "generation"], "left").fillna({"n_nodes": 0})
    return both.withColumn("agrees", F.col("n_emitted") == F.col("n_nodes"))


def active_generations(generations: DataFrame) -> DataFrame:
    """Per project: the latest activated generation, its staleness, and how many generations failed after it."""
    once = generations.select("project_id", "generation", "state", "partial").distinct()
    done = F.col("state").isin("READY", "STALE")
    active = once.groupBy("project_id").agg(
        F.max(F.when(done, F.struct("generation", "state", "partial"))).alias("a"), F.max("generation").alias("latest"), F.count(F.lit(1)).alias("n_generations")
    )
    later = once.join(active, "project_id").where((F.col("state") == "FAILED") & (F.coalesce(F.col("generation") > F.col("a.generation"), F.lit(True)))).groupBy("project_id").agg(F.count(F.lit(1)).alias("n_failed_since"))
    return active.join(later, "project_id", "left").select(
        "project_id", F.col("a.generation").alias("active_generation"), (F.col("a.state") == "STALE").alias("stale"), F.col("a.partial").alias("partial"), "latest", "n_generations", F.coalesce("n_failed_since", F.lit(0)).alias("n_failed_since")
    )


def corpus_stats(docs: DataFrame, dimensions: list[str], size: str) -> DataFrame:
    """(dimension, value, n, total) for each value of each dimension, in one pass over the rows."""
    sets = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions))
    return docs.select(F.explode(sets).alias("s"), size).groupBy("s.dimension", "s.value").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("total"))


def precision_recall(expected: DataFrame, actual: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """(by, n_expected, n_actual, n_matched, precision, recall) of claims; a side without claims scores 1."""
    e = expected.select(*by, *key, F.lit(1).alias("e")).distinct()
    a = actual.select(*by, *key, F.lit(1).alias("a")).distinct()
    both = e.unionByName(a, allowMissingColumns=True).groupBy(*by, *key).agg(F.max("e").alias("e"), F.max("a").alias("a"))
    counted = both.groupBy(*by).agg(F.count("e").alias("n_expected"), F.count("a").alias("n_actual"), F.count(F.when(F.col("e").isNotNull(), F.col("a"))).alias("n_matched"))
    share: Column = lambda n: F.when(F.col(n) == 0, 1.0).otherwise(F.col("n_matched") / F.col(n))
    return counted.select("*", share("n_actual").alias("precision"), share("n_expected").alias("recall"))


def fingerprints(texts: DataFrame, by: list[str], path: str, text: str, configuration: str = "") -> DataFrame:
    """(by, n_files, fingerprint) that changes with the configuration and any path or text of a group, whatever the order of its files.

    A hash of the sums of the files' hashes, so that parts are combined before they are shuffled. A null text differs from
    an empty one; the same file given twice counts once.
    """
    files = texts.where(F.col(path).isNotNull()).select(*by, path, F.coalesce(F.md5(text), F.lit("none")).alias("digest")).distinct()
    digest = F.sha2(F.concat_ws("\n", path, "digest"), 256)
    sums = [F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")) for at in (1, 16, 31, 46)]
    return files.groupBy(*by).agg(F.count(F.lit(1)).alias("n_files"), F.sha2(F.concat_ws(":", F.lit(configuration), *(s.cast("string") for s in sums)), 256).alias("fingerprint"))
