"""Checks of loaded rows: identifiers, locations, duplicates, dangling edges and the order of analyzer events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symweave.functions import names

# The order in which an analyzer's events follow each other.
PHASES = {"analysis_started": 0, "project_metadata": 1, "module_discovered": 2, "node": 3, "edge": 4, "diagnostic": 5, "analysis_summary": 6, "analysis_completed": 7}


def id_problems(nodes: DataFrame) -> DataFrame:
    """(project, stable_id) of identifiers that break the grammar of their kind."""
    return nodes.select("project", "stable_id").distinct().where(~names.is_valid_id(F.col("stable_id")))


def location_problems(rows: DataFrame, key: list[str]) -> DataFrame:
    """The key and location of each row whose location is incomplete or no range of lines."""
    columns = ["file_path", "start_line", "end_line"]
    return rows.where(names.is_bad_location(*(F.col(c) for c in columns))).select(*key, *columns)


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, n) of each key that occurs in several rows."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, source, target, kind, missing) of edges without a current node at an end; the source counts first."""
    known = nodes.select("project", "stable_id")
    end = lambda e: known.select("project", F.col("stable_id").alias(e), F.lit(True).alias(f"has_{e}"))
    both = edges.select("project", "source", "target", "kind").join(end("source"), ["project", "source"], "left").join(end("target"), ["project", "target"], "left")
    missing = F.when(F.col("has_source").isNull(), "source").when(F.col("has_target").isNull(), "target")
    return both.select("project", "source", "target", "kind", missing.alias("missing")).where("missing IS NOT NULL")


def graph_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, rule, n): how many rows of a graph as loaded break each rule; rules that are kept don't come out.

    nodes and edges have the columns of graph documents. Rules are an identifier's grammar, repeated identifiers, metadata
    that are no object, locations and paths, edges without an end or with an unknown one, and evidence of edges.
    """
    place = lambda prefix="": [F.col(f"{prefix}{c}") for c in ("file_path", "start_line", "end_line")]
    no_object = lambda c: ~F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False))
    known = nodes.select("project", "stable_id").distinct()
    ends = edges.select("project", "edge_id", F.explode(F.array("source_stable_id", "target_stable_id")).alias("stable_id"))
    seen = edges.select("project", F.explode("occurrences").alias("o")).select("project", "o.*")
    parts = {
        "node identifier": nodes.where(~F.coalesce(names.is_valid_id(F.col("stable_id")), F.lit(False))),
        "repeated node": nodes.groupBy("project", "stable_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
        "node metadata": nodes.where(no_object("metadata")),
        "node location": nodes.where(names.is_bad_location(*place())),
        "node path": nodes.where(F.col("file_path").isNotNull() & ~names.is_safe_path(F.col("file_path"))),
        "missing end": ends.where("stable_id IS NULL"),
        "unknown end": ends.where("stable_id IS NOT NULL").join(known, ["project", "stable_id"], "left_anti"),
        "edge metadata": edges.where(no_object("metadata")),
        "evidence location": seen.where(names.is_bad_location(*place()) | F.col("file_path").isNull()),
        "evidence path": seen.where(F.col("file_path").isNotNull() & ~names.is_safe_path(F.col("file_path"))),
    }
    whole = None
    for rule, rows in parts.items():
        one = rows.groupBy("project").agg(F.count(F.lit(1)).alias("n")).select("project", F.lit(rule).alias("rule"), "n")
        whole = one if whole is None else whole.unionByName(one)
    return whole


def event_order_problems(events: DataFrame) -> DataFrame:
    """(request_id, ordinal, problem) of events out of order, of unknown type, or missing at either end.

    events are (request_id, ordinal, type). A request is one stream; its events are compared with the one before.
    """
    phase = F.lit(None).cast("int")
    for name, rank in PHASES.items():
        phase = F.when(F.col("type") == name, rank).otherwise(phase)
    w = Window.partitionBy("request_id").orderBy("ordinal")
    seen = events.withColumn("phase", phase).withColumn("before", F.lag("phase").over(w)).withColumn("nth", F.row_number().over(w)).withColumn("last", F.lead("ordinal").over(w).isNull())
    once = F.col("phase").isin(0, 1, 6, 7) & (F.col("before") == F.col("phase"))
    problem = (
        F.when(F.col("phase").isNull(), "unknown type").when((F.col("nth") == 1) & (F.col("phase") != 0), "no start")
        .when((F.col("before") > F.col("phase")) | once, "out of order").when(F.col("last") & (F.col("phase") != 7), "no completion")
    )
    return seen.select("request_id", "ordinal", problem.alias("problem")).where("problem IS NOT NULL")
