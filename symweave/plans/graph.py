"""The current graph: its nodes, merged edges and evidence rows, from the rows as they were loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EDGE_KEY = ["project", "source", "target", "kind"]


def current_nodes(nodes: DataFrame) -> DataFrame:
    """The latest row of each (project, stable_id), unless it is deleted; kinds in upper case.

    Rows without project or stable_id have no key and are left out; of rows loaded at the same moment one without
    deletion comes first.
    """
    w = Window.partitionBy("project", "stable_id").orderBy(F.desc_nulls_last("loaded_at"), F.desc_nulls_first("deleted_at"))
    keyed = nodes.where("project IS NOT NULL AND stable_id IS NOT NULL")
    return keyed.withColumn("nth", F.row_number().over(w)).where("nth = 1 AND deleted_at IS NULL").drop("nth").withColumn("kind", F.upper(F.trim("kind")))


def merged_edges(edges: DataFrame) -> DataFrame:
    """(project, source, target, kind, confidence, provenance, metadata, n_rows, n_occurrences) of each distinct edge.

    Attributes are those of the row with the least edge_id. Edges with a null endpoint are none.
    """
    named = edges.select(
        "edge_id", "project", F.col("source_stable_id").alias("source"), F.col("target_stable_id").alias("target"), F.upper(F.trim("kind")).alias("kind"),
        "confidence", "provenance", "metadata", F.coalesce(F.size("occurrences"), F.lit(0)).alias("n"),
    ).where("source IS NOT NULL AND target IS NOT NULL")
    merged = named.groupBy(*EDGE_KEY).agg(
        F.min_by(F.struct("confidence", "provenance", "metadata"), "edge_id").alias("a"), F.count(F.lit(1)).alias("n_rows"), F.sum(F.greatest("n", F.lit(0))).cast("bigint").alias("n_occurrences")
    )
    return merged.select(*EDGE_KEY, "a.confidence", "a.provenance", "a.metadata", "n_rows", "n_occurrences")


def edge_occurrences(edges: DataFrame) -> DataFrame:
    """(project, source, target, kind, edge_id, nth, file_path, start_line, end_line): every evidence row of every edge."""
    rows = edges.where("source_stable_id IS NOT NULL AND target_stable_id IS NOT NULL").select(
        "project", F.col("source_stable_id").alias("source"), F.col("target_stable_id").alias("target"), F.upper(F.trim("kind")).alias("kind"), "edge_id", F.posexplode("occurrences").alias("nth", "o")
    )
    return rows.select(*EDGE_KEY, "edge_id", "nth", "o.file_path", "o.start_line", "o.end_line")
