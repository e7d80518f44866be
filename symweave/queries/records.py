"""Queries of problems 2, 3 and 4: orphan references, snapshot changes and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symweave.operators import hierarchy, references, snapshots
from symweave.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    edges, nodes = table(spark, folder, "synthetic_edges"), table(spark, folder, "synthetic_nodes")
    return references.orphan_references(edges, nodes).select("edge_id", "side").distinct()


def p2_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = references.orphan_counts(table(spark, folder, "synthetic_edges"), table(spark, folder, "synthetic_nodes"))
    return counts.withColumn("day", counts.day.cast("string"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, folder, "nodes"), table(spark, folder, "project_generations"))


def p3_intervals(spark: SparkSession, folder: str) -> DataFrame:
    found = snapshots.validity_intervals(table(spark, folder, "nodes"), table(spark, folder, "project_generations"))
    return found.select("project_id", "stable_id", "first", "last", "prior", "following")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.cyclic_nodes(table(spark, folder, "synthetic_edges"))


def p4_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """Every node's place; the path as one text."""
    found = hierarchy.hierarchies(table(spark, folder, "synthetic_edges"))
    return found.selectExpr("project", "stable_id", "root", "depth", "array_join(path, ' > ') AS path", "entry", "exit", "n_descendants")


def p4_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.hierarchies(table(spark, folder, "synthetic_edges")))


QUERIES = {f.__name__: f for f in (p2_found, p2_counts, p3_found, p3_intervals, p4_found, p4_hierarchy, p4_descendants)}

_ORPHANS = """
  refs AS (
    SELECT edge_id, 'source' AS side, project, source_stable_id AS ref, loaded_at FROM synthetic_edges WHERE source_stable_id IS NOT NULL
    UNION ALL
    SELECT edge_id, 'target', project, target_stable_id, loaded_at FROM synthetic_edges WHERE target_stable_id IS NOT NULL
  ),
  orphans AS (
    SELECT * FROM refs r WHERE NOT EXISTS (
      SELECT 1 FROM synthetic_nodes n WHERE n.project = r.project AND n.stable_id = r.ref
        AND n.loaded_at <= r.loaded_at AND (n.deleted_at IS NULL OR n.deleted_at > r.loaded_at))
  )"""

# The documented meaning of JSON values in DuckDB: minified members in order of name.
_STATES = """
  complete AS (
    SELECT project_id, generation, lag(generation) OVER w AS prior, lead(generation) OVER w AS following
    FROM (SELECT DISTINCT project_id, generation FROM project_generations WHERE state IN ('READY', 'STALE'))
    WINDOW w AS (PARTITION BY project_id ORDER BY generation)
  ),
  states AS (
    SELECT DISTINCT c.project_id, c.generation, c.prior, c.following, n.stable_id,
      md5(to_json([n.kind, n.qualified_name, n.simple_name, n.module_name, n.package_name, n.namespace_path, n.file_path,
        n.start_line::VARCHAR, n.end_line::VARCHAR, n.confidence, n.provenance,
        list_sort(list_transform(json_keys(n.metadata_json), lambda k: k || ':' || (n.metadata_json -> k)::VARCHAR))::VARCHAR,
        n.unresolved_json::JSON::VARCHAR])::VARCHAR) AS content
    FROM (SELECT * REPLACE (json(metadata_json) AS metadata_json, json(unresolved_json) AS unresolved_json) FROM nodes) n
    JOIN complete c USING (project_id, generation)
  )"""

_TREES = """
  links AS (
    SELECT DISTINCT project, source_stable_id AS parent, target_stable_id AS child FROM synthetic_edges
    WHERE upper(trim(kind)) = 'DECLARES' AND project IS NOT NULL AND source_stable_id IS NOT NULL AND target_stable_id IS NOT NULL
  ),
  names AS (SELECT project, parent AS stable_id FROM links UNION SELECT project, child FROM links),
  below AS (
    SELECT l.*, CASE WHEN EXISTS (SELECT 1 FROM links m WHERE m.project = l.project AND m.parent = l.child) THEN '1' ELSE '0' END || left(md5(l.child), 2) || l.child AS place FROM links l
  ),
  placed AS (
    SELECT n.project, n.stable_id, n.stable_id AS root, 0::BIGINT AS depth, [n.stable_id] AS path, [n.stable_id] AS place
    FROM names n WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.project = n.project AND l.child = n.stable_id)
    UNION ALL
    SELECT p.project, l.child, p.root, p.depth + 1, list_append(p.path, l.child), list_append(p.place, l.place)
    FROM placed p JOIN below l ON l.project = p.project AND l.parent = p.stable_id
  ),
  pairs AS (SELECT project, stable_id AS descendant, depth, unnest(path) AS ancestor, generate_subscripts(path, 1) - 1 AS nth FROM placed)"""

SQL = {
    "p4_found": f"WITH RECURSIVE {_TREES} SELECT project, stable_id FROM names EXCEPT SELECT project, stable_id FROM placed",
    "p4_hierarchy": f"""WITH RECURSIVE {_TREES},
        sizes AS (SELECT project, ancestor, count(*) - 1 AS n FROM pairs GROUP BY ALL),
        ordered AS (SELECT *, row_number() OVER (PARTITION BY project, root ORDER BY place) - 1 AS nth FROM placed)
        SELECT o.project, o.stable_id, root, depth, array_to_string(path, ' > ') AS path, 2 * nth - depth AS entry, 2 * nth - depth + 2 * n + 1 AS exit, n AS n_descendants
        FROM ordered o JOIN sizes s ON s.project = o.project AND s.ancestor = o.stable_id""",
    "p4_descendants": f"WITH RECURSIVE {_TREES} SELECT project, ancestor, descendant, depth - nth AS distance FROM pairs WHERE nth < depth",
    "p2_found": f"WITH {_ORPHANS} SELECT edge_id, side FROM orphans",
    "p2_counts": f"""WITH {_ORPHANS}
        SELECT r.project, r.side, CAST(CAST(r.loaded_at AS DATE) AS VARCHAR) AS day, count(*) AS n_references,
          CAST(sum(CASE WHEN o.edge_id IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS n_orphans, count(DISTINCT o.ref) AS n_missing_keys
        FROM refs r LEFT JOIN orphans o ON r.edge_id = o.edge_id AND r.side = o.side GROUP BY ALL""",
    "p3_found": f"""WITH {_STATES}
        SELECT project_id, generation, stable_id, 'added' AS change FROM states s WHERE prior IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM states p WHERE p.project_id = s.project_id AND p.stable_id = s.stable_id AND p.generation = s.prior)
        UNION ALL
        SELECT project_id, following, stable_id, 'removed' FROM states s WHERE following IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM states p WHERE p.project_id = s.project_id AND p.stable_id = s.stable_id AND p.generation = s.following)
        UNION ALL
        SELECT s.project_id, s.generation, s.stable_id, 'changed' FROM states s JOIN states p
          ON p.project_id = s.project_id AND p.stable_id = s.stable_id AND p.generation = s.prior WHERE p.content <> s.content""",
    "p3_intervals": f"""WITH {_STATES}, marked AS (
          SELECT *, CASE WHEN lag(generation) OVER w = prior AND lag(content) OVER w = content THEN 0 ELSE 1 END AS begins
          FROM states WINDOW w AS (PARTITION BY project_id, stable_id ORDER BY generation)
        ), islands AS (SELECT *, sum(begins) OVER (PARTITION BY project_id, stable_id ORDER BY generation) AS island FROM marked)
        SELECT project_id, stable_id, min(generation) AS first, max(generation) AS last, arg_min(CASE WHEN prior IS NULL THEN -1 ELSE prior END, generation) AS prior0,
          arg_max(CASE WHEN following IS NULL THEN -1 ELSE following END, generation) AS following0
        FROM islands GROUP BY project_id, stable_id, island""",
}
SQL["p3_intervals"] = "SELECT project_id, stable_id, first, last, nullif(prior0, -1) AS prior, nullif(following0, -1) AS following FROM (" + SQL["p3_intervals"] + ")"
