"""Queries over projects, generations, analyses and the state of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symweave.functions import names
from symweave.operators import counts, derive, sessions, symbols, validate
from symweave.operators.snapshots import complete_generations
from symweave.plans import graph
from symweave.queries.graph import _WITH as GRAPH
from symweave.tables import table

QUERIES = {}
SQL = {}


def _query(sql: str, *integers: str):
    """Registers a query with its SQL, of which the named columns are 32-bit integers."""

    def register(f):
        casts = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in integers)
        QUERIES[f.__name__], SQL[f.__name__] = f, f"SELECT * REPLACE ({casts}) FROM ({sql})" if casts else sql
        return f

    return register


@_query("SELECT project_id, display_name, row_number() OVER (ORDER BY lower(display_name), project_id) AS nth FROM projects", "nth")
def listed_projects(spark: SparkSession, folder: str) -> DataFrame:
    """All projects in order of their names; registered projects are few."""
    return table(spark, folder, "projects").select("project_id", "display_name", F.row_number().over(Window.orderBy(names.ascii_lower(F.col("display_name")), "project_id")).alias("nth"))


@_query("""WITH a AS (SELECT DISTINCT upper(project) AS asked FROM synthetic_nodes UNION SELECT DISTINCT project_id FROM nodes UNION SELECT DISTINCT repo FROM documents)
    SELECT asked, project_id FROM a LEFT JOIN projects p ON p.project_id = asked OR lower(p.display_name) = lower(asked)""")
def project_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The project that each name or identifier in the tables means; names whatever their case, null for none."""
    asked = table(spark, folder, "synthetic_nodes").select(F.upper("project").alias("asked")).union(table(spark, folder, "nodes").select("project_id")).union(table(spark, folder, "documents").select("repo")).distinct()
    projects = table(spark, folder, "projects")
    keys = projects.select(F.explode(F.array(F.struct(F.lit(True).alias("by_id"), F.col("project_id").alias("key")), F.struct(F.lit(False).alias("by_id"), names.ascii_lower(F.col("display_name")).alias("key")))).alias("k"), "project_id").select("k.*", "project_id").distinct()
    each = asked.select("asked", F.explode(F.array(F.struct(F.lit(True).alias("by_id"), F.col("asked").alias("key")), F.struct(F.lit(False).alias("by_id"), names.ascii_lower(F.col("asked")).alias("key")))).alias("k")).select("asked", "k.*")
    return each.join(keys, ["by_id", "key"], "left").groupBy("asked").agg(F.max("project_id").alias("project_id"))


@_query(GRAPH + "SELECT project, stable_id, kind, nth FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY stable_id) AS nth FROM n) WHERE nth <= 500 AND lower(kind) IN ('type', 'package')", "nth")
def nodes_of_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """The symbols of some kinds among the first of each project: the cut comes before the kinds."""
    nodes = graph.current_nodes(table(spark, folder, "synthetic_nodes"))
    return symbols.of_kinds(nodes, ("Type", "PACKAGE"), 500).select("project", "stable_id", "kind", "nth")


@_query(GRAPH + """, s AS (SELECT project, target AS stable_id, 'inbound' AS direction, kind, source, target FROM e UNION ALL SELECT project, source, 'outbound', kind, source, target FROM e),
    r AS (SELECT *, row_number() OVER (PARTITION BY project, stable_id ORDER BY direction, kind, source, target) AS nth, count(*) OVER (PARTITION BY project, stable_id) AS n_edges FROM s) SELECT * FROM r WHERE nth > 2 AND nth <= 6""", "nth")
def context_page(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of every symbol's edges in both directions; a link to itself is on both sides."""
    return symbols.context_page(graph.merged_edges(table(spark, folder, "synthetic_edges")), 4, 2)


@_query("SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY ordinal) AS nth FROM (SELECT DISTINCT request_id, ordinal, upper(trim(kind)) AS kind FROM analyzer_diagnostics)", "nth")
def diagnostics_in_order(spark: SparkSession, folder: str) -> DataFrame:
    once = table(spark, folder, "analyzer_diagnostics").select("request_id", "ordinal", F.upper(F.trim("kind")).alias("kind")).distinct()
    return once.withColumn("nth", F.row_number().over(Window.partitionBy("request_id").orderBy("ordinal")))


@_query("""WITH k AS (SELECT DISTINCT project_id, generation, stable_id, json_array_length(unresolved_json) > 0 AS open FROM nodes), a AS (SELECT project_id, generation, count(*) FILTER (open) AS n FROM k GROUP BY ALL),
    r AS (SELECT repo, count(*) AS n FROM (SELECT DISTINCT request_id, ordinal, repo FROM analyzer_diagnostics) GROUP BY repo)
    SELECT 'symbols' AS part, project_id || ' ' || generation AS scope, n FROM a UNION ALL SELECT 'diagnostics', repo, n FROM r""")
def unresolved_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols with something unresolved in each generation, and the diagnostics of each repository."""
    open_ = F.coalesce(F.json_array_length("unresolved_json") > 0, F.lit(False))
    own = table(spark, folder, "nodes").select("project_id", "generation", "stable_id", open_.alias("open")).distinct().groupBy("project_id", "generation").agg(F.count_if("open").alias("n"))
    diagnostics = table(spark, folder, "analyzer_diagnostics").select("request_id", "ordinal", "repo").distinct().groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    return own.select(F.lit("symbols").alias("part"), F.concat_ws(" ", "project_id", "generation").alias("scope"), "n").unionByName(diagnostics.select(F.lit("diagnostics").alias("part"), F.col("repo").alias("scope"), "n"))


@_query("SELECT project_id, generation, count(*) FILTER (lower(kind) IN ('function', 'method')) AS n_functions, count(*) FILTER (lower(kind) IN ('type', 'trait')) AS n_types FROM (SELECT DISTINCT project_id, generation, stable_id, kind FROM nodes) GROUP BY ALL")
def function_counts(spark: SparkSession, folder: str) -> DataFrame:
    once = table(spark, folder, "nodes").select("project_id", "generation", "stable_id", "kind").distinct()
    return counts.kind_sums(once, ["project_id", "generation"], {"n_functions": ("function", "method"), "n_types": ("type", "trait")})


@_query(GRAPH + ", u AS (SELECT DISTINCT project, package_name, unnest(unresolved) AS name FROM n) SELECT project, package_name, count(*) AS n, string_agg(name, ',' ORDER BY name) AS unresolved FROM u GROUP BY ALL")
def unresolved_sets(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct unresolved names of each package, in order."""
    own = graph.current_nodes(table(spark, folder, "synthetic_nodes")).select("project", "package_name", F.explode("unresolved").alias("name")).distinct()
    return own.groupBy("project", "package_name").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("unresolved"))


@_query("SELECT DISTINCT request_id, repo FROM analysis_summaries WHERE request_id NOT IN (SELECT request_id FROM analyzer_diagnostics WHERE request_id IS NOT NULL)")
def requests_without_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    """The analyses for which no diagnostic came."""
    return table(spark, folder, "analysis_summaries").select("request_id", "repo").distinct().join(table(spark, folder, "analyzer_diagnostics").select("request_id"), "request_id", "left_anti")


@_query("""WITH s AS (SELECT DISTINCT request_id, status, files_failed, files_discovered, files_parsed FROM analysis_summaries) SELECT request_id, status, coalesce(files_failed > 0, false) AS partial,
    (status = 'partial') = coalesce(files_failed > 0, false) AS agrees, files_discovered = files_parsed + coalesce(files_failed, 0) AS adds_up FROM s""")
def partial_analyses(spark: SparkSession, folder: str) -> DataFrame:
    """Whether analyses are partial by their failed files, and whether their status and counts agree with that."""
    return derive.partial_status(table(spark, folder, "analysis_summaries").select("request_id", "status", "files_failed", "files_discovered", "files_parsed").distinct())


@_query("""WITH g AS (SELECT DISTINCT project_id, generation, state, failure_summary FROM project_generations) SELECT project_id, coalesce(max(generation), 0) + 1 AS next_generation, count(*) FILTER (state = 'BUILDING') AS n_building,
    count(*) FILTER (state = 'BUILDING') = 0 AS may_begin, count(*) FILTER (state = 'STALE') AS n_stale, max(CASE WHEN state = 'FAILED' THEN left(failure_summary, 20) END) AS last_failure FROM g GROUP BY ALL""")
def generation_lifecycle(spark: SparkSession, folder: str) -> DataFrame:
    return counts.generation_lifecycle(table(spark, folder, "project_generations"), 20)


@_query("""WITH g AS (SELECT project_id, generation, bool_or(partial) AS partial FROM project_generations WHERE state IN ('READY', 'STALE') GROUP BY ALL),
    t AS (SELECT project_id, generation, count(DISTINCT stable_id) FILTER (confidence = 'AMBIGUOUS') AS n_ambiguous, count(DISTINCT stable_id) FILTER (json_array_length(unresolved_json) > 0) AS n_unresolved, count(DISTINCT stable_id) > 500 AS truncated FROM nodes GROUP BY ALL)
    SELECT g.project_id, g.generation, coalesce(n_ambiguous, 0) AS n_ambiguous, coalesce(n_unresolved, 0) AS n_unresolved,
      CASE WHEN partial THEN 'partial' WHEN n_ambiguous > 0 THEN 'ambiguous' WHEN n_unresolved > 0 THEN 'unresolved' WHEN truncated THEN 'truncated' ELSE 'complete' END AS completeness FROM g LEFT JOIN t USING (project_id, generation)""")
def generation_completeness(spark: SparkSession, folder: str) -> DataFrame:
    """How complete an answer with all symbols of a generation would be, of which up to 500 are shown."""
    done = table(spark, folder, "project_generations").where("state IN ('READY', 'STALE')").groupBy("project_id", "generation").agg(F.bool_or("partial").alias("partial"))
    unsure, open_ = F.col("confidence") == "AMBIGUOUS", F.json_array_length("unresolved_json") > 0
    there = table(spark, folder, "nodes").groupBy("project_id", "generation").agg(F.count_distinct(F.when(unsure, F.col("stable_id"))).alias("n_ambiguous"), F.count_distinct(F.when(open_, F.col("stable_id"))).alias("n_unresolved"), F.count_distinct("stable_id").alias("n"))
    both = done.join(there, ["project_id", "generation"], "left").fillna({"n_ambiguous": 0, "n_unresolved": 0, "n": 0})
    return both.select("project_id", "generation", "n_ambiguous", "n_unresolved", names.completeness(F.col("partial"), F.col("n_ambiguous"), F.col("n_unresolved"), F.col("n") > 500).alias("completeness"))


_GRAMMAR = """octet_length(encode(stable_id)) <= 1024 AND (regexp_matches(stable_id, '^(project|crate|module|package|type|trait|function|variant|const|static|macro|associated_type|bean|entity|config):[^\\n\\r]*\\S')
    OR regexp_matches(stable_id, '^method:[^#]+#[^(]+\\(.*\\)$') OR regexp_matches(stable_id, '^constructor:[^#]+#<init>\\(.*\\)$') OR regexp_matches(stable_id, '^field:[^#]+#.+$') OR regexp_matches(stable_id, '^route:(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS):/'))"""
_UNSAFE = "(file_path = '' OR regexp_matches(file_path, '^[A-Za-z]:') OR list_has_any(string_split(replace(file_path, '\\', '/'), '/'), ['', '.', '..']))"
_BAD = "((file_path IS NOT NULL OR start_line IS NOT NULL OR end_line IS NOT NULL) AND NOT coalesce(file_path IS NOT NULL AND start_line > 0 AND end_line >= start_line, false))"


@_query(f"""WITH x AS (SELECT project, edge_id, unnest([source_stable_id, target_stable_id]) AS stable_id FROM synthetic_edges), o AS (SELECT project, unnest(occurrences, recursive := true) FROM (SELECT project, occurrences FROM synthetic_edges)),
    v AS (SELECT project, 'node identifier' AS rule FROM synthetic_nodes WHERE NOT coalesce({_GRAMMAR}, false) UNION ALL SELECT project, 'repeated node' FROM (SELECT project, stable_id FROM synthetic_nodes GROUP BY ALL HAVING count(*) > 1)
      UNION ALL SELECT project, 'node metadata' FROM synthetic_nodes WHERE NOT coalesce(json_type(metadata) = 'OBJECT', false) UNION ALL SELECT project, 'node location' FROM synthetic_nodes WHERE {_BAD} UNION ALL SELECT project, 'node path' FROM synthetic_nodes WHERE file_path IS NOT NULL AND {_UNSAFE}
      UNION ALL SELECT project, 'missing end' FROM x WHERE stable_id IS NULL UNION ALL SELECT project, 'unknown end' FROM x WHERE stable_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM synthetic_nodes n WHERE n.project = x.project AND n.stable_id = x.stable_id)
      UNION ALL SELECT project, 'edge metadata' FROM synthetic_edges WHERE NOT coalesce(json_type(metadata) = 'OBJECT', false) UNION ALL SELECT project, 'evidence location' FROM o WHERE {_BAD} OR file_path IS NULL UNION ALL SELECT project, 'evidence path' FROM o WHERE file_path IS NOT NULL AND {_UNSAFE})
    SELECT project, rule, count(*) AS n FROM v GROUP BY ALL""")
def graph_violations(spark: SparkSession, folder: str) -> DataFrame:
    return validate.graph_violations(table(spark, folder, "synthetic_nodes"), table(spark, folder, "synthetic_edges"))


@_query("""WITH g AS (SELECT project_id, generation, lag(generation) OVER w AS prior, lag(generation, 2) OVER w AS older FROM (SELECT DISTINCT project_id, generation FROM project_generations WHERE state IN ('READY', 'STALE')) WINDOW w AS (PARTITION BY project_id ORDER BY generation)),
    k AS (SELECT DISTINCT project_id, generation, stable_id FROM nodes), t AS (SELECT * FROM g WHERE older IS NOT NULL),
    x AS (SELECT t.project_id, t.generation, stable_id FROM t JOIN k ON k.project_id = t.project_id AND k.generation = prior), o AS (SELECT t.project_id, t.generation, stable_id FROM t JOIN k ON k.project_id = t.project_id AND k.generation = older),
    f AS (SELECT * FROM o EXCEPT SELECT * FROM x), a AS (SELECT t.project_id, t.generation, stable_id FROM t JOIN k ON k.project_id = t.project_id AND k.generation = t.generation),
    c AS (SELECT x.project_id, x.generation, count(*) AS n_expected, count(a.stable_id) AS n_true, count(*) - count(a.stable_id) AS n_missing FROM x LEFT JOIN a USING (project_id, generation, stable_id) GROUP BY ALL),
    b AS (SELECT project_id, generation, count(*) AS k FROM f JOIN a USING (project_id, generation, stable_id) GROUP BY ALL)
    SELECT c.*, coalesce(k, 0) AS n_forbidden, CASE WHEN n_true + coalesce(k, 0) = 0 THEN 1.0 ELSE n_true::DOUBLE / (n_true + coalesce(k, 0)) END AS precision, CASE WHEN n_expected = 0 THEN 1.0 ELSE n_true::DOUBLE / n_expected END AS recall FROM c LEFT JOIN b USING (project_id, generation)""")
def graph_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Each complete generation against what the one before expects; forbidden is what had been removed by then."""
    order = complete_generations(table(spark, folder, "project_generations")).select("project_id", "generation", "prior")
    older = order.select("project_id", F.col("generation").alias("prior"), F.col("prior").alias("older"))
    three = order.join(older, ["project_id", "prior"]).where("older IS NOT NULL")
    keys = table(spark, folder, "nodes").select("project_id", F.col("generation").alias("at"), "stable_id").distinct()
    of = lambda c: three.join(keys, (three.project_id == keys.project_id) & (three[c] == keys["at"])).select(three.project_id, "generation", "stable_id")
    return sessions.graph_accuracy(of("prior"), of("older").exceptAll(of("prior")), of("generation"), ["project_id", "generation"], ["stable_id"])


_SESSION = """WITH r AS (SELECT shape, lower(trim(fixture)) AS question_id, mode, total_index_ms, parsing_ms, worker_analysis_ms, row_number() OVER (PARTITION BY shape, lower(trim(fixture)), mode ORDER BY reported_at DESC, run_id DESC) AS i FROM performance_runs WHERE fixture IS NOT NULL),
    s AS (SELECT *, coalesce(total_index_ms >= parsing_ms AND parsing_ms >= 0, false) AS correct, CASE WHEN coalesce(parsing_ms, -1) < 0 THEN 1 ELSE 0 END AS n_unsupported FROM r WHERE i = 1) """
_METRICS = {"total_index_ms": 60.0, "parsing_ms": 70.0, "worker_analysis_ms": 40.0}


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    """The latest run of each fixture and mode within a shape, as an answered question."""
    last = table(spark, folder, "performance_runs").where("fixture IS NOT NULL").groupBy("shape", F.lower(F.trim("fixture")).alias("question_id"), "mode").agg(F.max_by(F.struct(*_METRICS), F.struct("reported_at", "run_id")).alias("r")).select("shape", "question_id", "mode", "r.*")
    return last.withColumns({"correct": F.coalesce(F.expr("total_index_ms >= parsing_ms AND parsing_ms >= 0"), F.lit(False)), "n_unsupported": (F.coalesce("parsing_ms", F.lit(-1)) < 0).cast("bigint")})


def _median(table_: str, by: str, value: str, name: str) -> str:
    return f"(SELECT {by}, {name} FROM (SELECT {by}, {value} AS {name}, row_number() OVER (PARTITION BY {by} ORDER BY {value}) AS i, count(*) OVER (PARTITION BY {by}) AS n FROM {table_} WHERE {value} IS NOT NULL) WHERE i = n // 2 + 1)"


@_query(_SESSION + "SELECT a.*" + "".join(f", m_{m}.median_{m}" for m in _METRICS) + " FROM (SELECT shape, mode, count(*) AS n_runs, count(*) FILTER (correct)::DOUBLE / count(*) AS correctness, CAST(sum(n_unsupported) AS BIGINT) AS n_unsupported FROM s GROUP BY ALL) a"
    + "".join(f" LEFT JOIN {_median('s', 'shape, mode', m, f'median_{m}')} m_{m} USING (shape, mode)" for m in _METRICS))
def session_aggregates(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.session_aggregates(_runs(spark, folder), ["shape", "mode"], list(_METRICS))


@_query(_SESSION + ", p AS (SELECT b.shape, b.correct, o.correct AS o_correct, o.n_unsupported AS o_unsupported" + "".join(f", CASE WHEN b.{m} <> 0 THEN 100.0::DOUBLE * (b.{m} - o.{m}) / b.{m} END AS r_{m}" for m in _METRICS)
    + " FROM s b JOIN s o ON o.shape = b.shape AND o.question_id = b.question_id AND o.mode = 'safe' WHERE b.mode = 'trusted') SELECT a.*" + "".join(f", reduction_{m}, coalesce(reduction_{m} >= {t}, false) AS meets_{m}" for m, t in _METRICS.items())
    + " FROM (SELECT shape, count(*) AS n_pairs, count(*) FILTER (o_correct) >= count(*) FILTER (correct) AS no_less_correct, sum(o_unsupported) = 0 AS none_unsupported FROM p GROUP BY ALL) a" + "".join(f" LEFT JOIN {_median('p', 'shape', f'r_{m}', f'reduction_{m}')} m_{m} USING (shape)" for m in _METRICS))
def target_flags(spark: SparkSession, folder: str) -> DataFrame:
    """By how much the safe mode takes less than the trusted one, and whether that meets the targets."""
    return sessions.compared_sessions(_runs(spark, folder), ["shape"], "trusted", "safe", _METRICS)


@_query("""WITH d AS (SELECT doc_id, text, n_chars // 2 AS mid, repo || '::' || replace(file_path, '/', '::') AS path FROM documents)
    SELECT doc_id, md5(left(text, 200)) AS start, length(left(text, mid)) - length(replace(left(text, mid), chr(10), '')) + 1 AS middle_line, nullif(regexp_extract(text, '\\$\\{([^}:]+)(:[^}]*)?\\}', 1), '') AS placeholder,
      CASE WHEN trim(string_split(path, '::')[-1]) NOT IN ('', 'self', '*') THEN trim(string_split(path, '::')[-1]) END AS final_name FROM d""", "middle_line")
def text_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Of every text: a bounded start, the line of its middle, its first placeholder and the last name of its path."""
    docs = table(spark, folder, "documents").withColumn("path", F.concat(F.col("repo"), F.lit("::"), F.replace(F.col("file_path"), F.lit("/"), F.lit("::"))))
    return docs.select(
        "doc_id", F.md5(names.bounded(F.col("text"), 200)).alias("start"), names.line_of(F.col("text"), F.floor(F.col("n_chars") / 2)).alias("middle_line"), names.placeholder_key(F.col("text")).alias("placeholder"), names.final_name(F.col("path")).alias("final_name")
    )
