"""Queries over the current graph, its generations and its documents."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symweave.functions import names
from symweave.operators import counts, evidence, symbols, traverse, validate
from symweave.operators.snapshots import complete_generations
from symweave.plans import graph, packs
from symweave.tables import table

QUERIES = {}
SQL = {}

_WITH = """WITH RECURSIVE n AS (
    SELECT * REPLACE (upper(trim(kind)) AS kind) FROM (
      SELECT *, row_number() OVER (PARTITION BY project, stable_id ORDER BY loaded_at DESC NULLS LAST, deleted_at DESC NULLS FIRST) AS rn FROM synthetic_nodes
      WHERE project IS NOT NULL AND stable_id IS NOT NULL)
    WHERE rn = 1 AND deleted_at IS NULL
  ),
  o AS (
    SELECT project, source_stable_id AS source, target_stable_id AS target, upper(trim(kind)) AS kind, edge_id, unnest(occurrences, recursive := true), generate_subscripts(occurrences, 1) - 1 AS nth
    FROM (SELECT * EXCLUDE (metadata) FROM synthetic_edges) WHERE source_stable_id IS NOT NULL AND target_stable_id IS NOT NULL AND len(occurrences) > 0
  ),
  e AS (
    SELECT project, source_stable_id AS source, target_stable_id AS target, upper(trim(kind)) AS kind, arg_min(confidence, edge_id) AS confidence,
      arg_min(provenance, edge_id) AS provenance, arg_min(metadata, edge_id) AS metadata, count(*) AS n_rows, CAST(sum(coalesce(len(occurrences), 0)) AS BIGINT) AS n_occurrences
    FROM synthetic_edges WHERE source_stable_id IS NOT NULL AND target_stable_id IS NOT NULL GROUP BY ALL
  ) """


def _query(sql: str, *integers: str):
    """Registers a query with its SQL, of which the named columns are 32-bit integers."""

    def register(f):
        whole = sql if sql.lstrip().startswith("WITH") else _WITH + sql
        casts = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in integers)
        QUERIES[f.__name__], SQL[f.__name__] = f, f"SELECT * REPLACE ({casts}) FROM ({whole})" if casts else whole
        return f

    return register


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    return graph.current_nodes(table(spark, folder, "synthetic_nodes"))


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.merged_edges(table(spark, folder, "synthetic_edges"))


def _occurrences(spark: SparkSession, folder: str) -> DataFrame:
    return graph.edge_occurrences(table(spark, folder, "synthetic_edges"))


@_query("SELECT project, kind, count(*) AS n FROM n GROUP BY ALL")
def node_kind_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counts.kind_counts(_nodes(spark, folder), ["project", "kind"])


@_query("SELECT project, kind, confidence, count(*) AS n FROM e GROUP BY ALL")
def edge_kind_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counts.kind_counts(_edges(spark, folder), ["project", "kind", "confidence"])


@_query("SELECT * FROM e")
def merged_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _edges(spark, folder)


@_query("SELECT repo, kind, severity, count(*) AS n FROM (SELECT DISTINCT request_id, ordinal, repo, upper(trim(kind)) AS kind, severity FROM analyzer_diagnostics) GROUP BY ALL")
def diagnostic_kind_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counts.diagnostic_counts(table(spark, folder, "analyzer_diagnostics"))


@_query("""SELECT project, CAST(sum(a) AS BIGINT) AS n_nodes, CAST(sum(b) AS BIGINT) AS n_unresolved, CAST(sum(c) AS BIGINT) AS n_edges, CAST(sum(d) AS BIGINT) AS n_occurrences FROM (
    SELECT project, 1 AS a, CASE WHEN len(unresolved) > 0 THEN 1 ELSE 0 END AS b, 0 AS c, 0 AS d FROM n UNION ALL SELECT project, 0, 0, 1, n_occurrences FROM e) GROUP BY project""")
def graph_status(spark: SparkSession, folder: str) -> DataFrame:
    return counts.graph_status(_nodes(spark, folder), _edges(spark, folder))


PACKAGES = """, located AS (
    SELECT project, package_name AS package, count(*) FILTER (kind IN ('BEAN', 'ROUTE', 'REPOSITORY', 'ENTITY', 'CONFIG_PROPERTY', 'EVENT_TYPE')) AS n_components, count(*) FILTER (kind = 'ROUTE') AS n_routes,
      count(*) FILTER (kind = 'REPOSITORY') AS n_repositories, count(*) FILTER (kind = 'ENTITY') AS n_entities, count(*) FILTER (kind = 'BEAN') AS n_beans, count(*) FILTER (kind = 'EVENT_TYPE') AS n_events, count(*) FILTER (kind = 'CONFIG_PROPERTY') AS n_configuration
    FROM n WHERE file_path IS NOT NULL AND package_name IS NOT NULL GROUP BY ALL),
  inside AS (SELECT e.project, s.package_name AS package, count(*) AS n_internal FROM e JOIN n s ON s.project = e.project AND s.stable_id = e.source
    JOIN n t ON t.project = e.project AND t.stable_id = e.target WHERE s.package_name = t.package_name GROUP BY ALL),
  metrics AS (SELECT l.*, coalesce(n_internal, 0) AS n_internal, concat_ws(',', CASE WHEN n_routes > 0 THEN 'web' END, CASE WHEN n_beans > 0 THEN 'service' END, CASE WHEN n_repositories > 0 OR n_entities > 0 THEN 'data' END,
    CASE WHEN n_events > 0 THEN 'events' END, CASE WHEN n_configuration > 0 THEN 'configuration' END) AS roles FROM located l LEFT JOIN inside i USING (project, package)) """
_AREAS = """(SELECT *, row_number() OVER (PARTITION BY project ORDER BY n_components DESC, n_internal DESC, n_routes DESC, package) AS nth FROM metrics)
    WHERE nth <= 12 AND (n_components > 0 OR n_internal > 0) AND NOT (package LIKE 'java.%' OR package LIKE 'javax.%' OR package LIKE 'jakarta.%' OR package LIKE 'org.springframework.%')"""


@_query(_WITH + PACKAGES + "SELECT * FROM metrics")
def package_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return counts.package_metrics(_nodes(spark, folder), _edges(spark, folder))


@_query(_WITH + PACKAGES + "SELECT * FROM " + _AREAS, "nth")
def application_areas(spark: SparkSession, folder: str) -> DataFrame:
    return counts.application_areas(package_metrics(spark, folder))


@_query("""SELECT DISTINCT project, 'module' AS level, module_name AS name FROM n WHERE module_name IS NOT NULL
    UNION ALL SELECT DISTINCT project, 'namespace', coalesce(namespace_path, package_name) FROM n WHERE coalesce(namespace_path, package_name) IS NOT NULL""")
def modules_and_namespaces(spark: SparkSession, folder: str) -> DataFrame:
    nodes = _nodes(spark, folder)
    levels = F.array(F.struct(F.lit("module").alias("level"), F.col("module_name").alias("name")), F.struct(F.lit("namespace").alias("level"), F.coalesce("namespace_path", "package_name").alias("name")))
    return nodes.select("project", F.explode(levels).alias("l")).select("project", "l.level", "l.name").where("name IS NOT NULL").distinct()


@_query("""SELECT project, json_extract_string(metadata, '$.source_set') AS source_set, count(*) AS n,
    count(*) FILTER (coalesce(replace(file_path, '\\', '/') LIKE 'tests/%', false) OR coalesce(json_extract_string(metadata, '$.test') = 'true', false)) AS n_tests FROM n GROUP BY ALL""")
def test_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return counts.test_symbols(_nodes(spark, folder))


@_query("""SELECT project, source, target, kind, nth FROM (SELECT *, row_number() OVER (PARTITION BY project, source ORDER BY kind, source, target) AS nth FROM e) WHERE nth <= 3 AND kind = 'CALLS'""", "nth")
def neighbours_cut_first(spark: SparkSession, folder: str) -> DataFrame:
    return symbols.neighbours(_edges(spark, folder), "source", 3, ["CALLS"])


@_query("""SELECT project, source, target, kind, nth FROM (SELECT *, row_number() OVER (PARTITION BY project, target ORDER BY kind, source, target) AS nth FROM e WHERE kind = 'CALLS') WHERE nth <= 3""", "nth")
def neighbours_filtered_first(spark: SparkSession, folder: str) -> DataFrame:
    return symbols.neighbours(_edges(spark, folder), "target", 3, ["CALLS"], limit_first=False)


@_query(""", seen AS (SELECT project, kind, confidence, target AS stable_id, 'inbound' AS direction FROM e UNION ALL SELECT project, kind, confidence, source, 'outbound' FROM e),
    grouped AS (SELECT *, CASE WHEN kind = 'CALLS' AND direction = 'inbound' THEN 'callers' WHEN kind = 'CALLS' THEN 'callees' WHEN kind IN ('INJECTS', 'SELECTED_BEAN', 'BEAN_CANDIDATE') THEN 'dependencies'
      WHEN kind IN ('REFERENCES_TYPE', 'ACCEPTS_TYPE', 'RETURNS_TYPE') THEN 'types' WHEN kind IN ('IMPLEMENTS', 'IMPLEMENTS_METHOD') THEN 'implementations' WHEN kind IN ('READS_FIELD', 'WRITES_FIELD') THEN 'field_access' END AS category FROM seen)
    SELECT project, stable_id, direction, category, count(*) AS n_edges, count(*) FILTER (confidence = 'AMBIGUOUS') AS n_ambiguous FROM grouped g
    WHERE category IS NOT NULL AND EXISTS (SELECT 1 FROM n WHERE n.project = g.project AND n.stable_id = g.stable_id) GROUP BY ALL""")
def symbol_context(spark: SparkSession, folder: str) -> DataFrame:
    return symbols.context_counts(_nodes(spark, folder), _edges(spark, folder))


_TOKENS = "trim(regexp_replace(lower(regexp_replace({0}, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[^\\pL\\pN]+', ' ', 'g'))"


#: Queries of the rank matrix: words, parts, prefixes, spellings, an identifier's start, and signs alone.
RANKED = ("harborRouter", "router", "probe", "Lattice Ribbon", "app.nectar", "method:app", "prune_kernel", "get", "KERNEL SOCKET", "type:", "zephyr", "NectarAnchor", "%", "quarry", "app.cipher.kettlehl", "Builder")
_RANKED = ", ".join(f"('{q}')" for q in RANKED)
_RANK = f""", q AS (SELECT q, lower(q) AS low, {_TOKENS.format('q')} AS words FROM (VALUES {_RANKED}) AS v(q)),
    t AS (SELECT *, lower(qualified_name) AS ql, lower(coalesce(simple_name, '')) AS sl, {_TOKENS.format("coalesce(simple_name, '')")} AS st FROM n),
    r AS (SELECT t.*, q, CASE WHEN stable_id = q THEN 900 WHEN ql = low THEN 700 WHEN sl = low THEN 600 WHEN st = words THEN 500 WHEN starts_with(ql, low) OR starts_with(sl, low) THEN 400
      WHEN starts_with(st, words) OR list_contains(string_split(st, ' '), words) THEN 350 WHEN contains(ql, low) OR contains(st, words) THEN 200 ELSE 0 END AS lexical FROM t, q) """


@_query(_RANK + "SELECT q AS query, project, stable_id, lexical FROM r WHERE lexical > 0", "lexical")
def lexical_rank_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """The rank of every symbol for each of several queries."""
    each = _nodes(spark, folder).withColumn("query", F.explode(F.array(*(F.lit(q) for q in RANKED))))
    rank = names.lexical_rank(F.col("query"), F.col("stable_id"), F.col("qualified_name"), F.col("simple_name"))
    return each.select("query", "project", "stable_id", rank.alias("lexical")).where("lexical > 0")


@_query(_RANK + """, c AS (SELECT *, row_number() OVER (PARTITION BY project, q ORDER BY CASE WHEN qualified_name = q OR simple_name = q THEN 0 ELSE 1 END, stable_id) AS i FROM r
      WHERE q IN ('harborRouter', 'router', 'zephyr') AND (contains(lower(qualified_name), lower(q)) OR contains(lower(simple_name), lower(q)) OR contains(lower(stable_id), lower(q)))),
    ow AS (SELECT *, CASE WHEN json_extract_string(metadata, '$.annotations[0]') LIKE '%Controller' THEN 'CONTROLLER' WHEN json_extract_string(metadata, '$.annotations[0]') LIKE '%Service' THEN 'SERVICE' END AS direct FROM n),
    s AS (SELECT c.*, o.direct, coalesce(o.direct, p.direct) AS role, lexical + CASE WHEN c.file_path IS NOT NULL THEN 80 ELSE 0 END + CASE WHEN c.kind = 'METHOD' AND json_extract_string(c.metadata, '$.has_body') = 'true' THEN 10 ELSE 0 END + CASE WHEN o.direct IS NOT NULL THEN 20 ELSE 0 END AS rank
      FROM c JOIN ow o ON o.project = c.project AND o.stable_id = c.stable_id LEFT JOIN ow p ON p.project = c.project AND c.kind = 'METHOD' AND p.stable_id = 'type:' || regexp_extract(c.stable_id, '^[^:]*:([^#]*)#', 1) WHERE c.i <= 1000 AND lexical > 0)
    SELECT q AS query, project, stable_id, kind, role, rank, nth, n_matched FROM (SELECT *, row_number() OVER (PARTITION BY project, q ORDER BY rank DESC, lower(qualified_name), stable_id) AS nth, count(*) OVER (PARTITION BY project, q) AS n_matched FROM s) WHERE nth <= 10""", "rank", "nth")
def search_symbol(spark: SparkSession, folder: str) -> DataFrame:
    """The first symbols of each project for some queries."""
    nodes = _nodes(spark, folder)
    found = [symbols.search(nodes, q).withColumn("query", F.lit(q)) for q in ("harborRouter", "router", "zephyr")]
    return functools.reduce(DataFrame.unionByName, found)


@_query(""", wanted AS (SELECT DISTINCT project, stable_id, unnest(unresolved) AS name FROM n),
    known AS (SELECT project, simple_name AS name, count(*) AS n_candidates, min(stable_id) AS only_one FROM n WHERE simple_name IS NOT NULL GROUP BY ALL)
    SELECT project, stable_id, name, coalesce(n_candidates, 0) AS n_candidates, CASE WHEN n_candidates = 1 THEN only_one END AS resolved FROM wanted LEFT JOIN known USING (project, name)""")
def resolved_names(spark: SparkSession, folder: str) -> DataFrame:
    return symbols.resolved_names(_nodes(spark, folder))


@_query(""", p AS (SELECT DISTINCT project, qualified_name AS prefix FROM n WHERE kind = 'PACKAGE'), s AS (SELECT project, stable_id, split_part(qualified_name, '#', 1) AS name FROM n WHERE kind <> 'PACKAGE'),
    m AS (SELECT s.project, s.stable_id, p.prefix FROM s LEFT JOIN p ON p.project = s.project AND (s.name = p.prefix OR starts_with(s.name, p.prefix || '.')))
    SELECT project, stable_id, arg_max(prefix, length(prefix)) AS owner FROM m GROUP BY ALL""")
def owning_packages(spark: SparkSession, folder: str) -> DataFrame:
    return symbols.owning_packages(_nodes(spark, folder))


@_query("""WITH own AS (SELECT project_id, generation, stable_id, max(json_extract_string(metadata_json, '$.annotations[0]')) AS direct FROM nodes GROUP BY ALL)
    SELECT o.project_id, o.generation, o.stable_id, o.direct, coalesce(o.direct, t.direct) AS resolved FROM own o LEFT JOIN own t ON t.project_id = o.project_id AND t.generation = o.generation
      AND o.stable_id LIKE '%#%' AND t.stable_id = 'type:' || split_part(regexp_replace(o.stable_id, '^[^:]*:', ''), '#', 1)""")
def resolved_annotations(spark: SparkSession, folder: str) -> DataFrame:
    return symbols.resolved_annotations(table(spark, folder, "nodes"))


@_query("""WITH k AS (SELECT DISTINCT project, stable_id FROM synthetic_nodes), f AS (SELECT *, CASE WHEN file_path IS NOT NULL THEN loaded_at END AS located_at FROM synthetic_nodes),
    m AS (SELECT project, stable_id, loaded_at, unnest(json_keys(metadata)) AS k, metadata FROM synthetic_nodes),
    v AS (SELECT project, stable_id, k || '=' || arg_max(json_extract_string(metadata, '$.' || k), loaded_at) AS kv FROM m GROUP BY project, stable_id, k),
    w AS (SELECT project, stable_id, string_agg(kv, ',' ORDER BY kv) AS metadata FROM v GROUP BY ALL),
    u AS (SELECT project, stable_id, string_agg(name, ',' ORDER BY name) AS unresolved FROM (SELECT DISTINCT project, stable_id, unnest(unresolved) AS name FROM synthetic_nodes) GROUP BY ALL),
    b AS (SELECT project, stable_id, arg_min(qualified_name, loaded_at) AS qualified_name, arg_min(coalesce(simple_name, '~'), loaded_at) AS s, arg_min(file_path, located_at) AS file_path, arg_min(start_line, located_at) AS start_line,
      arg_min(end_line, located_at) AS end_line, count(*) AS n_rows FROM f GROUP BY ALL)
    SELECT b.project, b.stable_id, qualified_name, nullif(s, '~') AS simple_name, file_path, start_line, end_line, coalesce(unresolved, '') AS unresolved, coalesce(metadata, '') AS metadata, n_rows
    FROM b LEFT JOIN w USING (project, stable_id) LEFT JOIN u USING (project, stable_id)""")
def merged_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return symbols.merged_nodes(table(spark, folder, "synthetic_nodes"))


@_query("""SELECT project, stable_id, regexp_replace(stable_id, '^[^:]*:', '') AS signature, split_part(regexp_replace(stable_id, '^[^:]*:', ''), '#', 1) AS declaring_type,
    regexp_extract(regexp_extract(qualified_name, '([^.#]*)$', 1), '^([^(]*)', 1) AS derived, """ + _TOKENS.format("qualified_name") + """ AS tokens,
    lower(regexp_replace(simple_name, '([a-z0-9])([A-Z])', '\\1-\\2', 'g')) AS kebab, translate(regexp_replace(simple_name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS snake,
    CASE WHEN regexp_matches(simple_name, '^[A-Z]{2}') THEN simple_name ELSE lower(simple_name[1]) || simple_name[2:] END AS decapitalised,
    CASE WHEN regexp_matches(lower(simple_name), '^(save|delete|remove)') THEN 'WRITE' WHEN regexp_matches(lower(simple_name), '^(find|read|get|exists|count|list)') THEN 'READ' END AS access FROM n""")
def name_forms(spark: SparkSession, folder: str) -> DataFrame:
    i, q, s = F.col("stable_id"), F.col("qualified_name"), F.col("simple_name")
    return _nodes(spark, folder).select(
        "project", "stable_id", names.signature(i).alias("signature"), names.declaring_type(i).alias("declaring_type"), names.derived_simple_name(q).alias("derived"),
        names.normalised_tokens(q).alias("tokens"), names.kebab(s).alias("kebab"), names.upper_snake(s).alias("snake"), names.decapitalised(s).alias("decapitalised"), names.access_class(s).alias("access"),
    )


@_query("""WITH r AS (SELECT DISTINCT project_id, generation, stable_id, split_part(stable_id, ':', 2) AS verb, regexp_replace(stable_id, '^route:[A-Z]+:', '') AS path FROM nodes WHERE upper(kind) = 'ROUTE')
    SELECT project_id, generation, verb, '/' || regexp_replace(regexp_replace(trim(path), '/+', '/', 'g'), '^/|/$', '', 'g') AS route, count(*) AS n_routes FROM r GROUP BY ALL""")
def normal_routes(spark: SparkSession, folder: str) -> DataFrame:
    routes = table(spark, folder, "nodes").where("upper(kind) = 'ROUTE'").select("project_id", "generation", "stable_id").distinct()
    path = F.regexp_replace("stable_id", "^route:[A-Z]+:", "")
    return routes.groupBy("project_id", "generation", F.split("stable_id", ":")[1].alias("verb"), names.normal_route(path).alias("route")).agg(F.count(F.lit(1)).alias("n_routes"))


@_query("""SELECT project, stable_id, (file_path IS NULL OR regexp_matches(stable_id, '^method:(java[.]|javax[.]|jakarta[.]|org[.]springframework[.])')
      OR (kind = 'METHOD' AND coalesce(regexp_matches(simple_name, '^(get|set|is)'), false)) OR coalesce(simple_name IN ('toString', 'hashCode', 'equals', 'requireNonNull', 'debug', 'info', 'warn', 'error', 'trace'), false)
      OR coalesce(json_extract_string(metadata, '$.generated') = 'true', false)) AS suppressed FROM n""")
def suppression_policy(spark: SparkSession, folder: str) -> DataFrame:
    hidden = names.is_suppressed(*(F.col(c) for c in ("kind", "simple_name", "file_path", "stable_id", "metadata")))
    return _nodes(spark, folder).select("project", "stable_id", hidden.alias("suppressed"))


@_query("""SELECT project, file_path, start_line, end_line FROM n WHERE file_path IS NOT NULL UNION SELECT project, file_path, start_line, end_line FROM o WHERE file_path IS NOT NULL""")
def evidence_locations(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.locations(_nodes(spark, folder), _occurrences(spark, folder))


@_query(""", l AS (SELECT DISTINCT file_path, start_line, end_line FROM o WHERE file_path IS NOT NULL),
    b AS (SELECT *, hex(encode('1' || chr(0) || file_path || chr(0) || start_line || chr(0) || end_line)) AS h FROM l)
    SELECT file_path, start_line, end_line, 'evidence:1:' || lower(lpad(to_hex(CAST(list_reduce(list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS HUGEINT)),
      lambda s, x: (xor(s, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT, 14695981039346656037::HUGEINT) AS UBIGINT)), 16, '0')) AS evidence_id FROM b""")
def evidence_ids(spark: SparkSession, folder: str) -> DataFrame:
    places = _occurrences(spark, folder).where("file_path IS NOT NULL").select("file_path", "start_line", "end_line").distinct()
    return evidence.with_evidence_id(places)


@_query("""SELECT project, source, target, kind, edge_id, nth, file_path, start_line, end_line, ordinal FROM (
    SELECT *, row_number() OVER (PARTITION BY project, source, target, kind ORDER BY edge_id, nth) - 1 AS ordinal FROM o) WHERE ordinal < 2""", "nth", "ordinal")
def first_occurrences(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.first_occurrences(_occurrences(spark, folder), 2)


@_query(""", p AS (SELECT DISTINCT project, file_path, start_line, end_line FROM o WHERE file_path IS NOT NULL AND start_line > 0 AND end_line >= start_line),
    s AS (SELECT project, file_path, start_line AS s, end_line AS e FROM n WHERE file_path IS NOT NULL AND start_line > 0 AND end_line >= start_line)
    SELECT p.project, p.file_path, p.start_line, p.end_line, count(s.s) AS n_symbols FROM p LEFT JOIN s ON s.project = p.project AND s.file_path = p.file_path AND s.s <= p.end_line AND s.e >= p.start_line GROUP BY ALL""")
def evidence_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.overlapping_symbols(_nodes(spark, folder), _occurrences(spark, folder))


@_query("""WITH r AS (SELECT DISTINCT repo, file_path, start_line, end_line FROM analyzer_diagnostics WHERE upper(trim(kind)) LIKE '%PARSE_ERROR' AND start_line > 0 AND end_line >= start_line),
    t AS (SELECT repo, file_path, string_split_regex(regexp_replace(text, '\\r?\\n\\z', ''), '\\r?\\n') AS lines FROM documents WHERE doc_kind = 'source' AND text IS NOT NULL AND text <> ''),
    j AS (SELECT r.*, t.lines, greatest(r.start_line - 2, 1) AS first FROM r JOIN t USING (repo, file_path) WHERE r.start_line <= len(t.lines)),
    x AS (SELECT *, lines[first:end_line + 2] AS part FROM j)
    SELECT repo, file_path, start_line, end_line, first + generate_subscripts(part, 1) - 1 AS line, unnest(part) AS text FROM x""", "line")
def evidence_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines around each reported parse error, from the documents of the same path."""
    reported = table(spark, folder, "analyzer_diagnostics").where("upper(trim(kind)) LIKE '%PARSE_ERROR'")
    return evidence.numbered_lines(reported, table(spark, folder, "documents").where("doc_kind = 'source'"), ["repo", "file_path"])


@_query("WITH t AS (SELECT doc_kind, (length(text) + 3) // 4 AS n FROM documents) SELECT doc_kind, count(n) AS n_texts, CAST(sum(n) AS BIGINT) AS n_tokens, max(n) AS largest FROM t GROUP BY ALL")
def estimated_tokens(spark: SparkSession, folder: str) -> DataFrame:
    estimate = F.ceil(F.char_length("text") / 4)
    return table(spark, folder, "documents").groupBy("doc_kind").agg(F.count("text").alias("n_texts"), F.sum(estimate).alias("n_tokens"), F.max(estimate).alias("largest"))


@_query("""WITH d AS (SELECT unnest(['lang', 'source', 'doc_kind', 'repo']) AS dimension, unnest([lang, source, doc_kind, repo]) AS value, n_chars FROM documents)
    SELECT dimension, value, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total FROM d GROUP BY ALL""")
def corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    return counts.corpus_stats(table(spark, folder, "documents"), ["lang", "source", "doc_kind", "repo"], "n_chars")


@_query("""WITH p AS (SELECT DISTINCT file_path FROM documents UNION SELECT DISTINCT file_path FROM analyzer_diagnostics UNION SELECT '.env' || CASE WHEN doc_id % 2 = 0 THEN '.local' ELSE '' END || '/' || repo FROM documents UNION SELECT repo || '/.env' FROM documents UNION SELECT repo || '\\config\\..\\Client_Secrets.json' FROM documents UNION SELECT '/keys/' || repo || '.PEM' FROM documents),
    l AS (SELECT file_path, lower(replace(file_path, '\\', '/')) AS x FROM p WHERE file_path IS NOT NULL), f AS (SELECT *, string_split(x, '/')[-1] AS name, string_split(x, '/') AS parts FROM l)
    SELECT file_path, name = '.env' OR starts_with(name, '.env.') OR contains(name, 'credential') OR contains(name, 'secret') OR ends_with(name, '.pem') OR ends_with(name, '.key') OR ends_with(name, '.p12') OR ends_with(name, '.pfx') OR contains(x, '/.ssh/') AS sensitive,
      file_path <> '' AND NOT list_contains(parts, '') AND NOT list_contains(parts, '.') AND NOT list_contains(parts, '..') AND NOT regexp_matches(file_path, '^[A-Za-z]:') AS safe FROM f""")
def sensitive_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Whether paths may hold secrets and are safe: those of texts and diagnostics, and some derived from the repositories' names."""
    docs = table(spark, folder, "documents")
    made = docs.selectExpr("explode(array('.env' || CASE WHEN doc_id % 2 = 0 THEN '.local' ELSE '' END || '/' || repo, repo || '/.env', repo || '\\\\config\\\\..\\\\Client_Secrets.json', '/keys/' || repo || '.PEM')) AS file_path")
    paths = docs.select("file_path").union(table(spark, folder, "analyzer_diagnostics").select("file_path")).union(made).where("file_path IS NOT NULL").distinct()
    return paths.select("file_path", names.is_sensitive(F.col("file_path")).alias("sensitive"), names.is_safe_path(F.col("file_path")).alias("safe"))


@_query("""WITH v AS (SELECT mode, shape, total_index_ms AS x FROM performance_runs WHERE total_index_ms >= 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY mode, shape ORDER BY x) AS i, count(*) OVER (PARTITION BY mode, shape) AS n FROM v)
    SELECT mode, shape, n, x AS median FROM r WHERE i = n // 2 + 1""")
def upper_medians(spark: SparkSession, folder: str) -> DataFrame:
    return counts.upper_median(table(spark, folder, "performance_runs").where("total_index_ms >= 0"), ["mode", "shape"], "total_index_ms")


@_query("""WITH v AS (SELECT lower(trim(fixture)) AS fixture, mode, total_index_ms AS x FROM performance_runs WHERE total_index_ms >= 0 AND fixture IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY fixture, mode ORDER BY x) AS i, count(*) OVER (PARTITION BY fixture, mode) AS n FROM v), m AS (SELECT fixture, mode, x FROM r WHERE i = n // 2 + 1)
    SELECT t.fixture, t.x AS base, s.x AS other, 100.0::DOUBLE * (t.x - s.x) / t.x AS reduction FROM m t JOIN m s ON s.fixture = t.fixture AND s.mode = 'safe' WHERE t.mode = 'trusted' AND t.x > 0""")
def paired_reductions(spark: SparkSession, folder: str) -> DataFrame:
    """By how much the safe mode's median run of a fixture is shorter than the trusted one's."""
    runs = table(spark, folder, "performance_runs").where("total_index_ms >= 0 AND fixture IS NOT NULL").withColumn("fixture", F.lower(F.trim("fixture")))
    return counts.paired_reduction(counts.upper_median(runs, ["fixture", "mode"], "total_index_ms"), ["fixture"], "mode", "trusted", "safe")


@_query("""WITH t AS (SELECT project_id, generation, count(DISTINCT stable_id) AS n_nodes FROM nodes GROUP BY ALL),
    s AS (SELECT DISTINCT project_id, generation, state, CAST(json_extract_string(summary_json, '$.nodes_emitted') AS BIGINT) AS n_emitted FROM project_generations)
    SELECT s.*, coalesce(n_nodes, 0) AS n_nodes, n_emitted = coalesce(n_nodes, 0) AS agrees FROM s LEFT JOIN t USING (project_id, generation)""")
def generation_reconciliation(spark: SparkSession, folder: str) -> DataFrame:
    return counts.generation_reconciliation(table(spark, folder, "nodes"), table(spark, folder, "project_generations"))


@_query("""WITH g AS (SELECT DISTINCT project_id, generation, state, partial FROM project_generations), d AS (SELECT project_id, max(generation) AS a FROM g WHERE state IN ('READY', 'STALE') GROUP BY ALL)
    SELECT g.project_id, d.a AS active_generation, max(CASE WHEN g.generation = d.a AND state IN ('READY', 'STALE') THEN state END) = 'STALE' AS stale, bool_or(CASE WHEN g.generation = d.a AND state IN ('READY', 'STALE') THEN partial END) AS partial,
      max(g.generation) AS latest, count(*) AS n_generations, count(*) FILTER (state = 'FAILED' AND coalesce(g.generation > d.a, true)) AS n_failed_since FROM g LEFT JOIN d USING (project_id) GROUP BY g.project_id, d.a""")
def active_generations(spark: SparkSession, folder: str) -> DataFrame:
    return counts.active_generations(table(spark, folder, "project_generations"))


@_query("""WITH g AS (SELECT *, lag(generation) OVER (PARTITION BY project_id ORDER BY generation) AS prior FROM (SELECT DISTINCT project_id, generation FROM project_generations WHERE state IN ('READY', 'STALE'))),
    k AS (SELECT DISTINCT project_id, generation, stable_id FROM nodes), x AS (SELECT g.project_id, g.generation, stable_id FROM g JOIN k ON k.project_id = g.project_id AND k.generation = g.prior),
    a AS (SELECT g.project_id, g.generation, stable_id FROM g JOIN k ON k.project_id = g.project_id AND k.generation = g.generation WHERE prior IS NOT NULL),
    c AS (SELECT project_id, generation, count(x.stable_id) AS n_expected, count(a.stable_id) AS n_actual, count(*) FILTER (x.stable_id IS NOT NULL AND a.stable_id IS NOT NULL) AS n_matched
      FROM x FULL JOIN a USING (project_id, generation, stable_id) GROUP BY ALL)
    SELECT *, CASE WHEN n_actual = 0 THEN 1.0 ELSE n_matched::DOUBLE / n_actual END AS precision, CASE WHEN n_expected = 0 THEN 1.0 ELSE n_matched::DOUBLE / n_expected END AS recall FROM c""")
def claims_precision_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Each complete generation's symbols held against those of the one before, as claims against the truth."""
    order = complete_generations(table(spark, folder, "project_generations")).where("prior IS NOT NULL")
    keys = table(spark, folder, "nodes").select("project_id", "generation", "stable_id")
    actual = keys.join(order.select("project_id", "generation"), ["project_id", "generation"])
    expected = keys.withColumnRenamed("generation", "prior").join(order.select("project_id", "generation", "prior"), ["project_id", "prior"])
    return counts.precision_recall(expected, actual, ["project_id", "generation"], ["stable_id"])


@_query("""SELECT e.project, e.source, e.target, e.kind, CASE WHEN s.stable_id IS NULL THEN 'source' ELSE 'target' END AS missing FROM e LEFT JOIN n s ON s.project = e.project AND s.stable_id = e.source
    LEFT JOIN n t ON t.project = e.project AND t.stable_id = e.target WHERE s.stable_id IS NULL OR t.stable_id IS NULL""")
def dangling_edges(spark: SparkSession, folder: str) -> DataFrame:
    return validate.dangling_edges(_nodes(spark, folder), _edges(spark, folder))


@_query("""WITH x AS (SELECT 1) SELECT project_id, generation, stable_id, count(*) AS n FROM nodes GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(spark: SparkSession, folder: str) -> DataFrame:
    return validate.duplicate_keys(table(spark, folder, "nodes"), ["project_id", "generation", "stable_id"])


@_query("""WITH x AS (SELECT 1) SELECT request_id, ordinal, file_path, start_line, end_line FROM analyzer_diagnostics WHERE (file_path IS NOT NULL OR start_line IS NOT NULL OR end_line IS NOT NULL)
    AND NOT coalesce(file_path IS NOT NULL AND start_line > 0 AND end_line >= start_line, false)""")
def bad_locations(spark: SparkSession, folder: str) -> DataFrame:
    return validate.location_problems(table(spark, folder, "analyzer_diagnostics"), ["request_id", "ordinal"])


@_query("""WITH ids AS (SELECT project, source_stable_id AS stable_id FROM synthetic_edges UNION SELECT project, target_stable_id FROM synthetic_edges UNION SELECT project, stable_id FROM synthetic_nodes)
    SELECT project, stable_id FROM ids WHERE NOT (octet_length(encode(stable_id)) <= 1024 AND (regexp_matches(stable_id, '^(project|crate|module|package|type|trait|function|variant|const|static|macro|associated_type|bean|entity|config):[^\\n\\r]*\\S')
      OR regexp_matches(stable_id, '^method:[^#]+#[^(]+\\(.*\\)$') OR regexp_matches(stable_id, '^constructor:[^#]+#<init>\\(.*\\)$') OR regexp_matches(stable_id, '^field:[^#]+#.+$') OR regexp_matches(stable_id, '^route:(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS):/')))""")
def invalid_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Identifiers of nodes and references that break the grammar of their kind."""
    edges = table(spark, folder, "synthetic_edges")
    ends = edges.select("project", F.explode(F.array("source_stable_id", "target_stable_id")).alias("stable_id"))
    return validate.id_problems(ends.union(table(spark, folder, "synthetic_nodes").select("project", "stable_id")))


_CALLS = """, c AS (SELECT DISTINCT project, source, target FROM e WHERE kind = 'CALLS'),
    starts AS (SELECT project, stable_id FROM n WHERE EXISTS (SELECT 1 FROM c WHERE c.project = n.project AND c.source = n.stable_id) AND NOT EXISTS (SELECT 1 FROM c WHERE c.project = n.project AND c.target = n.stable_id AND c.source <> c.target)),
    p AS (SELECT project, stable_id AS start, stable_id AS node, 0 AS depth, [stable_id] AS path FROM starts
      UNION ALL SELECT p.project, p.start, c.target, p.depth + 1, list_append(p.path, c.target) FROM p JOIN c ON c.project = p.project AND c.source = p.node WHERE p.depth < {depth} AND NOT list_contains(p.path, c.target)) """


@_query(_WITH + _CALLS.format(depth=3) + """SELECT p.project, start, node, depth, array_to_string(path, ' > ') AS path,
    NOT EXISTS (SELECT 1 FROM p q WHERE q.project = p.project AND q.depth = p.depth + 1 AND q.path[:-2] = p.path) AS closed FROM p""")
def trace_all_paths(spark: SparkSession, folder: str) -> DataFrame:
    """All paths of calls, three deep, from every symbol that calls and isn't called."""
    nodes, edges = _nodes(spark, folder), _edges(spark, folder)
    found = traverse.all_paths(traverse.entry_points(nodes, edges, "CALLS"), traverse.steps(edges, ["CALLS"]), 3)
    return found.withColumn("path", F.array_join("path", " > "))


@_query(_WITH + _CALLS.format(depth=4) + "SELECT project, start, node, min(depth) AS depth FROM p WHERE depth > 0 GROUP BY ALL")
def trace_shortest(spark: SparkSession, folder: str) -> DataFrame:
    """What each symbol that calls and isn't called reaches within four calls."""
    nodes, edges = _nodes(spark, folder), _edges(spark, folder)
    return traverse.reached(traverse.entry_points(nodes, edges, "CALLS"), traverse.steps(edges, ["CALLS"]), 4)


@_query(_WITH + """, u AS (SELECT DISTINCT project, source, target FROM e WHERE kind IN ('EXTENDS', 'IMPLEMENTS')), c AS (SELECT project, source AS start, target AS node FROM u
    UNION SELECT c.project, c.start, u.target FROM c JOIN u ON u.project = c.project AND u.source = c.node) SELECT project, start, node FROM c WHERE start <> node""")
def type_closure(spark: SparkSession, folder: str) -> DataFrame:
    """All supertypes of every type, over any number of steps."""
    up = traverse.steps(_edges(spark, folder), ["EXTENDS", "IMPLEMENTS"])
    return traverse.reached(up.select("project", F.col("node").alias("stable_id")), up).select("project", "start", "node")


@_query(_WITH + """, u AS (SELECT DISTINCT project, source, target FROM e WHERE kind IN ('EXTENDS', 'IMPLEMENTS')), c AS (SELECT project, source AS sub, target AS sup FROM u
    UNION SELECT c.project, c.sub, u.target FROM c JOIN u ON u.project = c.project AND u.source = c.sup), k AS (SELECT project, sup, count(DISTINCT sub) AS n, min(sub) AS only_one FROM c WHERE sub <> sup GROUP BY ALL)
    SELECT e.project, e.source AS consumer, e.target AS required, coalesce(k.n, 0) AS n_candidates, CASE WHEN k.n = 1 THEN only_one END AS candidate FROM e LEFT JOIN k ON k.project = e.project AND k.sup = e.target WHERE e.kind = 'INJECTS'""")
def injection_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return traverse.injection_candidates(_edges(spark, folder))


@_query("SELECT project, source AS node, count(DISTINCT target) AS n_next FROM e WHERE kind = 'CALLS' GROUP BY ALL HAVING count(DISTINCT target) > 1")
def branch_points(spark: SparkSession, folder: str) -> DataFrame:
    return traverse.branch_points(traverse.steps(_edges(spark, folder), ["CALLS"]))


@_query(_WITH + PACKAGES + """SELECT project, 'symbols' AS section, kind AS item, count(*) AS n FROM n GROUP BY ALL UNION ALL SELECT project, 'edges', kind, count(*) FROM e GROUP BY ALL
    UNION ALL SELECT project, 'areas', package, n_components FROM """ + _AREAS + """ UNION ALL SELECT project, 'framework', r, CASE WHEN r = 'controllers' THEN (SELECT count(DISTINCT source) FROM e WHERE e.project = x.project AND e.kind = 'EXPOSES_ROUTE')
      ELSE (SELECT count(*) FROM n WHERE n.project = x.project AND n.kind = k AND (r <> 'services' OR contains(lower(json_extract_string(metadata, '$.stereotype')), 'service'))) END
      FROM (SELECT DISTINCT project FROM n) x, (VALUES ('controllers', ''), ('services', 'BEAN'), ('repositories', 'REPOSITORY'), ('entities', 'ENTITY'), ('routes', 'ROUTE'), ('beans', 'BEAN')) v(r, k)
    UNION ALL SELECT project, 'modules', module_name, count(*) FROM n WHERE module_name IS NOT NULL GROUP BY ALL
    UNION ALL SELECT project, 'source sets', json_extract_string(metadata, '$.source_set'), count(*) FROM n WHERE json_extract_string(metadata, '$.source_set') IS NOT NULL GROUP BY ALL""")
def project_map(spark: SparkSession, folder: str) -> DataFrame:
    return packs.project_map(table(spark, folder, "synthetic_nodes"), table(spark, folder, "synthetic_edges"))


@_query("""WITH g AS (SELECT DISTINCT project_id, generation, state, partial, CAST(json_extract_string(summary_json, '$.nodes_emitted') AS BIGINT) AS n_emitted FROM project_generations),
    d AS (SELECT project_id, max(generation) FILTER (state IN ('READY', 'STALE')) AS a FROM g GROUP BY ALL), f AS (SELECT g.project_id, count(*) AS k FROM g JOIN d USING (project_id) WHERE state = 'FAILED' AND coalesce(generation > a, true) GROUP BY ALL),
    t AS (SELECT project_id, generation, count(DISTINCT stable_id) AS n_nodes FROM nodes GROUP BY ALL)
    SELECT p.project_id, p.display_name, p.language, d.a AS active_generation, g.state = 'STALE' AS stale, CASE WHEN d.project_id IS NOT NULL THEN coalesce(f.k, 0) END AS n_failed_since, g.n_emitted,
      CASE WHEN g.generation IS NOT NULL THEN coalesce(t.n_nodes, 0) END AS n_nodes, g.n_emitted = coalesce(t.n_nodes, 0) AS agrees
    FROM projects p LEFT JOIN d USING (project_id) LEFT JOIN f USING (project_id) LEFT JOIN g ON g.project_id = p.project_id AND g.generation = d.a LEFT JOIN t ON t.project_id = p.project_id AND t.generation = d.a""")
def index_status(spark: SparkSession, folder: str) -> DataFrame:
    return packs.index_status(*(table(spark, folder, n) for n in ("projects", "project_generations", "nodes")))


@_query("""WITH j AS (SELECT DISTINCT project, stable_id, metadata FROM synthetic_nodes), t AS (SELECT project, stable_id, unnest(json_keys(metadata)) AS path, metadata FROM j)
    SELECT project, stable_id, path, json_extract_string(metadata, '$.' || path) AS value FROM t""")
def flattened_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return symbols.flattened(table(spark, folder, "synthetic_nodes").select("project", "stable_id", "metadata").distinct(), ["project", "stable_id"], "metadata")


@_query(_WITH + """, shown AS (SELECT project, stable_id FROM n WHERE file_path IS NOT NULL), c AS (SELECT DISTINCT e.project, e.target AS source, e.source AS target FROM e JOIN shown s ON s.project = e.project AND s.stable_id = e.source WHERE e.kind IN ('INJECTS', 'SELECTED_BEAN', 'BEAN_CANDIDATE', 'CALLS')),
    starts AS (SELECT DISTINCT e.project, e.target AS stable_id FROM e WHERE e.kind = 'INJECTS'),
    p AS (SELECT project, stable_id AS start, stable_id AS node, 0 AS depth, [stable_id] AS path FROM starts
      UNION ALL SELECT p.project, p.start, c.target, p.depth + 1, list_append(p.path, c.target) FROM p JOIN c ON c.project = p.project AND c.source = p.node WHERE p.depth < 2 AND NOT list_contains(p.path, c.target))
    SELECT project, start, node, depth, array_to_string(path, ' > ') AS path FROM p""")
def trace_inbound_suppressed(spark: SparkSession, folder: str) -> DataFrame:
    """Who leads to an injected type within two steps, symbols without a file hidden."""
    edges = table(spark, folder, "synthetic_edges")
    starts = _edges(spark, folder).where("kind = 'INJECTS'").select("project", F.col("target").alias("stable_id")).distinct()
    found = packs.trace(table(spark, folder, "synthetic_nodes"), edges, starts, ["CALLS"], ["dependencies"], inbound=True, depth=2)
    return found.select("project", "start", "node", "depth", F.array_join("path", " > ").alias("path"))


@_query("""WITH f AS (SELECT DISTINCT repo, file_path, coalesce(md5(text), 'none') AS digest FROM documents WHERE doc_kind = 'source' AND file_path IS NOT NULL),
    h AS (SELECT repo, sha256(file_path || chr(10) || digest) AS h FROM f), s AS (SELECT repo, count(*) AS n_files, """ + ", ".join(f"sum(CAST('0x' || substr(h, {at}, 15) AS HUGEINT)) AS s{at}" for at in (1, 16, 31, 46)) + """ FROM h GROUP BY ALL)
    SELECT repo, n_files, sha256(concat_ws(':', 'safe', s1, s16, s31, s46)) AS fingerprint FROM s""")
def source_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return counts.fingerprints(table(spark, folder, "documents").where("doc_kind = 'source'"), ["repo"], "file_path", "text", "safe")


@_query("""WITH h AS (SELECT project_id, canonical_root, sha1(unhex('2bbd078153ac4e839e4b87ecad76bf89') || encode(replace(canonical_root, '\\', '/'))) AS h FROM projects),
    u AS (SELECT *, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || translate(h[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32] AS expected FROM h)
    SELECT project_id, expected, project_id = expected AS agrees FROM u""")
def project_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Each project's identifier beside the one that follows from its root folder."""
    expected = names.project_id(F.col("canonical_root"))
    return table(spark, folder, "projects").select("project_id", expected.alias("expected"), (F.col("project_id") == expected).alias("agrees"))
