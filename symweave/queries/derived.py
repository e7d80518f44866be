"""Queries over facts whose descriptor rows are derived from the given tables, one row or more for each of theirs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symweave.operators import derive, evidence, sessions, validate
from symweave.plans import packs
from symweave.queries.graph import SQL as GRAPH_SQL
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


_ROUTES = """WITH t AS (SELECT n_nationkey AS type_id, CASE WHEN n_nationkey % 3 = 0 THEN [''] ELSE ['/r' || n_regionkey || '/', '//n' || n_nationkey] END AS prefixes FROM nation),
  m AS (SELECT c_nationkey AS type_id, c_custkey AS method_id, CASE WHEN c_custkey % 4 = 0 THEN [''] ELSE ['/c' || c_custkey % 10 || '/', 'x/' || c_custkey % 7] END AS suffixes, CASE c_custkey % 5 WHEN 0 THEN [] WHEN 1 THEN ['get', 'POST'] ELSE ['get'] END AS verbs FROM customer),
  a AS (SELECT method_id, type_id, suffixes, unnest(verbs) AS verb FROM m), b AS (SELECT method_id, verb, suffixes, unnest(prefixes) AS prefix FROM a JOIN t USING (type_id)), c AS (SELECT method_id, verb, prefix, unnest(suffixes) AS suffix FROM b),
  r AS (SELECT DISTINCT method_id, upper(verb) AS verb, '/' || trim(regexp_replace(prefix || '/' || suffix, '/+', '/', 'g'), '/') AS path FROM c) """


def _mapped(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    types = table(spark, folder, "nation").selectExpr("n_nationkey AS type_id", "CASE WHEN n_nationkey % 3 = 0 THEN array() ELSE array('/r' || n_regionkey || '/', '//n' || n_nationkey) END AS prefixes")
    methods = table(spark, folder, "customer").selectExpr(
        "c_nationkey AS type_id", "c_custkey AS method_id", "CASE WHEN c_custkey % 4 = 0 THEN array() ELSE array('/c' || c_custkey % 10 || '/', 'x/' || c_custkey % 7) END AS suffixes", "CASE c_custkey % 5 WHEN 0 THEN array() WHEN 1 THEN array('get', 'POST') ELSE array('get') END AS verbs"
    )
    return types, methods


@_query(_ROUTES + "SELECT * FROM r")
def composed_routes(spark: SparkSession, folder: str) -> DataFrame:
    """The routes of customers' methods below the prefixes of their nations."""
    return derive.composed_routes(*_mapped(spark, folder))


@_query(_ROUTES + "SELECT verb, path, count(DISTINCT method_id) AS n_handlers, min(method_id) AS first_handler FROM r GROUP BY ALL HAVING count(DISTINCT method_id) > 1")
def duplicate_routes(spark: SparkSession, folder: str) -> DataFrame:
    return derive.duplicate_routes(composed_routes(spark, folder))


@_query("SELECT c_custkey AS method_id FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 4 <> 0")
def routes_without_verb(spark: SparkSession, folder: str) -> DataFrame:
    return derive.routes_without_verb(_mapped(spark, folder)[1])


@_query("""WITH p AS (SELECT c_custkey AS point_id, c_nationkey AS required, CASE WHEN c_custkey % 11 = 0 THEN 'q' || c_custkey % 22 END AS qualifier, 'Supplier#' || lpad(CAST(c_custkey % 40 AS VARCHAR), 9, '0') AS name FROM customer),
    c AS (SELECT s_name AS bean, unnest([s_nationkey, s_nationkey + 1, s_nationkey]) AS required, 'q' || s_suppkey % 22 AS q, s_suppkey % 9 = 0 AS is_primary FROM supplier), m AS (SELECT DISTINCT p.*, bean, q, is_primary FROM p LEFT JOIN c USING (required)),
    g AS (SELECT point_id, qualifier, count(bean) AS n, count(*) FILTER (is_primary) AS np, min(bean) FILTER (q = qualifier OR bean = qualifier) AS bq, max(bean) AS b, max(bean) FILTER (is_primary) AS bp, count(*) FILTER (bean = name) AS nn FROM m GROUP BY ALL)
    SELECT g.point_id, n AS n_candidates, CASE WHEN g.qualifier IS NOT NULL THEN bq WHEN n = 1 THEN b WHEN np = 1 THEN bp WHEN np = 0 AND nn = 1 THEN p.name END AS selected,
      CASE WHEN g.qualifier IS NOT NULL THEN CASE WHEN bq IS NOT NULL THEN 'qualifier' ELSE 'unresolved qualifier' END WHEN n = 0 THEN 'none' WHEN n = 1 THEN 'only candidate' WHEN np > 1 THEN 'several primaries' WHEN np = 1 THEN 'primary' WHEN nn = 1 THEN 'name' ELSE 'ambiguous' END AS reason
    FROM g JOIN p USING (point_id)""")
def selected_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """For each customer the supplier of its nation, by qualifier, as the only one, as the primary one or by name."""
    points = table(spark, folder, "customer").selectExpr("c_custkey AS point_id", "c_nationkey AS required", "CASE WHEN c_custkey % 11 = 0 THEN 'q' || c_custkey % 22 END AS qualifier", "'Supplier#' || lpad(c_custkey % 40, 9, '0') AS name")
    beans = table(spark, folder, "supplier").selectExpr("s_name AS bean", "array(s_nationkey, s_nationkey + 1, s_nationkey) AS assignable", "array('q' || s_suppkey % 22) AS qualifiers", "s_suppkey % 9 = 0 AS is_primary")
    return derive.selected_candidates(points, beans)


#: Methods of repositories, their queries, and what they mean for parts with the fields name, size, type and price.
_METHODS = (
    ("findByNameAndSizeGreaterThanOrderByNameDesc", None, "derived", "FIND", "name EQUALS,size GREATER_THAN", "name", "DESC", False), ("countByTypeIn", None, "derived", "COUNT", "type IN", None, None, False),
    ("deleteByURLThingContaining", None, None, None, None, None, None, True), ("readBrand", None, None, None, None, None, None, False), ("existsByPriceBetweenOrNameIsNotNull", None, "derived", "EXISTS", "price BETWEEN,name IS_NOT_NULL", None, None, False),
    ("getFirstByNameIsNull", None, None, None, None, None, None, True), ("findByWrong", "select p", "explicit", "READ", None, None, None, False), ("readByNameIgnoreCaseOrderBySizeAsc", None, "derived", "READ", "name IGNORE_CASE", "size", "ASC", False),
)


@_query("SELECT 'Repository' || p_partkey AS repository, method, kind, CASE WHEN kind = 'explicit' AND p_size > 25 THEN 'WRITE' ELSE operation END AS operation, predicates, order_field, direction, unparsed FROM part JOIN (VALUES "
        + ", ".join(f"({i}, " + ", ".join("NULL" if v is None else repr(v) for v in (m, *rest)) + ")" for i, (m, _, *rest) in enumerate(_METHODS)) + f") v(i, method, kind, operation, predicates, order_field, direction, unparsed) ON i = p_partkey % {len(_METHODS)}")
def parsed_queries(spark: SparkSession, folder: str) -> DataFrame:
    """The query methods of the parts' repositories, held against their fields."""
    nth = (F.col("p_partkey") % len(_METHODS) + 1).cast("int")
    of = lambda i: F.element_at(F.array(*(F.lit(m[i]).cast("string") for m in _METHODS)), nth)
    methods = table(spark, folder, "part").select(F.concat(F.lit("Repository"), "p_partkey").alias("repository"), of(0).alias("method"), of(1).alias("query"), (F.col("p_size") > 25).alias("modifying"))
    found = derive.parsed_queries(methods, methods.select("repository", F.array(*(F.lit(f) for f in ("name", "size", "type", "price"))).alias("fields")))
    return found.withColumn("predicates", F.array_join(F.transform("predicates", lambda p: F.concat_ws(" ", p["field"], p["operator"])), ","))


#: Texts of types with what they mean in a file that imports List and Order, within the package app.
_TYPES = (("List<Map<String, List<? extends A>>>", "java.util.List"), ("Order []", "shop.Order[]"), ("int...", "int[]"), ("a.b.C<D>", "a.b.C"), ("Other", "app.Other"), ("Map.Entry<K,V>[][]", "Map.Entry[][]"))


@_query("SELECT 'f' || o_custkey AS file_path, t AS type_text, q AS qualified FROM orders JOIN (VALUES " + ", ".join(f"({i}, '{t}', '{q}')" for i, (t, q) in enumerate(_TYPES)) + f") v(i, t, q) ON i = o_orderkey % {len(_TYPES)}")
def qualified_types(spark: SparkSession, folder: str) -> DataFrame:
    """The types used by orders, in files of customers with two imports each."""
    text = F.element_at(F.array(*(F.lit(t) for t, _ in _TYPES)), (F.col("o_orderkey") % len(_TYPES) + 1).cast("int"))
    uses = table(spark, folder, "orders").select(F.concat(F.lit("f"), "o_custkey").alias("file_path"), F.lit("app").alias("package_name"), text.alias("type_text"))
    pairs = F.array(F.struct(F.lit("List").alias("s"), F.lit("java.util.List").alias("q")), F.struct(F.lit("Order").alias("s"), F.lit("shop.Order").alias("q")))
    imports = uses.select("file_path").distinct().select("file_path", F.explode(pairs).alias("p")).select("file_path", F.col("p.s").alias("simple_name"), F.col("p.q").alias("qualified_name"))
    return derive.qualified_types(uses, imports)


@_query("""SELECT DISTINCT 'order' || l_orderkey AS caller, 'Supplier' || l_suppkey AS repository, 'Domain' || l_suppkey % 7 AS domain, CASE WHEN l_linestatus = 'F' AND l_linenumber = 1 THEN 'WRITE' WHEN l_returnflag = 'R' THEN 'WRITE' WHEN l_returnflag = 'A' THEN 'READ' END AS access,
    CASE WHEN l_discount > 0.05 THEN 'STATIC_INFERRED' ELSE 'FRAMEWORK_RESOLVED' END AS confidence FROM lineitem WHERE l_suppkey % 2 = 0""")
def repository_calls(spark: SparkSession, folder: str) -> DataFrame:
    """The calls of orders on suppliers, of which every other one is a repository."""
    calls = table(spark, folder, "lineitem").selectExpr("'order' || l_orderkey AS caller", "'Supplier' || l_suppkey AS receiver_type", "CASE l_returnflag WHEN 'R' THEN 'saveLine' WHEN 'A' THEN 'findLine' ELSE 'touch' END AS method", "l_linestatus = 'F' AND l_linenumber = 1 AS modifying", "l_discount > 0.05 AS conditional")
    repositories = table(spark, folder, "supplier").where("s_suppkey % 2 = 0").selectExpr("'Supplier' || s_suppkey AS type", "'Domain' || s_suppkey % 7 AS domain")
    return derive.repository_calls(calls, repositories)


@_query("""SELECT DISTINCT 'Order' || o_orderkey AS entity, 'customer' AS field, 'MANY_TO_ONE' AS relation, 'Customer' || (o_custkey + o_orderkey % 3) AS target, EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey + o_orderkey % 3 AND c_acctbal >= 0) AS known FROM orders WHERE o_orderstatus <> 'P'""")
def entity_relations(spark: SparkSession, folder: str) -> DataFrame:
    """The relations of orders to customers, of which those with a debt are no entities; pending orders have none."""
    fields = table(spark, folder, "orders").selectExpr("'Order' || o_orderkey AS entity", "'customer' AS field", "CASE WHEN o_orderstatus <> 'P' THEN 'MANY_TO_ONE' END AS relation", "'Customer' || (o_custkey + o_orderkey % 3) AS type")
    entities = table(spark, folder, "customer").where("c_acctbal >= 0").selectExpr("'Customer' || c_custkey AS entity").union(table(spark, folder, "orders").selectExpr("'Order' || o_orderkey"))
    return derive.entity_relations(fields, entities)


@_query("""WITH e AS (SELECT DISTINCT 'user' || user_id AS method, CASE WHEN event_id % 10 > 0 THEN event_type END AS event, event_id % 3 = 0 AS listens FROM events)
    SELECT method, CASE WHEN listens THEN 'LISTENS_TO_EVENT' ELSE 'PUBLISHES_EVENT' END AS kind, event, event IS NOT NULL AND event NOT IN ('click', 'view') AS external FROM e""")
def event_links(spark: SparkSession, folder: str) -> DataFrame:
    """Who publishes and who listens to which events; only some types are known, and some events have none."""
    rows = table(spark, folder, "events").selectExpr("'user' || user_id AS method", "CASE WHEN event_id % 10 > 0 THEN event_type END AS event", "event_id % 3 = 0 AS listens")
    types = table(spark, folder, "events").select(F.col("event_type").alias("type")).where("type IN ('click', 'view')")
    return derive.event_links(rows.where("NOT listens"), rows.where("listens"), types)


@_query("SELECT repo, CASE max(CASE WHEN doc_id % 31 = 7 THEN 2 WHEN doc_id % 13 = 5 OR lang IS NULL THEN 1 ELSE 0 END) WHEN 2 THEN 'inactive' WHEN 1 THEN 'unknown' ELSE 'active' END AS state FROM documents GROUP BY repo")
def joint_conditions(spark: SparkSession, folder: str) -> DataFrame:
    """The joint state of the conditions that a repository's texts stand for."""
    states = table(spark, folder, "documents").selectExpr("repo", "CASE WHEN doc_id % 31 = 7 THEN 'inactive' WHEN doc_id % 13 = 5 OR lang IS NULL THEN 'odd' ELSE 'active' END AS state")
    return derive.joint_condition(states, ["repo"])


@_query("""WITH l AS (SELECT project_id, min(generation) AS a, max(generation) AS b FROM nodes GROUP BY ALL), e AS (SELECT DISTINCT project_id || ' ' || kind AS question_id, kind AS category, project_id, stable_id, package_name FROM nodes JOIN l USING (project_id) WHERE generation = a),
    c AS (SELECT DISTINCT project_id, stable_id, package_name FROM nodes JOIN l USING (project_id) WHERE generation = b)
    SELECT question_id, category, count(*) FILTER (EXISTS (SELECT 1 FROM c WHERE c.project_id = e.project_id AND c.stable_id = e.stable_id AND c.package_name IS NOT DISTINCT FROM e.package_name)) AS n_matched, count(*) AS n_expected,
      count(*) FILTER (EXISTS (SELECT 1 FROM c WHERE c.project_id = e.project_id AND c.stable_id = e.stable_id AND c.package_name IS NOT DISTINCT FROM e.package_name)) = count(*) AS passed FROM e GROUP BY ALL""")
def matched_questions(spark: SparkSession, folder: str) -> DataFrame:
    """For each project and kind: which symbols of its first generation are in its last, packages compared null-safe."""
    rows = table(spark, folder, "nodes")
    ends = rows.groupBy("project_id").agg(F.min("generation").alias("a"), F.max("generation").alias("b"))
    both = rows.join(ends, "project_id")
    expected = both.where("generation = a").select(F.concat_ws(" ", "project_id", "kind").alias("question_id"), F.col("kind").alias("category"), "project_id", "stable_id", "package_name")
    return sessions.matched_questions(expected, both.where("generation = b"), ["project_id", "stable_id", "package_name"])


@_query("""WITH d AS (SELECT request_id AS question_id, ordinal, file_path, start_line, end_line FROM analyzer_diagnostics), g AS (SELECT * FROM d WHERE ordinal % 3 <> 1), x AS (SELECT DISTINCT question_id, file_path, start_line + 1 AS s, end_line + 1 AS e FROM d WHERE ordinal % 5 = 0 AND file_path IS NOT NULL AND start_line > 0 AND end_line >= start_line),
    o AS (SELECT question_id, bool_and(coalesce(start_line > 0 AND end_line >= start_line AND file_path IS NOT NULL, false)) AS sound FROM g GROUP BY ALL),
    m AS (SELECT question_id, bool_and(EXISTS (SELECT 1 FROM g WHERE g.question_id = x.question_id AND g.file_path = x.file_path AND g.start_line > 0 AND g.end_line >= g.start_line AND g.start_line <= x.e AND g.end_line >= x.s)) AS met FROM x GROUP BY ALL)
    SELECT question_id, CASE WHEN met IS NULL THEN sound ELSE met AND coalesce(sound, false) END AS verified FROM o FULL JOIN m USING (question_id)""")
def verified_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the diagnostics of a request are sound and meet the places expected of some of them."""
    rows = table(spark, folder, "analyzer_diagnostics").withColumnRenamed("request_id", "question_id")
    expected = rows.where("ordinal % 5 = 0 AND file_path IS NOT NULL AND start_line > 0 AND end_line >= start_line").selectExpr("question_id", "file_path", "start_line + 1 AS start_line", "end_line + 1 AS end_line")
    return sessions.verified_evidence(rows.where("ordinal % 3 <> 1").select("question_id", "file_path", "start_line", "end_line"), expected)


@_query("""WITH r AS (SELECT doc_kind AS mode, repo AS question_id, lower(coalesce(text, '')) AS answer, [lang, source] AS claims, doc_id % 3 = 0 AS uncertain FROM documents), t AS (SELECT repo AS question_id, length(repo) % 2 = 0 AS due FROM repositories),
    s AS (SELECT *, CASE WHEN contains(answer, 'error') THEN 1 ELSE 0 END + CASE WHEN contains(answer, 'todo') OR list_contains(list_transform(claims, lambda c: lower(c)), 'todo') THEN 1 ELSE 0 END + CASE WHEN contains(answer, 'rust') OR list_contains(claims, 'rust') THEN 1 ELSE 0 END AS f FROM r JOIN t USING (question_id))
    SELECT mode, question_id, coalesce(list_contains(claims, 'java'), false) AND f = 0 AND (NOT due OR uncertain) AS correct, f AS n_forbidden FROM s""", "n_forbidden")
def scored_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Texts as answers on their repository: they must claim java, must not speak of errors, and must be unsure where that is due."""
    runs = table(spark, folder, "documents").selectExpr("doc_kind AS mode", "repo AS question_id", "text AS answer", "array(lang, source) AS claims", "doc_id % 3 = 0 AS uncertainty_reported")
    truth = table(spark, folder, "repositories").selectExpr("repo AS question_id", "array('java') AS required", "array('error', 'TODO', 'Rust') AS forbidden", "length(repo) % 2 = 0 AS needs_uncertainty")
    return sessions.scored_runs(runs, truth)


_EVENTS = "CASE WHEN s.nodes_emitted % 7 = 1 THEN {0}('project_metadata', 'analysis_started', 'node', 'odd', 'edge') WHEN s.nodes_emitted % 5 = 1 THEN {0}('analysis_started', 'node', 'edge', 'node', 'analysis_summary', 'analysis_summary', 'analysis_completed') ELSE {0}('analysis_started', 'project_metadata', 'module_discovered', 'module_discovered', 'node', 'edge', 'diagnostic', 'analysis_summary', 'analysis_completed') END"


@_query(f"""WITH s AS (SELECT DISTINCT request_id, nodes_emitted FROM analysis_summaries), x AS (SELECT request_id, nodes_emitted, {_EVENTS.format('list_value')} AS t FROM s), e AS (SELECT request_id, nodes_emitted, unnest(t) AS type, generate_subscripts(t, 1) - 1 AS ordinal FROM x),
    p AS (SELECT *, list_position(['analysis_started', 'project_metadata', 'module_discovered', 'node', 'edge', 'diagnostic', 'analysis_summary', 'analysis_completed'], type) - 1 AS phase FROM e),
    w AS (SELECT *, lag(phase) OVER v AS before, row_number() OVER v AS nth, lead(ordinal) OVER v IS NULL AS last FROM p WINDOW v AS (PARTITION BY request_id, nodes_emitted ORDER BY ordinal)),
    q AS (SELECT request_id || ' ' || nodes_emitted AS request_id, ordinal, CASE WHEN phase IS NULL THEN 'unknown type' WHEN nth = 1 AND phase <> 0 THEN 'no start' WHEN before > phase OR (phase IN (0, 1, 6, 7) AND before = phase) THEN 'out of order' WHEN last AND phase <> 7 THEN 'no completion' END AS problem FROM w)
    SELECT * FROM q WHERE problem IS NOT NULL""", "ordinal")
def event_order_problems(spark: SparkSession, folder: str) -> DataFrame:
    """The order of the events of each analysis, of which some are out of order."""
    requests = table(spark, folder, "analysis_summaries").select("request_id", "nodes_emitted").distinct()
    events = requests.alias("s").select(F.concat_ws(" ", "request_id", F.col("nodes_emitted").cast("string")).alias("request_id"), F.posexplode(F.expr(_EVENTS.format("array"))).alias("ordinal", "type"))
    return validate.event_order_problems(events)


@_query(f"""WITH i AS ({GRAPH_SQL['evidence_ids']}) SELECT a.evidence_id, i.file_path, i.start_line, i.end_line FROM (SELECT DISTINCT CASE WHEN start_line % 3 = 0 THEN evidence_id || 'x' ELSE evidence_id END AS evidence_id FROM i) a LEFT JOIN i USING (evidence_id)""")
def evidence_by_id(spark: SparkSession, folder: str) -> DataFrame:
    """The places of evidence identifiers, of which a third are unknown."""
    from symweave.queries.graph import evidence_ids

    known = evidence_ids(spark, folder)
    asked = known.select(F.when(F.col("start_line") % 3 == 0, F.concat("evidence_id", F.lit("x"))).otherwise(F.col("evidence_id")).alias("evidence_id")).distinct()
    return asked.join(known, "evidence_id", "left").select("evidence_id", "file_path", "start_line", "end_line")


@_query("""WITH d AS (SELECT DISTINCT repo, file_path, start_line, end_line FROM analyzer_diagnostics WHERE file_path IS NOT NULL AND start_line > 0 AND end_line >= start_line),
    g AS (SELECT *, greatest(0, least(4, 200 - 4 * (row_number() OVER (PARTITION BY repo ORDER BY start_line, eid, file_path) - 1))) // 2 AS n_context FROM (SELECT *, file_path || ' ' || start_line || ' ' || end_line AS eid FROM d)),
    t AS (SELECT repo, file_path, string_split_regex(regexp_replace(text, '\\r?\\n\\z', ''), '\\r?\\n') AS lines FROM documents WHERE doc_kind = 'source' AND text IS NOT NULL AND text <> ''),
    j AS (SELECT g.*, lines, greatest(start_line - n_context, 1) AS f FROM g JOIN t USING (repo, file_path) WHERE greatest(start_line - n_context, 1) <= len(lines)), x AS (SELECT *, lines[f:end_line + n_context] AS part FROM j)
    SELECT repo, count(*) AS n_lines, CAST(sum(line) AS BIGINT) AS line_sum, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM (SELECT repo, f + generate_subscripts(part, 1) - 1 AS line, unnest(part) AS text FROM x) GROUP BY repo""")
def evidence_pack(spark: SparkSession, folder: str) -> DataFrame:
    """The evidence of every repository's diagnostics with 200 lines of context among them, in sums of its lines."""
    places = table(spark, folder, "analyzer_diagnostics").where("file_path IS NOT NULL AND start_line > 0 AND end_line >= start_line").select("repo", "file_path", "start_line", "end_line").distinct()
    # In order of the first line, then of the place: the order of the identifiers themselves is that of a hash.
    asked = evidence.with_evidence_id(places).select("repo", F.struct("start_line", F.concat_ws(" ", "file_path", "start_line", "end_line")).alias("nth"), "evidence_id")
    found = packs.evidence(asked, places, table(spark, folder, "documents").where("doc_kind = 'source'").select("repo", "file_path", "text"), 200)
    return found.groupBy("repo").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("line").alias("line_sum"), F.sum(F.char_length("text")).alias("n_chars"))
