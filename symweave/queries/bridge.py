"""Queries over a graph of endpoints that is derived from the tables of orders: routes of nations, handled by methods of customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symweave.operators import counts, endpoints, symbols, traverse
from symweave.queries.graph import PACKAGES
from symweave.tables import table

QUERIES = {}
SQL = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

_CONTROLLER = "'app.r' || n_regionkey || '.N' || n_nationkey || 'Controller'"
_CUSTOMER = f"'method:' || {_CONTROLLER} || '#customer' || c_custkey || '()'"
_ORDER = "'method:app.orders.Orders#place' || {} || '()'"
_SUPPLIER = "'app.r' || n_regionkey || '.Supplier' || s_suppkey || 'Repository'"

#: The nodes, in SQL that both sides read; the queries' own work is not in it.
_NODES = f"""
  SELECT 'PACKAGE' AS kind, 'package:app.r' || r_regionkey AS stable_id, 'app.r' || r_regionkey AS qualified_name, 'r' || r_regionkey AS simple_name, 'app.r' || r_regionkey AS package_name,
    CAST(NULL AS STRING) AS file_path, CAST(NULL AS INT) AS start_line, CAST(NULL AS INT) AS end_line, 'STATIC_INFERRED' AS confidence, '{{{{}}}}' AS metadata FROM {{region}}
  UNION ALL SELECT 'TYPE', 'type:' || {_CONTROLLER}, {_CONTROLLER}, 'N' || n_nationkey || 'Controller', 'app.r' || n_regionkey, 'src/main/N' || n_nationkey || '.java', 1, 40, 'COMPILER_RESOLVED',
    '{{{{"annotations":["RestController"],"source_set":"main"}}}}' FROM {{nation}}
  UNION ALL SELECT 'ROUTE', 'route:GET:/nations/' || n_nationkey, 'GET /nations/' || n_nationkey, '/nations/' || n_nationkey, 'app.r' || n_regionkey, 'src/main/N' || n_nationkey || '.java', 5, 9,
    CASE WHEN n_nationkey % 5 = 0 THEN 'AMBIGUOUS' ELSE 'COMPILER_RESOLVED' END, '{{{{"http_method":"GET","path":"/nations/' || n_nationkey || '"}}}}' FROM {{nation}}
  UNION ALL SELECT 'METHOD', {_CUSTOMER}, {_CONTROLLER} || '.customer' || c_custkey, 'customer' || c_custkey, 'app.r' || n_regionkey, 'src/main/N' || n_nationkey || '.java', CAST(c_custkey % 900 + 1 AS INT), CAST(c_custkey % 900 + 4 AS INT),
    'COMPILER_RESOLVED', '{{{{"declaring_type":"type:' || {_CONTROLLER} || '"}}}}' FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey
  UNION ALL SELECT 'REPOSITORY', 'type:' || {_SUPPLIER}, {_SUPPLIER}, 'Supplier' || s_suppkey || 'Repository', 'app.r' || n_regionkey, 'src/main/N' || n_nationkey || '.java', 1, 12, 'COMPILER_RESOLVED', '{{{{}}}}'
    FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey
  UNION ALL SELECT 'ENTITY', 'entity:app.parts.Part' || p_partkey, 'app.parts.Part' || p_partkey, 'Part' || p_partkey, 'app.parts', 'src/main/Parts.java', 1, 20, 'COMPILER_RESOLVED', '{{{{}}}}' FROM {{part}}
  UNION ALL SELECT 'BEAN', 'bean:' || p_brand, p_brand, p_brand, 'app.parts', 'src/main/Brands.java', 1, 2, 'COMPILER_RESOLVED', '{{{{"stereotype":"Service"}}}}' FROM (SELECT DISTINCT p_brand FROM {{part}}) AS b
  UNION ALL SELECT 'METHOD', {_ORDER.format('o_orderkey')}, 'app.orders.Orders.place' || o_orderkey, 'place' || o_orderkey, 'app.orders', CASE WHEN o_orderstatus = 'F' THEN 'src/test/Orders.java' ELSE 'src/main/Orders.java' END, 1, 4,
    CASE WHEN o_orderstatus = 'P' THEN 'STATIC_INFERRED' ELSE 'COMPILER_RESOLVED' END, '{{{{}}}}' FROM {{orders}}
  UNION ALL SELECT 'EVENT_TYPE', 'type:app.events.' || event_type, 'app.events.' || event_type, event_type, 'app.events', CASE WHEN event_type <> 'error' THEN 'src/main/Events.java' END, 1, 2, 'COMPILER_RESOLVED', '{{{{}}}}'
    FROM (SELECT DISTINCT event_type FROM {{events}}) AS t"""

_EDGES = f"""
  SELECT source, target, kind, count(*) AS n_rows FROM (
    SELECT {_ORDER.format('l_orderkey')} AS source, 'entity:app.parts.Part' || l_partkey AS target, CASE l_returnflag WHEN 'R' THEN 'WRITES_ENTITY' WHEN 'A' THEN 'READS_ENTITY' ELSE 'READS' END AS kind FROM {{lineitem}}
    UNION ALL SELECT {_ORDER.format('l_orderkey')}, 'type:' || {_SUPPLIER}, 'USES_REPOSITORY' FROM {{lineitem}} JOIN {{supplier}} ON s_suppkey = l_suppkey JOIN {{nation}} ON n_nationkey = s_nationkey
    UNION ALL SELECT {_CUSTOMER}, 'type:app.events.' || event_type, 'PUBLISHES_EVENT' FROM {{events}} JOIN {{customer}} ON c_custkey = user_id JOIN {{nation}} ON c_nationkey = n_nationkey
    UNION ALL SELECT {_CUSTOMER}, {_ORDER.format('o_orderkey')}, 'CALLS' FROM {{orders}} JOIN {{customer}} ON c_custkey = o_custkey JOIN {{nation}} ON c_nationkey = n_nationkey
    UNION ALL SELECT {_ORDER.format('o_orderkey')}, {_CUSTOMER}, 'CALLS' FROM {{orders}} JOIN {{customer}} ON c_custkey = o_custkey JOIN {{nation}} ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT 'route:GET:/nations/' || n_nationkey, {_CUSTOMER}, 'HANDLED_BY' FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey WHERE c_custkey % 50 = 0
    UNION ALL SELECT 'package:app.r' || n_regionkey, 'type:' || {_CONTROLLER}, 'DECLARES' FROM {{nation}}
    UNION ALL SELECT 'type:' || {_CONTROLLER}, 'route:GET:/nations/' || n_nationkey, 'EXPOSES_ROUTE' FROM {{nation}}
    UNION ALL SELECT DISTINCT 'type:' || {_CONTROLLER}, 'bean:' || p_brand, 'INJECTS' FROM {{nation}} JOIN {{part}} ON p_brand = 'Brand#' || n_nationkey
  ) AS x GROUP BY source, target, kind"""

_PLAIN = {t: t for t in TABLES}
_WITH = f"WITH RECURSIVE n AS (SELECT 'bridge' AS project, * FROM ({_NODES.format(**_PLAIN)}) AS x), e AS (SELECT 'bridge' AS project, * FROM ({_EDGES.format(**_PLAIN)}) AS x) "


def graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the graph."""
    tables = {t: table(spark, folder, t) for t in TABLES}
    own = lambda text: {t: df for t, df in tables.items() if f"{{{t}}}" in text}
    nodes = spark.sql(_NODES, **own(_NODES)).select(F.lit("bridge").alias("project"), "*", F.lit(None).cast("string").alias("module_name"), F.col("package_name").alias("namespace_path"))
    return nodes, spark.sql(_EDGES, **own(_EDGES)).select(F.lit("bridge").alias("project"), "*")


def _query(sql: str, *integers: str):
    """Registers a query with its SQL, of which the named columns are 32-bit integers."""

    def register(f):
        casts = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in integers)
        QUERIES[f.__name__], SQL[f.__name__] = f, f"SELECT * REPLACE ({casts}) FROM ({_WITH + sql})" if casts else _WITH + sql
        return f

    return register


@_query("SELECT kind, count(*) AS n, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM e GROUP BY ALL UNION ALL SELECT kind, count(*), count(file_path) FROM n GROUP BY ALL")
def bridge_kinds(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges = graph(spark, folder)
    return edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("n_rows").alias("n_rows")).unionByName(nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("file_path").alias("n_rows")))


@_query(PACKAGES + "SELECT * FROM metrics")
def bridge_package_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return counts.package_metrics(*graph(spark, folder))


@_query(PACKAGES + "SELECT project, package, roles, nth FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY n_components DESC, n_internal DESC, n_routes DESC, package) AS nth FROM metrics) WHERE nth <= 12 AND (n_components > 0 OR n_internal > 0)", "nth")
def bridge_areas(spark: SparkSession, folder: str) -> DataFrame:
    return counts.application_areas(counts.package_metrics(*graph(spark, folder))).select("project", "package", "roles", "nth")


@_query("""SELECT 'bridge' AS project, 'controllers' AS role, count(DISTINCT source) AS n FROM e WHERE kind = 'EXPOSES_ROUTE' UNION ALL SELECT 'bridge', 'services', count(*) FROM n WHERE kind = 'BEAN' AND contains(lower(json_extract_string(metadata, '$.stereotype')), 'service')
    UNION ALL SELECT 'bridge', r, (SELECT count(*) FROM n WHERE n.kind = k) FROM (VALUES ('repositories', 'REPOSITORY'), ('entities', 'ENTITY'), ('routes', 'ROUTE'), ('beans', 'BEAN')) AS v(r, k)""")
def framework_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counts.framework_counts(*graph(spark, folder))


_ROLES = """, d AS (SELECT *, CASE kind WHEN 'ROUTE' THEN 'ROUTE' WHEN 'REPOSITORY' THEN 'REPOSITORY' WHEN 'ENTITY' THEN 'ENTITY' WHEN 'EVENT_TYPE' THEN 'EVENT' WHEN 'BEAN' THEN upper(coalesce(json_extract_string(metadata, '$.stereotype'), 'BEAN'))
      ELSE CASE WHEN json_extract_string(metadata, '$.annotations[0]') LIKE '%Controller' THEN 'CONTROLLER' WHEN json_extract_string(metadata, '$.annotations[0]') LIKE '%Service' THEN 'SERVICE' END END AS direct FROM n),
    w AS (SELECT d.*, coalesce(d.direct, o.direct) AS role FROM d LEFT JOIN d o ON o.stable_id = coalesce(json_extract_string(d.metadata, '$.declaring_type'),
      CASE WHEN d.kind = 'METHOD' AND contains(d.stable_id, '#') THEN 'type:' || regexp_extract(d.stable_id, '^[^:]*:([^#]*)#', 1) END)) """


@_query(_ROLES + "SELECT project, stable_id, direct, role FROM w")
def framework_roles(spark: SparkSession, folder: str) -> DataFrame:
    return symbols.framework_roles(graph(spark, folder)[0])


@_query(_ROLES + """, c AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN qualified_name = 'customer1' OR simple_name = 'customer1' THEN 0 ELSE 1 END, stable_id) AS i FROM w
      WHERE contains(lower(qualified_name), 'customer1') OR contains(lower(simple_name), 'customer1') OR contains(lower(stable_id), 'customer1')),
    r AS (SELECT *, CASE WHEN stable_id = 'customer1' THEN 900 WHEN lower(qualified_name) = 'customer1' THEN 700 WHEN lower(simple_name) = 'customer1' THEN 600
      WHEN starts_with(lower(qualified_name), 'customer1') OR starts_with(lower(simple_name), 'customer1') THEN 400 WHEN contains(lower(qualified_name), 'customer1') THEN 200 ELSE 0 END AS lexical FROM c WHERE i <= 1000),
    s AS (SELECT *, lexical + 80 + 30 + CASE WHEN direct IS NOT NULL THEN 20 ELSE 0 END AS rank FROM r WHERE lexical > 0 AND lower(kind) IN ('method', 'route') AND starts_with(package_name, 'app.r') AND lower(role) = 'controller'),
    p AS (SELECT *, row_number() OVER (ORDER BY rank DESC, lower(qualified_name), stable_id) AS nth, count(*) OVER () AS n_matched FROM s)
    SELECT project, stable_id, kind, role, rank, nth, n_matched FROM p WHERE nth > 5 AND nth <= 12""", "rank", "nth")
def search_page(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of a search among some kinds, within packages, for a role that the declaring type lends."""
    return symbols.search(graph(spark, folder)[0], "customer1", limit=7, offset=5, kinds=("Method", "route"), package_prefix="app.r", roles=("Controller",))


_HANDLERS = ", h AS (SELECT DISTINCT e.project, e.source AS route, e.target AS handler FROM e JOIN n r ON r.stable_id = e.source AND r.kind = 'ROUTE' JOIN n t ON t.stable_id = e.target WHERE e.kind = 'HANDLED_BY') "


@_query(_HANDLERS + "SELECT * FROM h")
def route_handlers(spark: SparkSession, folder: str) -> DataFrame:
    return endpoints.route_handlers(*graph(spark, folder))


@_query(_HANDLERS + "SELECT project, handler, count(*) AS n_routes, CASE WHEN count(*) = 1 THEN min(route) END AS route FROM h GROUP BY ALL")
def routes_of_handlers(spark: SparkSession, folder: str) -> DataFrame:
    return endpoints.routes_of_handlers(endpoints.route_handlers(*graph(spark, folder)))


@_query("""SELECT 'bridge' AS project, method, path, r.stable_id AS route FROM (SELECT ' get ' AS method, CASE n_nationkey % 3 WHEN 0 THEN ' nations/' || n_nationkey WHEN 1 THEN '/nations/' || n_nationkey || '//' ELSE 'nations//' || n_nationkey END AS path FROM nation) a
    LEFT JOIN n r ON r.kind = 'ROUTE' AND r.stable_id = 'route:GET:/' || trim(trim(path), '/')""")
def asked_routes(spark: SparkSession, folder: str) -> DataFrame:
    """Routes asked for by method and path, in spellings of which one isn't that of a route."""
    asked = table(spark, folder, "nation").selectExpr("'bridge' AS project", "' get ' AS method", "CASE n_nationkey % 3 WHEN 0 THEN ' nations/' || n_nationkey WHEN 1 THEN '/nations/' || n_nationkey || '//' ELSE 'nations//' || n_nationkey END AS path")
    return endpoints.asked_routes(asked, graph(spark, folder)[0])


_HIDDEN = """(t.file_path IS NULL OR (t.kind = 'METHOD' AND regexp_matches(t.simple_name, '^(get|set|is)')) OR t.simple_name IN ('toString', 'hashCode', 'equals', 'requireNonNull', 'debug', 'info', 'warn', 'error', 'trace'))"""
_FLOW = _HANDLERS + f""", f AS (SELECT e.source, e.target, e.kind, t.qualified_name AS name, {_HIDDEN} AS hidden FROM e JOIN n t ON t.stable_id = e.target),
    c AS (SELECT source, target, name FROM f WHERE kind = 'CALLS' AND NOT hidden),
    l0 AS (SELECT DISTINCT handler, handler AS node, handler AS key, qualified_name AS path FROM h JOIN n ON stable_id = handler),
    l1 AS (SELECT handler, target AS node, min(key || chr(1) || target) AS key, arg_min(path || ' > ' || name, key || chr(1) || target) AS path FROM l0 JOIN c ON source = node GROUP BY handler, target),
    l2 AS (SELECT handler, target AS node, min(key || chr(1) || target) AS key, arg_min(path || ' > ' || name, key || chr(1) || target) AS path FROM l1 JOIN c ON source = node
      WHERE NOT EXISTS (SELECT 1 FROM l1 s WHERE s.handler = l1.handler AND s.node = target) GROUP BY handler, target),
    l3 AS (SELECT handler, target AS node, min(key || chr(1) || target) AS key, arg_min(path || ' > ' || name, key || chr(1) || target) AS path FROM l2 JOIN c ON source = node
      WHERE NOT EXISTS (SELECT 1 FROM (SELECT handler, node FROM l1 UNION ALL SELECT handler, node FROM l2) s WHERE s.handler = l2.handler AND s.node = target) GROUP BY handler, target),
    x AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2),
    p AS (SELECT DISTINCT handler, path FROM (SELECT handler, path FROM x WHERE NOT EXISTS (SELECT 1 FROM c WHERE source = node) UNION ALL SELECT handler, path FROM l3)),
    y AS (SELECT DISTINCT handler, node FROM x),
    g AS (SELECT handler, CASE WHEN kind IN ('READS', 'READS_ENTITY') THEN 'reads' WHEN kind IN ('WRITES', 'WRITES_ENTITY') THEN 'writes' WHEN kind = 'PUBLISHES_EVENT' THEN 'events' END AS category, CASE WHEN kind = 'PUBLISHES_EVENT' THEN kind || ' ' || name ELSE name END AS item
        FROM y JOIN f ON source = node AND NOT hidden
      UNION SELECT handler, 'branch points', qualified_name FROM y JOIN n ON stable_id = node WHERE (SELECT count(*) FROM c WHERE source = node) > 1
      UNION SELECT handler, 'injections', o.qualified_name || ' > ' || f.name FROM y JOIN n m ON m.stable_id = node JOIN n o ON o.stable_id = coalesce(json_extract_string(m.metadata, '$.declaring_type'), 'type:' || regexp_extract(node, '^[^:]*:([^#]*)', 1))
        JOIN f ON f.source = o.stable_id AND f.kind = 'INJECTS'),
    facts AS (SELECT * FROM g WHERE category IS NOT NULL) """


def _flow(spark: SparkSession, folder: str) -> tuple[DataFrame, endpoints.Flow, DataFrame]:
    nodes, edges = graph(spark, folder)
    handlers = endpoints.route_handlers(nodes, edges)
    return handlers, endpoints.Flow(nodes, edges, handlers), nodes


@_query(_FLOW + "SELECT h.project, route, handler, path FROM h JOIN p USING (handler)")
def endpoint_flow(spark: SparkSession, folder: str) -> DataFrame:
    """The paths of calls of every endpoint, three deep."""
    handlers, flow, _ = _flow(spark, folder)
    return handlers.join(flow.paths(), ["project", "handler"]).select("project", "route", "handler", "path")


@_query(_FLOW + "SELECT DISTINCT h.project, route, category, item FROM h JOIN facts USING (handler)")
def endpoint_facts(spark: SparkSession, folder: str) -> DataFrame:
    """What every endpoint reads, writes, publishes and injects, and where its calls branch."""
    handlers, flow, _ = _flow(spark, folder)
    return handlers.join(flow.facts(), ["project", "handler"]).select("project", "route", "category", "item").distinct()


@_query(_FLOW + """, a AS (SELECT route, count(*) AS n_handlers, CAST(sum((SELECT count(*) FROM p WHERE p.handler = h.handler)) AS BIGINT) AS n_paths,
      CAST(sum((SELECT count(*) FROM x JOIN f ON f.source = x.node AND f.hidden AND f.kind <> 'INJECTS' WHERE x.handler = h.handler)) AS BIGINT) AS n_hidden FROM h GROUP BY route),
    b AS (SELECT route, category, count(DISTINCT item) AS k FROM h JOIN facts USING (handler) GROUP BY ALL), k AS (SELECT route, CAST(coalesce(sum(k) FILTER (category = 'reads'), 0) AS BIGINT) AS n_reads, CAST(coalesce(sum(k) FILTER (category = 'writes'), 0) AS BIGINT) AS n_writes,
      CAST(coalesce(sum(k) FILTER (category = 'events'), 0) AS BIGINT) AS n_events, CAST(coalesce(sum(k) FILTER (category = 'injections'), 0) AS BIGINT) AS n_injections FROM b GROUP BY ALL)
    SELECT 'bridge' AS project, a.route, n_handlers, n_paths, n_hidden, coalesce(n_reads, 0) AS n_reads, coalesce(n_writes, 0) AS n_writes, coalesce(n_events, 0) AS n_events, coalesce(n_injections, 0) AS n_injections,
      CASE WHEN n.confidence = 'AMBIGUOUS' OR n_handlers > 1 THEN 'ambiguous' ELSE 'complete' END AS completeness FROM a LEFT JOIN k USING (route) JOIN n ON n.stable_id = a.route""")
def endpoint_summary(spark: SparkSession, folder: str) -> DataFrame:
    return endpoints.endpoint_summary(*_flow(spark, folder))


_STEPS = f""", s AS (SELECT DISTINCT target AS stable_id FROM e WHERE kind = 'HANDLED_BY'), q AS (SELECT source, target, e.kind, t.file_path IS NULL AS hidden, t.kind IN ('METHOD', 'EVENT_TYPE', 'ENTITY') AS wanted FROM e JOIN n t ON t.stable_id = e.target
      WHERE e.kind IN ('CALLS', 'CONSTRUCTS', 'PUBLISHES_EVENT', 'LISTENS_TO_EVENT', 'USES_REPOSITORY')),
    o AS (SELECT * FROM q WHERE NOT hidden AND wanted) """


def _hops(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    kinds = traverse.edge_kinds(["calls", "events"], ["USES_REPOSITORY"])
    ends = nodes.select("project", F.col("stable_id").alias("next"), F.col("file_path").isNull().alias("hidden"), F.col("kind").isin("METHOD", "EVENT_TYPE", "ENTITY").alias("wanted"))
    return traverse.steps(edges, kinds).join(ends, ["project", "next"])


@_query(_STEPS + """, p AS (SELECT stable_id AS start, stable_id AS node, 0 AS depth, [stable_id] AS path, CAST([] AS VARCHAR[]) AS kinds FROM s
      UNION ALL SELECT start, target, depth + 1, list_append(path, target), list_append(kinds, kind) FROM p JOIN o ON source = node WHERE depth < 3 AND NOT list_contains(path, target))
    SELECT DISTINCT 'bridge' AS project, start, depth, array_to_string(path, ' > ') AS path, array_to_string(kinds, ' > ') AS kinds FROM p
    WHERE depth = 3 OR NOT EXISTS (SELECT 1 FROM o WHERE o.source = p.node AND NOT list_contains(p.path, o.target))""", "depth")
def trace_edge_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """The bounded paths from every handler with the kinds of their edges, hidden and unwanted neighbours left out."""
    nodes, edges = graph(spark, folder)
    starts = edges.where("kind = 'HANDLED_BY'").select("project", F.col("target").alias("stable_id")).distinct()
    paths, _ = traverse.traces(starts, _hops(nodes, edges), 3)
    return paths.select("project", "start", "depth", F.array_join("path", " > ").alias("path"), F.array_join("kinds", " > ").alias("kinds"))


@_query(_STEPS + """, p AS (SELECT stable_id AS start, stable_id AS node, 0 AS depth, [stable_id] AS path FROM s UNION ALL SELECT start, target, depth + 1, list_append(path, target) FROM p JOIN o ON source = node WHERE depth < 3 AND NOT list_contains(path, target)),
    k AS (SELECT start, count(*) FILTER (NOT hidden AND wanted AND list_contains(path, target)) AS n_cycles, count(*) FILTER (hidden) AS n_hidden FROM p JOIN q ON source = node WHERE depth < 3 GROUP BY ALL),
    v AS (SELECT start, count(DISTINCT node) AS n_visited FROM p GROUP BY ALL) SELECT 'bridge' AS project, start, coalesce(n_cycles, 0) AS n_cycles, coalesce(n_hidden, 0) AS n_hidden, n_visited FROM v LEFT JOIN k USING (start)""")
def trace_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How often the paths of a handler lead back into themselves or to hidden neighbours, and how many nodes they visit."""
    nodes, edges = graph(spark, folder)
    starts = edges.where("kind = 'HANDLED_BY'").select("project", F.col("target").alias("stable_id")).distinct()
    return traverse.traces(starts, _hops(nodes, edges), 3)[1]


@_query(_STEPS + """, l0 AS (SELECT stable_id AS start, stable_id AS node, '' AS key, stable_id AS path FROM s),
    l1 AS (SELECT start, target AS node, min(kind || chr(1) || target) AS key, arg_min(path || ' > ' || target, kind || chr(1) || target) AS path, FROM l0 JOIN o ON source = node WHERE target <> start GROUP BY start, target),
    l2 AS (SELECT start, target AS node, min(key || chr(1) || kind || chr(1) || target) AS key, arg_min(path || ' > ' || target, key || chr(1) || kind || chr(1) || target) AS path FROM l1 JOIN o ON source = node
      WHERE target <> start AND NOT EXISTS (SELECT 1 FROM l1 z WHERE z.start = l1.start AND z.node = target) GROUP BY start, target),
    r AS (SELECT 0 AS depth, start, path FROM l0 WHERE NOT EXISTS (SELECT 1 FROM l1 WHERE l1.start = l0.start) UNION ALL SELECT 1, start, path FROM l1 WHERE NOT EXISTS (SELECT 1 FROM l2 WHERE l2.start = l1.start AND starts_with(l2.path, l1.path || ' > ')) UNION ALL SELECT 2, start, path FROM l2)
    SELECT 'bridge' AS project, start, depth, path FROM r""", "depth")
def trace_shortest_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The first shortest path from every handler to each node within two edges, as far as it isn't continued."""
    nodes, edges = graph(spark, folder)
    starts = edges.where("kind = 'HANDLED_BY'").select("project", F.col("target").alias("stable_id")).distinct()
    paths, _ = traverse.traces(starts, _hops(nodes, edges), 2, shortest=True)
    return paths.select("project", "start", "depth", F.array_join("path", " > ").alias("path"))
