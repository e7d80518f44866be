"""Queries over annotated types whose descriptor rows are derived from the given tables, one row or more for each of theirs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symweave.operators import beans
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


#: Customers are types with two annotations each, suppliers are annotations: each leads to another one, some to a stereotype before or after that.
_ANNOTATED = (
    "SELECT c_mktsegment AS project, 'T' || c_custkey AS type, 0 AS nth, 'A' || (c_custkey % 50 + 1) AS annotation FROM customer",
    "SELECT c_mktsegment AS project, 'T' || c_custkey AS type, 1 AS nth, 'A' || (c_custkey % 30 + 1) AS annotation FROM customer",
    "SELECT c_mktsegment AS project, 'A' || s_suppkey AS type, 1 AS nth, 'A' || s_suppkey * 2 AS annotation FROM supplier CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) AS m",
    "SELECT c_mktsegment AS project, 'A' || s_suppkey AS type, CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 2 END AS nth, CASE s_suppkey % 6 WHEN 0 THEN 'org.springframework.stereotype.Service' WHEN 3 THEN 'org.springframework.stereotype.Component' WHEN 4 THEN 'A2' ELSE 'other.Note' END AS annotation FROM supplier CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) AS m",
)
_STEREOTYPES = f"""WITH RECURSIVE a AS ({' UNION ALL '.join(_ANNOTATED)}), p AS (SELECT project, type, annotation AS node, [nth] AS place, [annotation] AS chain FROM a
      UNION ALL SELECT p.project, p.type, a.annotation, list_append(place, nth), list_append(chain, annotation) FROM p JOIN a ON a.project = p.project AND a.type = p.node WHERE NOT list_contains(chain, annotation)),
    s AS (SELECT project, type, arg_min(chain, place) AS chain, array_to_string(arg_min(chain, place), ' > ') AS path, split_part(list_last(arg_min(chain, place)), '.', -1) AS stereotype FROM p WHERE node LIKE 'org.springframework.stereotype.%' GROUP BY ALL) """


def _stereotypes(spark: SparkSession, folder: str) -> DataFrame:
    customers, suppliers = table(spark, folder, "customer"), table(spark, folder, "supplier")
    # The five segments stand for projects; each has all annotations.
    shared = suppliers.withColumn("c_mktsegment", F.explode(F.array(*(F.lit(s) for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")))))
    rows = customers.selectExpr("c_mktsegment AS project", "'T' || c_custkey AS type", "0 AS nth", "'A' || (c_custkey % 50 + 1) AS annotation")
    rows = rows.unionByName(customers.selectExpr("c_mktsegment AS project", "'T' || c_custkey AS type", "1 AS nth", "'A' || (c_custkey % 30 + 1) AS annotation"))
    rows = rows.unionByName(shared.selectExpr("c_mktsegment AS project", "'A' || s_suppkey AS type", "1 AS nth", "'A' || s_suppkey * 2 AS annotation"))
    rows = rows.unionByName(shared.selectExpr(
        "c_mktsegment AS project", "'A' || s_suppkey AS type", "CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 2 END AS nth",
        "CASE s_suppkey % 6 WHEN 0 THEN 'org.springframework.stereotype.Service' WHEN 3 THEN 'org.springframework.stereotype.Component' WHEN 4 THEN 'A2' ELSE 'other.Note' END AS annotation",
    ))
    return beans.stereotypes(rows)


@_query(_STEREOTYPES + "SELECT project, type, stereotype, path FROM s")
def bean_stereotypes(spark: SparkSession, folder: str) -> DataFrame:
    """The stereotypes of customers' types through chains of annotations."""
    return _stereotypes(spark, folder).select("project", "type", "stereotype", F.array_join("chain", " > ").alias("path"))


_SCANNED = _STEREOTYPES + """, t AS (SELECT c_mktsegment AS project, 'T' || c_custkey AS type, 'app.r' || n_regionkey || '.n' || n_nationkey AS package_name, CASE WHEN c_custkey % 4 = 0 THEN 'URLThing' ELSE 'Thing' END || c_custkey AS simple_name,
      CASE c_custkey % 10 WHEN 0 THEN 'named' || c_custkey WHEN 1 THEN ' ' END AS explicit_name, c_custkey % 7 = 0 AS conditional, c_mktsegment = 'BUILDING' AND c_custkey % 50 = 0 AS is_application FROM customer JOIN nation ON n_nationkey = c_nationkey),
    r AS (SELECT project, package_name AS root FROM t WHERE is_application UNION SELECT 'MACHINERY', 'app.r' || r_regionkey FROM region WHERE r_regionkey < 2 UNION SELECT 'AUTOMOBILE', 'app.r' || n_regionkey || '.n' || n_nationkey FROM nation WHERE n_nationkey % 3 = 0),
    b AS (SELECT t.project, t.type, CASE WHEN trim(explicit_name) <> '' THEN explicit_name WHEN regexp_matches(simple_name, '^[A-Z]{2}') THEN simple_name ELSE lower(simple_name[1]) || simple_name[2:] END AS bean, stereotype,
      CASE WHEN conditional OR NOT EXISTS (SELECT 1 FROM r WHERE r.project = t.project) THEN 'STATIC_INFERRED' ELSE 'FRAMEWORK_RESOLVED' END AS confidence, EXISTS (SELECT 1 FROM r WHERE r.project = t.project) AS scan_known FROM t JOIN s USING (project, type)
      WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.project = t.project) OR EXISTS (SELECT 1 FROM r WHERE r.project = t.project AND (package_name = root OR starts_with(package_name, root || '.')))) """


@_query(_SCANNED + "SELECT * FROM b")
def scanned_beans(spark: SparkSession, folder: str) -> DataFrame:
    """The beans among customers' types, in segments that scan packages, nations or everything."""
    nations = table(spark, folder, "nation")
    types = table(spark, folder, "customer").join(nations, F.col("n_nationkey") == F.col("c_nationkey")).selectExpr(
        "c_mktsegment AS project", "'T' || c_custkey AS type", "'app.r' || n_regionkey || '.n' || n_nationkey AS package_name", "CASE WHEN c_custkey % 4 = 0 THEN 'URLThing' ELSE 'Thing' END || c_custkey AS simple_name",
        "CASE c_custkey % 10 WHEN 0 THEN 'named' || c_custkey WHEN 1 THEN ' ' END AS explicit_name", "c_custkey % 7 = 0 AS conditional", "c_mktsegment = 'BUILDING' AND c_custkey % 50 = 0 AS is_application",
    )
    scans = table(spark, folder, "region").where("r_regionkey < 2").selectExpr("'MACHINERY' AS project", "array('app.r' || r_regionkey, ' ') AS packages", "CAST(NULL AS ARRAY<STRING>) AS classes")
    scans = scans.unionByName(nations.where("n_nationkey % 3 = 0").selectExpr("'AUTOMOBILE' AS project", "CAST(array() AS ARRAY<STRING>) AS packages", "array('app.r' || n_regionkey || '.n' || n_nationkey || '.Marker', 'NoPackage') AS classes"))
    return beans.scanned_beans(types, _stereotypes(spark, folder), beans.scan_roots(types, scans))


@_query(_SCANNED + "SELECT project, count(*) AS n_beans FROM b WHERE NOT scan_known GROUP BY ALL")
def unknown_scans(spark: SparkSession, folder: str) -> DataFrame:
    return beans.unknown_scans(scanned_beans(spark, folder))


@_query("""SELECT 'p' AS project, 'make' || p_partkey AS method_id, CASE p_partkey % 3 WHEN 0 THEN 'part' || p_partkey ELSE 'n' || p_partkey END AS bean, CASE WHEN p_partkey % 3 = 2 THEN 'x,y' ELSE '' END AS aliases,
    array_to_string(list_sort(list_distinct(list_prepend('type' || p_size, (SELECT coalesce(list('super' || s_nationkey), []) FROM supplier WHERE s_suppkey % 50 = p_size)))), ',') AS assignable, CASE WHEN p_size % 2 = 0 THEN 'STATIC_INFERRED' ELSE 'FRAMEWORK_RESOLVED' END AS confidence FROM part""")
def factory_beans(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as factory methods; their types are those of their size, above which are the nations of suppliers."""
    parts = table(spark, folder, "part")
    methods = parts.selectExpr("'p' AS project", "'make' || p_partkey AS method_id", "'part' || p_partkey AS method", "CASE p_partkey % 3 WHEN 1 THEN array('n' || p_partkey) WHEN 2 THEN array('n' || p_partkey, 'x', 'y', 'x') END AS names", "'type' || p_size AS return_type", "p_size % 2 = 0 AS conditional")
    above = table(spark, folder, "supplier").selectExpr("'p' AS project", "'type' || s_suppkey % 50 AS type", "'super' || s_nationkey AS super")
    return beans.factory_beans(methods, above).withColumns({"aliases": F.array_join("aliases", ","), "assignable": F.array_join("assignable", ",")})


@_query("""WITH c AS (SELECT 'p' AS project, 'T' || o_custkey AS type, 'c' || o_orderkey AS constructor, o_orderpriority = '1-URGENT' AS marked FROM orders), n AS (SELECT type, count(*) AS n, count(*) FILTER (marked) AS m FROM c GROUP BY ALL)
    SELECT project, type, constructor FROM c JOIN n USING (type) WHERE marked OR (m = 0 AND n = 1)""")
def injected_constructors(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as constructors of their customers' types, the urgent ones marked."""
    return beans.injected_constructors(table(spark, folder, "orders").selectExpr("'p' AS project", "'T' || o_custkey AS type", "'c' || o_orderkey AS constructor", "o_orderpriority = '1-URGENT' AS autowired"))


_INJECTED = """WITH p AS (SELECT 'S' || c_custkey % 200 AS consumer, 'c' || c_custkey AS point, 'b' || c_custkey % 40 AS parameter, c_nationkey AS required, CASE WHEN c_custkey % 11 = 0 THEN 'q' || c_custkey % 22 END AS qualifier FROM customer),
    b AS (SELECT 'b' || s_suppkey AS bean, 'S' || s_suppkey AS type, unnest([s_nationkey, (s_nationkey + 1) % 50]) AS required, 'q' || s_suppkey % 22 AS q, s_suppkey % 9 = 0 AS is_primary, s_suppkey % 4 = 0 AS conditional FROM supplier),
    m AS (SELECT * FROM p JOIN b USING (required) WHERE {0}),
    g AS (SELECT consumer, point, parameter, qualifier, count(*) AS n, count(*) FILTER (is_primary) AS np, min(bean) FILTER (q = qualifier OR bean = qualifier) AS bq, min(bean) AS b1, min(bean) FILTER (is_primary) AS bp, min(bean) FILTER (bean = parameter AND {1}) AS bn FROM m GROUP BY ALL),
    s AS (SELECT *, CASE WHEN qualifier IS NOT NULL THEN bq WHEN n = 1 THEN b1 WHEN np = 1 THEN bp WHEN np = 0 THEN bn END AS bean, CASE WHEN qualifier IS NOT NULL THEN 'QUALIFIER' WHEN {1} IS FALSE THEN 'FACTORY_PARAMETER' WHEN n = 1 THEN 'UNIQUE_CANDIDATE' WHEN np = 1 THEN 'PRIMARY' ELSE 'INJECTION_POINT_NAME' END AS reason FROM g),
    k AS (SELECT s.*, CASE WHEN s_suppkey % 4 = 0 AND {1} THEN 'STATIC_INFERRED' ELSE 'FRAMEWORK_RESOLVED' END AS confidence FROM s JOIN supplier ON bean = 'b' || s_suppkey)
    SELECT DISTINCT 'p' AS project, point AS source, m.bean AS target, 'BEAN_CANDIDATE' AS kind, CASE WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'FRAMEWORK_RESOLVED' END AS confidence, CAST(NULL AS VARCHAR) AS reason FROM m JOIN g USING (point)
    UNION ALL SELECT 'p', point, bean, 'SELECTED_BEAN', confidence, reason FROM k UNION ALL SELECT DISTINCT 'p', consumer, bean, 'INJECTS', confidence, NULL FROM k WHERE {2}"""


def _injections(spark: SparkSession, folder: str, consumer: str, factories: bool) -> DataFrame:
    points = table(spark, folder, "customer").selectExpr("'p' AS project", f"'{consumer}' || c_custkey % 200 AS consumer", "'c' || c_custkey AS point", "'b' || c_custkey % 40 AS parameter", "c_nationkey AS required", "CASE WHEN c_custkey % 11 = 0 THEN 'q' || c_custkey % 22 END AS qualifier")
    given = table(spark, folder, "supplier").selectExpr("'p' AS project", "'b' || s_suppkey AS bean", "'S' || s_suppkey AS type", "array(s_nationkey, (s_nationkey + 1) % 50) AS assignable", "array('q' || s_suppkey % 22) AS qualifiers", "s_suppkey % 9 = 0 AS is_primary", "s_suppkey % 4 = 0 AS conditional")
    return beans.injections(points, given, factories)


@_query(_INJECTED.format("true", "true", "EXISTS (SELECT 1 FROM b WHERE b.type = consumer)"))
def injections(spark: SparkSession, folder: str) -> DataFrame:
    """The edges of customers' parameters to the suppliers of their nation."""
    return _injections(spark, folder, "S", False)


@_query(_INJECTED.replace("'S' || c_custkey", "'b' || c_custkey").format("bean <> consumer", "false", "true"))
def factory_injections(spark: SparkSession, folder: str) -> DataFrame:
    """The same for parameters of factories, which are suppliers' beans themselves."""
    return _injections(spark, folder, "b", True)


#: Annotations of a parameter (annotation, name, value, required), whether it is optional, and what they mean.
_BOUND = (
    ([("RequestBody", None, None, None), ("Valid", " ", None, None)], False, ("REQUEST_BODY", "p", True)), ([("PathVariable", "id", "x", None), ("Size", None, None, False)], False, ("PATH_VARIABLE", "id", False)),
    ([], True, ("JAVA", "p", False)), ([("RequestParam", None, "q", False), ("RequestHeader", None, "h", True)], True, ("REQUEST_HEADER", "h", True)), (None, None, ("JAVA", "p", True)), ([("ModelAttribute", "", "", None)], True, ("MODEL_ATTRIBUTE", "p", False)),
)


@_query("SELECT o_orderkey, kind AS binding_kind, CASE WHEN name = 'p' THEN 'p' || o_custkey ELSE name END AS external_name, required FROM orders JOIN (VALUES " + ", ".join(f"({i}, '{k}', '{n}', {r})" for i, (_, _, (k, n, r)) in enumerate(_BOUND)) + f") v(i, kind, name, required) ON i = o_orderkey % {len(_BOUND)}")
def parameter_bindings(spark: SparkSession, folder: str) -> DataFrame:
    """How orders as parameters are bound."""
    text = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'"
    struct = "array<struct<annotation: string, name: string, value: string, required: boolean>>"
    given = [f"CAST({'NULL' if a is None else 'array(' + ', '.join('struct(' + ', '.join(map(text, x)) + ')' for x in a) + ')'} AS {struct})" for a, _, _ in _BOUND]
    pick = lambda values: f"element_at(array({', '.join(values)}), CAST(o_orderkey % {len(_BOUND)} + 1 AS INT))"
    rows = table(spark, folder, "orders").selectExpr("o_orderkey", "'p' || o_custkey AS name", f"{pick([text(o) for _, o, _ in _BOUND])} AS optional", f"{pick(given)} AS annotations")
    return beans.bindings(rows, ["o_orderkey"])


@_query("""SELECT p_brand AS project, 'D' || p_size AS type, count(*) AS n_components, string_agg('f' || p_partkey, ',' ORDER BY 'f' || p_partkey) AS components FROM part WHERE p_partkey % 3 > 0 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey % 50 = p_size AND 'Brand#' || o_custkey % 60 = p_brand) GROUP BY ALL""", "n_components")
def validated_components(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as fields of types by size, two of three with a constraint, held by orders as parameters."""
    fields = table(spark, folder, "part").selectExpr("p_brand AS project", "'D' || p_size AS type", "'f' || p_partkey AS field", "p_type AS java_type", "CASE p_partkey % 3 WHEN 0 THEN array() ELSE array('NotNull') END AS validation")
    parameters = table(spark, folder, "orders").selectExpr("'Brand#' || o_custkey % 60 AS project", "'D' || o_custkey % 50 AS type")
    found = beans.validated_components(parameters, fields)
    return found.select("project", "type", F.size("components").alias("n_components"), F.array_join("components.field", ",").alias("components"))


@_query("""SELECT p_brand AS project, 'R' || p_partkey AS type, 'E' || p_partkey * 2 AS domain, CASE p_partkey % 4 WHEN 1 THEN 'Long' ELSE 'String' END AS id_type, CASE p_partkey % 4 WHEN 1 THEN 'org.springframework.data.repository.CrudRepository' ELSE 'org.springframework.data.jpa.repository.JpaRepository' END AS contract,
    EXISTS (SELECT 1 FROM part e WHERE e.p_brand = part.p_brand AND e.p_partkey = part.p_partkey * 2) AS known FROM part WHERE p_partkey % 4 IN (1, 2)""")
def declared_repositories(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as types with two interfaces, of which some are repositories; the domains are other parts."""
    parts = table(spark, folder, "part")
    rows = parts.selectExpr("p_partkey", "p_brand AS project", "'R' || p_partkey AS type", "1 AS nth", "CASE p_partkey % 4 WHEN 1 THEN 'org.springframework.data.repository.CrudRepository' WHEN 2 THEN 'other.Base' ELSE 'org.springframework.data.repository.Repository' END AS interface", "CASE p_partkey % 4 WHEN 0 THEN array('E') ELSE array('E' || p_partkey * 2, 'Long') END AS arguments")
    rows = rows.where("p_partkey % 4 < 3").drop("p_partkey")
    rows = rows.unionByName(parts.where("p_partkey % 4 < 3 AND p_partkey % 4 > 0").selectExpr("p_brand AS project", "'R' || p_partkey AS type", "2 AS nth", "'org.springframework.data.jpa.repository.JpaRepository' AS interface", "array('E' || p_partkey * 2, 'String', 'x') AS arguments"))
    return beans.repositories(rows, parts.selectExpr("p_brand AS project", "'E' || p_partkey AS entity"))


_TARGETS = """WITH t AS (SELECT DISTINCT repo AS project, doc_id AS nth, CASE doc_id % 3 WHEN 0 THEN file_path WHEN 1 THEN regexp_replace(file_path, '/[^/]*$', '') || '/main.rs' ELSE 'build.rs' END AS source, CASE doc_id % 4 WHEN 0 THEN 'bin' WHEN 1 THEN 'lib' WHEN 2 THEN 'test' ELSE 'proc-macro' END AS kind FROM documents WHERE file_path LIKE '%/%' AND doc_id % 5 < 2),
    f AS (SELECT DISTINCT repo AS project, file_path AS path FROM documents WHERE file_path IS NOT NULL) """


@_query(_TARGETS + """, d AS (SELECT *, CASE WHEN contains(source, '/') THEN regexp_replace(source, '/[^/]*$', '') ELSE '' END AS dir FROM t WHERE kind <> 'test'),
    j AS (SELECT f.*, source, kind, path = source AS e, CASE WHEN path = source OR dir = '' THEN 0 ELSE len(string_split(dir, '/')) END AS depth, path <> source AND kind IN ('lib', 'proc-macro') AS lib, CASE WHEN path = source THEN -nth ELSE nth END AS o FROM f JOIN d ON f.project = d.project AND (path = source OR dir = '' OR starts_with(path, dir || '/')))
    SELECT project, path, source, kind FROM j QUALIFY row_number() OVER (PARTITION BY project, path ORDER BY e DESC, depth DESC, lib DESC, o DESC) = 1""")
def owning_targets(spark: SparkSession, folder: str) -> DataFrame:
    """The build target of every file, where some files stand for targets; tests are out."""
    docs = table(spark, folder, "documents").where("file_path IS NOT NULL")
    targets = docs.where("file_path LIKE '%/%' AND doc_id % 5 < 2").selectExpr(
        "repo AS project", "doc_id AS nth", "CASE doc_id % 3 WHEN 0 THEN file_path WHEN 1 THEN regexp_replace(file_path, '/[^/]*$', '') || '/main.rs' ELSE 'build.rs' END AS source", "CASE doc_id % 4 WHEN 0 THEN 'bin' WHEN 1 THEN 'lib' WHEN 2 THEN 'test' ELSE 'proc-macro' END AS kind"
    )
    return beans.owning_targets(docs.selectExpr("repo AS project", "file_path AS path"), targets, tests=False)


@_query("SELECT 'p' AS project, 'route:' || o_orderkey AS stable_id, 'T' || o_custkey AS java_type FROM orders WHERE o_orderkey % 4 = 1")
def request_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """The bodies of orders as routes, whose parameters are given as JSON."""
    metadata = """CASE o_orderkey % 4 WHEN 0 THEN '{"handler_parameters":[{"binding_kind":"JAVA","java_type":"int"}]}' WHEN 1 THEN '{"handler_parameters":[{"binding_kind":"JAVA","java_type":"int"},{"binding_kind":"REQUEST_BODY","java_type":"T' || o_custkey || '","x":[1]},{"binding_kind":"REQUEST_BODY","java_type":"U"}]}'
        WHEN 2 THEN '{"handler_parameters":7}' END AS metadata"""
    return beans.request_bodies(table(spark, folder, "orders").selectExpr("'p' AS project", "'route:' || o_orderkey AS stable_id", metadata))
