from collections import Counter

from pyspark.sql import functions as F

from symweave.operators import derive, sessions, symbols
from symweave.plans import packs


def test_routes(spark):
    types = spark.createDataFrame([("T", ["/api/", "v2"]), ("U", None)], "type_id string, prefixes array<string>")
    methods = spark.createDataFrame([("T", "m1", ["/x//y/"], ["get", "POST"]), ("U", "m2", [], ["GET"]), ("U", "m3", None, ["GET"]), ("T", "m4", ["z"], [])], "type_id string, method_id string, suffixes array<string>, verbs array<string>")
    routes = derive.composed_routes(types, methods)
    assert {tuple(r) for r in routes.collect()} == {("m1", v, p) for v in ("GET", "POST") for p in ("/api/x/y", "/v2/x/y")} | {("m2", "GET", "/"), ("m3", "GET", "/")}
    assert [tuple(r) for r in derive.duplicate_routes(routes).collect()] == [("GET", "/", 2, "m2")]
    assert [r.method_id for r in derive.routes_without_verb(methods).collect()] == ["m4"]


def test_candidates(spark):
    beans = spark.createDataFrame([("a", ["I", "A"], ["fast"], True), ("b", ["I", "B"], [], False), ("c", ["J"], None, True), ("d", ["J"], None, True), ("k", ["K"], ["both"], None), ("l", ["K"], ["both"], None)], "bean string, assignable array<string>, qualifiers array<string>, is_primary boolean")
    points = spark.createDataFrame([(1, "A", None, "x"), (2, "I", None, "b"), (3, "I", "fast", "x"), (4, "I", "slow", "x"), (5, "J", None, "c"), (6, "K", None, "l"), (7, "K", None, "x"), (8, "N", None, "x"), (9, "I", "b", "x"), (10, "K", "both", "x")], "point_id int, required string, qualifier string, name string")
    got = {r.point_id: (r.n_candidates, r.selected, r.reason) for r in derive.selected_candidates(points, beans).collect()}
    assert got == {
        1: (1, "a", "only candidate"), 2: (2, "a", "primary"), 3: (2, "a", "qualifier"), 4: (2, None, "unresolved qualifier"), 5: (2, None, "several primaries"), 6: (2, "l", "name"), 7: (2, None, "ambiguous"), 8: (0, None, "none"), 9: (2, "b", "qualifier"), 10: (2, "k", "qualifier"),
    }


def most_rows(plan) -> int:
    """The most rows that an operator of an executed plan gave."""
    rows = plan.metrics().get("numOutputRows")
    kind = plan.getClass().getSimpleName()
    below = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    return max([rows.get().value() if rows.isDefined() else 0, *map(most_rows, below)])


def test_candidates_are_not_paired(spark):
    beans = spark.range(500).selectExpr("'b' || id AS bean", "array('I') AS assignable", "array('q' || id % 10) AS qualifiers", "false AS is_primary")
    points = spark.range(500).selectExpr("id AS point_id", "'I' AS required", "CASE WHEN id % 2 = 0 THEN 'q' || id % 10 END AS qualifier", "'b' || id * 2 AS name")
    found = derive.selected_candidates(points, beans)
    assert Counter((r.n_candidates, r.reason, r.selected is None) for r in found.collect()) == {(500, "qualifier", False): 250, (500, "name", False): 125, (500, "ambiguous", True): 125}
    assert most_rows(found._jdf.queryExecution().executedPlan()) < 10_000


def test_repeated_candidates_count_once(spark):
    beans = spark.createDataFrame([("a", ["I", "I"], None, True), ("a", ["I"], None, True), (None, ["I"], ["q"], True)], "bean string, assignable array<string>, qualifiers array<string>, is_primary boolean")
    points = spark.createDataFrame([(1, "I", None, "x"), (1, "I", None, "x"), (2, "I", "q", "x"), (3, None, None, None)], "point_id int, required string, qualifier string, name string")
    assert sorted(tuple(r) for r in derive.selected_candidates(points, beans).collect()) == [(1, 1, "a", "only candidate"), (2, 1, None, "unresolved qualifier"), (3, 0, None, "none")]


def test_queries_types_and_conditions(spark):
    named = [(m, None, None) for m in ("findByNameAndAgeGreaterThanOrderByAgeDesc", "findTop3ByName", "countByWrong", "save", "findAll", "existsByNameOr", "getByOrderByName", "readByAndName", "deleteByAnd")]
    methods = spark.createDataFrame([("R", *m) for m in [*named, ("find", "select x", True), ("byWhat", "", None)]] + [("S", "findByName", None, None), ("R", None, None, None)], "repository string, method string, query string, modifying boolean")
    fields = spark.createDataFrame([("R", ["name", "age"], 1)], "repository string, fields array<string>, method int")
    got = {(r.repository, r.method): (r.kind, r.operation, r.predicates and [tuple(p) for p in r.predicates], r.order_field, r.direction, r.unparsed) for r in derive.parsed_queries(methods, fields).collect()}
    bad, none = (None, None, None, None, None, True), (None, None, None, None, None, False)
    assert got == {
        ("R", "findByNameAndAgeGreaterThanOrderByAgeDesc"): ("derived", "FIND", [("name", "EQUALS"), ("age", "GREATER_THAN")], "age", "DESC", False), ("R", "findTop3ByName"): bad, ("R", "countByWrong"): bad, ("R", "save"): none, ("R", "findAll"): none,
        ("R", "existsByNameOr"): ("derived", "EXISTS", [("name", "EQUALS")], None, None, False), ("R", "getByOrderByName"): bad, ("R", "readByAndName"): bad, ("R", "deleteByAnd"): ("derived", "DELETE", [], None, None, False),
        ("R", "find"): ("explicit", "WRITE", None, None, None, False), ("R", "byWhat"): ("explicit", "READ", None, None, None, False), ("S", "findByName"): bad, ("R", None): (None, None, None, None, None, None),
    }
    uses = spark.createDataFrame([("f", "p.q", t) for t in ("List< Map<String,X> >[]", "int", "a.B", "Local", "String...")], "file_path string, package_name string, type_text string")
    imports = spark.createDataFrame([("f", "List", "java.util.List"), ("f", "String", "java.lang.String")], "file_path string, simple_name string, qualified_name string")
    assert [r.qualified for r in derive.qualified_types(uses, imports).orderBy("type_text").collect()] == ["java.util.List[]", "p.q.Local", "java.lang.String[]", "a.B", "int"]
    states = spark.createDataFrame([("a", "active"), ("b", "active"), ("b", "unknown"), ("c", "unknown"), ("c", "inactive"), ("d", None)], "k string, state string")
    assert {r.k: r.state for r in derive.joint_condition(states, ["k"]).collect()} == {"a": "active", "b": "unknown", "c": "inactive", "d": "unknown"}
    first = derive.first_emissions(spark.createDataFrame([("k", 2, "x"), ("k", 1, "z"), ("k", 1, "y")], "k string, o int, v string"), ["k"], ["o"])
    assert [r.v for r in first.collect()] == ["y"]


def test_sessions(spark):
    key = ["event", "stable_id", "symbol_text"]
    expected = spark.createDataFrame([("q1", "c", "node", "a", None), ("q1", "c", "node", "b", None), ("q2", "c", "diagnostic", None, "s")], "question_id string, category string, event string, stable_id string, symbol_text string")
    actual = spark.createDataFrame([("node", "a", None), ("node", "a", None), ("diagnostic", None, "s")], "event string, stable_id string, symbol_text string")
    assert {tuple(r) for r in sessions.matched_questions(expected, actual, key).collect()} == {("q1", "c", 1, 2, False), ("q2", "c", 1, 1, True)}
    place = "question_id string, file_path string, start_line int, end_line int"
    given = spark.createDataFrame([("a", "f", 1, 5), ("b", "f", 9, 9), ("c", "f", 5, 1), ("d", "f", 1, 1), ("d", None, 1, 1)], place)
    wanted = spark.createDataFrame([("a", "f", 5, 9), ("b", "f", 1, 8), ("e", "f", 1, 1)], place)
    assert {r.question_id: r.verified for r in sessions.verified_evidence(given, wanted).collect()} == {"a": True, "b": False, "c": False, "d": False, "e": False}
    runs = spark.createDataFrame([("x", "1", "all fine", ["a", "B"], None), ("x", "2", "it is Wrong", ["a"], True), ("x", "3", None, None, False)], "mode string, question_id string, answer string, claims array<string>, uncertainty_reported boolean")
    truth = spark.createDataFrame([("1", ["a"], ["b"], False), ("2", ["a"], ["wrong"], True), ("3", [], ["z"], False)], "question_id string, required array<string>, forbidden array<string>, needs_uncertainty boolean")
    assert {tuple(r) for r in sessions.scored_runs(runs, truth).collect()} == {("x", "1", False, 1), ("x", "2", False, 1), ("x", "3", True, 0)}


def test_flattened(spark):
    rows = spark.createDataFrame([(1, '{"a":{"b":[1,"x",{"c":null}]},"d":[]}', 0), (2, "no json", 0), (3, None, 0), (4, "true", 0), (5, '{"a":1,"a":2}', 0), (6, "{}", 0), (7, '[[1.5],[]]', 0)], "k int, j string, path int")
    assert sorted((r.k, r.path, r.value) for r in symbols.flattened(rows, ["k"], "j").collect()) == [(1, "a.b[]", "1"), (1, "a.b[]", "x"), (1, "a.b[].c", "null"), (4, "", "true"), (7, "[][]", "1.5")]
    deep = spark.createDataFrame([(1, '{"a":' * 12 + "7" + "}" * 12), (2, None)], "k int, j string")
    assert [tuple(r) for r in symbols.flattened(deep, ["k"], "j").collect()] == [(1, ".".join("a" * 12), "7")]
    assert symbols.flattened(deep.where("k = 2"), ["k"], "j").collect() == []


def test_composed_answers(spark, at):
    import pytest

    nodes = spark.createDataFrame(
        [("p", f"method:A#{n}()", "METHOD", f"A#{n}()", n, "m", "a", "a", "f" if n != "x" else None, 1, 2, "C", "i", '{"source_set":"main"}', [], at(1), None) for n in "abcx"],
        "project string, stable_id string, kind string, qualified_name string, simple_name string, module_name string, package_name string, namespace_path string, file_path string, start_line int, end_line int, confidence string, provenance string, metadata string, unresolved array<string>, loaded_at timestamp_ntz, deleted_at timestamp_ntz",
    )
    schema = "edge_id long, project string, source_stable_id string, target_stable_id string, kind string, confidence string, provenance string, metadata string, occurrences array<struct<file_path: string, start_line: int, end_line: int, metadata: string>>"
    edges = spark.createDataFrame([(i, "p", f"method:A#{a}()", f"method:A#{b}()", "CALLS", "C", "i", "{}", [("f", i + 1, i + 1, "{}")]) for i, (a, b) in enumerate(("ab", "bc", "ax"))], schema)
    assert {(r.section, r.item, r.n) for r in packs.project_map(nodes, edges).collect()} == {
        ("symbols", "METHOD", 4), ("edges", "CALLS", 3), ("areas", "a", 0), ("modules", "m", 4), ("source sets", "main", 4), *(("framework", r, 0) for r in ("controllers", "services", "repositories", "entities", "routes", "beans"))
    }
    one = packs.symbol(nodes, edges, "p", "method:A#a()", depth=2)
    assert one["symbol"].count() == 1 and [(r.category, r.n_edges) for r in one["context"].collect()] == [("callees", 2)] and one["evidence"].count() == 2
    assert {r.node: r.depth for r in one["callees"].collect()} == {"method:A#b()": 1, "method:A#c()": 2}
    starts = nodes.where(F.col("simple_name") == "a").select("project", "stable_id")
    assert packs.trace(nodes, edges, starts, groups=["calls"]).count() == 3 and packs.trace(nodes, edges, starts, groups=["calls"], application_only=False).count() == 4
    with pytest.raises(ValueError):
        packs.trace(nodes, edges, starts, depth=9)
