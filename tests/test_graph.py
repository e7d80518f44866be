import pytest

from pyspark.sql import functions as F

from symweave.functions import names
from symweave.operators import counts, endpoints, evidence, sessions, symbols, traverse, validate
from symweave.plans import graph

EDGE = "project string, source string, target string, kind string, confidence string"


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_names(spark):
    df = spark.createDataFrame([("method:a.B#run(int)", "a.B#run(int)", "runFast", "//x//y/"), ("type:a.B", "a.B", "URLThing", "/"), (None, None, None, None)], "i string, q string, s string, r string")
    got = df.select(
        names.signature(F.col("i")), names.declaring_type(F.col("i")), names.derived_simple_name(F.col("q")), names.normalised_tokens(F.col("s")), names.kebab(F.col("s")), names.decapitalised(F.col("s")), names.normal_route(F.col("r"))
    ).collect()
    assert tuple(got[0]) == ("a.B#run(int)", "a.B", "run", "run fast", "run-fast", "runFast", "/x/y")
    assert tuple(got[1]) == ("a.B", "a.B", "B", "urlthing", "urlthing", "URLThing", "/")
    assert tuple(got[2]) == (None,) * 7


def test_identifier_grammar(spark):
    good = ["type:a.B", "method:A#f()", "constructor:A#<init>(int)", "field:A#x", "route:GET:/a", "crate:x/lib/y"]
    bad = ["", "type:", "type: ", "method:A#f", "method:#f()", "constructor:A#f()", "field:A#", "route:FETCH:/a", "route:GET:a", "thing:a", "type:a\nb", "type:" + "x" * 1020]
    df = spark.createDataFrame([(x,) for x in good + bad], "i string")
    assert values(df, names.is_valid_id(F.col("i"))) == [True] * len(good) + [False] * len(bad)


@pytest.mark.parametrize(("text", "expected"), [("x", "af63f54c86021707"), ("héllo", "a35ff71f960240e0"), ("", "cbf29ce484222325")])
def test_fnv(spark, text, expected):
    assert values(spark.createDataFrame([(text,)], "t string"), names.fnv1a64(F.col("t"))) == [expected]


def test_rank_order(spark):
    rows = [("harborRouter", "z.Q", "q"), ("a", "harborrouter", None), ("b", "x.Y", "HARBORROUTER"), ("c", "x.y", "harbor_router"), ("d", "harborRouters", "r"), ("e", "my.harborRouter", "r"), ("f", "other", "o")]
    df = spark.createDataFrame(rows, "stable_id string, qualified_name string, simple_name string")
    assert values(df, names.lexical_rank(F.lit("harborRouter"), F.col("stable_id"), F.col("qualified_name"), F.col("simple_name"))) == [900, 700, 600, 500, 400, 200, 0]


def test_search_guards(spark):
    with pytest.raises(ValueError):
        symbols.search(None, "")
    with pytest.raises(ValueError):
        traverse.edge_kinds(["nothing"], [])
    assert traverse.edge_kinds(["calls"], ["X", "CALLS"]) == ["CALLS", "CONSTRUCTS", "X"]


def test_cut_before_filter_loses_edges(spark):
    edges = spark.createDataFrame([("p", "a", f"t{i}", "A" if i < 5 else "CALLS", "X") for i in range(8)], EDGE)
    assert symbols.neighbours(edges, "source", 6, ["CALLS"]).count() == 1
    assert symbols.neighbours(edges, "source", 6, ["CALLS"], limit_first=False).count() == 3


def test_paths_with_cycle(spark):
    edges = spark.createDataFrame([("p", a, b, "CALLS", "X") for a, b in ("ab", "bc", "ca", "bd", "aa", "de")], EDGE)
    starts = spark.createDataFrame([("p", "a")], "project string, stable_id string")
    hops = traverse.steps(edges, ["CALLS"])
    got = {("".join(r.path), r.closed) for r in traverse.all_paths(starts, hops, 2).collect()}
    assert got == {("a", False), ("ab", False), ("abc", True), ("abd", True)}
    assert {(r.node, r.depth) for r in traverse.reached(starts, hops).collect()} == {("b", 1), ("c", 2), ("d", 2), ("e", 3)}
    assert {r.node for r in traverse.reached(starts, traverse.steps(edges, ["CALLS"], inbound=True)).collect()} == {"b", "c"}
    assert [(r.node, r.n_next) for r in traverse.branch_points(hops).orderBy("node").collect()] == [("a", 2), ("b", 2)]


def test_upper_median_and_reduction(spark):
    rows = [("f", "s", v) for v in (10, 20, 30, 40)] + [("f", "t", 60), ("f", "t", None), ("g", "t", 0), ("g", "s", 1)]
    medians = counts.upper_median(spark.createDataFrame(rows, "k string, mode string, v long"), ["k", "mode"], "v")
    assert {(r.k, r.mode, r.n, r["median"]) for r in medians.collect()} == {("f", "s", 4, 30), ("f", "t", 1, 60), ("g", "t", 1, 0), ("g", "s", 1, 1)}
    assert [(r.k, r.reduction) for r in counts.paired_reduction(medians, ["k"], "mode", "t", "s").collect()] == [("f", 50.0)]


def test_precision_and_recall(spark):
    schema = "g string, k string"
    expected, actual = spark.createDataFrame([("a", x) for x in "wxyz"] + [("b", "w")], schema), spark.createDataFrame([("a", x) for x in "yzz"] + [("c", "w")], schema)
    got = {r.g: (r.precision, r.recall) for r in counts.precision_recall(expected, actual, ["g"], ["k"]).collect()}
    assert got == {"a": (1.0, 0.5), "b": (1.0, 0.0), "c": (0.0, 1.0)}


def test_current_nodes_and_merged_edges(spark, at):
    nodes = spark.createDataFrame([("p", "a", "type", at(1), None), ("p", "a", "TYPE ", at(2), None), ("p", "b", "T", at(1), None), ("p", "b", "T", at(2), at(3)), (None, "c", "T", at(1), None)], "project string, stable_id string, kind string, loaded_at timestamp_ntz, deleted_at timestamp_ntz")
    assert [(r.stable_id, r.kind, r.loaded_at) for r in graph.current_nodes(nodes).collect()] == [("a", "TYPE", at(2))]
    schema = "edge_id long, project string, source_stable_id string, target_stable_id string, kind string, confidence string, provenance string, metadata string, occurrences array<struct<file_path: string, start_line: int, end_line: int, metadata: string>>"
    edges = spark.createDataFrame([(2, "p", "a", "b", "calls", "X", "i", "{}", [("f", 1, 2, "{}")]), (1, "p", "a", "b", " CALLS", "Y", "j", "{}", [("f", 3, 4, "{}"), ("f", 1, 2, "{}")]), (3, "p", None, "b", "CALLS", "Y", "j", "{}", None)], schema)
    assert [(r.kind, r.confidence, r.n_rows, r.n_occurrences) for r in graph.merged_edges(edges).collect()] == [("CALLS", "Y", 2, 3)]
    first = evidence.first_occurrences(graph.edge_occurrences(edges), 2).orderBy("ordinal").collect()
    assert [(r.edge_id, r.nth, r.start_line) for r in first] == [(1, 0, 3), (1, 1, 1)]


def test_lines_and_budget(spark):
    texts = spark.createDataFrame([("f", "one\r\ntwo\nthree\n\nfive\n"), ("g", ""), ("h", None)], "k string, text string")
    refs = spark.createDataFrame([("f", 2, 2), ("f", 5, 9), ("f", 9, 9), ("f", 3, 1), ("g", 1, 1), ("h", 1, 1)], "k string, start_line int, end_line int")
    got = evidence.numbered_lines(refs, texts, ["k"], 1).orderBy("start_line", "line").collect()
    assert [(r.start_line, r.line, r.text) for r in got] == [(2, 1, "one"), (2, 2, "two"), (2, 3, "three"), (5, 4, ""), (5, 5, "five")]
    wants = spark.createDataFrame([("r", i, w) for i, w in enumerate((3, 4, 2, 5))], "r string, i int, want int")
    assert [r.taken for r in evidence.shared_budget(wants, ["r"], ["i"], "want", 8).orderBy("i").collect()] == [3, 4, 1, 0]
    mixed = spark.createDataFrame([("a", i, i % 4) for i in range(12)] + [("b", 1, None), (None, 1, 9), ("b", 2, -9), ("b", 3, 9)], "r string, nth int, want int")
    taken = {(r.r, r.nth): r.taken for r in evidence.shared_budget(mixed, ["r"], ["nth"], "want", 7).collect()}
    assert taken == {**{("a", i): (0, 1, 2, 3, 0, 1)[i] if i < 6 else 0 for i in range(12)}, ("b", 1): 0, (None, 1): 7, ("b", 2): 0, ("b", 3): 7}
    assert all(r.taken == 0 for r in evidence.shared_budget(mixed, ["r"], ["nth"], "want", 0).collect())


def test_overlap_counts_each_pair_once(spark):
    columns = "project string, file_path string, start_line int, end_line int"
    symbols_ = spark.createDataFrame([("p", "f", 1, 500), ("p", "f", 60, 70), ("p", "f", 71, 80), ("p", "g", 1, 9), ("p", None, None, None)], columns)
    places = spark.createDataFrame([("p", "f", 64, 200), ("p", "f", 64, 200), ("p", "f", 600, 601), ("p", "f", 0, 3)], columns)
    assert {(r.start_line, r.n_symbols) for r in evidence.overlapping_symbols(symbols_, places).collect()} == {(64, 3), (600, 0)}


def test_validation(spark):
    rows = spark.createDataFrame([("a", "f", 1, 2), ("b", None, None, None), ("c", "f", None, 2), ("d", "f", 0, 2), ("e", "f", 3, 2)], "k string, file_path string, start_line int, end_line int")
    assert sorted(values(validate.location_problems(rows, ["k"]), "k")) == ["c", "d", "e"]
    kinds = ["analysis_started", "project_metadata", "node", "node", "edge", "node", "odd", "analysis_summary"]
    events = spark.createDataFrame([("r", i, k) for i, k in enumerate(kinds)] + [("s", 0, "node"), ("s", 1, "analysis_completed")], "request_id string, ordinal long, type string")
    assert {(r.request_id, r.ordinal, r.problem) for r in validate.event_order_problems(events).collect()} == {("r", 5, "out of order"), ("r", 6, "unknown type"), ("r", 7, "no completion"), ("s", 0, "no start")}


def test_sensitive_and_suppressed(spark):
    paths = spark.createDataFrame([(p,) for p in (".env", "a/.env.local", "x/Secrets.txt", "k.pem", "h/.ssh/id", "src/envy.rs", "a.java", None)], "p string")
    assert values(paths, names.is_sensitive(F.col("p"))) == [True] * 5 + [False, False, None]
    rows = spark.createDataFrame([("METHOD", "getX", "f", "method:A#getX()", "{}"), ("METHOD", "run", "f", "method:java.util.A#run()", "{}"), ("TYPE", "A", "f", "type:A", '{"generated":true}'), ("METHOD", "run", "f", "method:A#run()", "{}"), ("TYPE", "A", None, "type:A", None)], "k string, s string, f string, i string, m string")
    assert values(rows, names.is_suppressed(*(F.col(c) for c in "ksfim"))) == [True, True, True, False, True]


def test_project_ids_and_fingerprints(spark):
    import uuid

    roots = ["/srv/work/a", "C:\\work\\b", "/ä"]
    df = spark.createDataFrame([(r,) for r in roots], "r string")
    assert values(df, names.project_id(F.col("r"))) == [str(uuid.uuid5(uuid.UUID(names.PROJECT_NAMESPACE), r.replace("\\", "/"))) for r in roots]
    files = [("x", "a", "1"), ("x", "b", None), ("x", "b", None), ("y", "b", ""), ("y", "a", "1"), ("y", None, "1"), ("z", "a", "1"), ("z", "b", None)]
    got = {r.g: (r.n_files, r.fingerprint) for r in counts.fingerprints(spark.createDataFrame(files, "g string, p string, t string"), ["g"], "p", "t").collect()}
    assert got["x"] == got["z"] != got["y"] and got["y"][0] == 2


def test_type_texts_paths_and_forms(spark):
    df = spark.createDataFrame([("Map<A<B<C<D<E<F<G<H>>>>>>>, I>[]", "a/b.rs", "x\ny\nz", "v ${a.b:c} ${d}"), ("Vec<T>::new", "../a", "", "none"), ("self", "C:/x", None, "${}"), (None, "", "x", None)], "t string, p string, x string, v string")
    assert values(df, names.without_arguments(F.col("t"))) == ["Map[]", "Vec::new", "self", None]
    assert values(df, names.final_name(F.col("t"))) == ["Map[]", "new", None, None]
    assert values(df, names.is_safe_path(F.col("p"))) == [True, False, False, False]
    assert values(df, names.line_of(F.col("x"), F.lit(4))) == [3, 1, None, 1] and values(df, names.placeholder_key(F.col("v"))) == ["a.b", None, None, None]
    assert values(df, names.bounded(F.col("t"), 3)) == ["Map", "Vec", "sel", None]
    assert values(spark.createDataFrame([(" a//b/ ",), ("/",), ("",), ("//x",)], "p string"), names.asked_route(F.col("p"))) == ["/a//b", "/", "/", "/x"]


def test_roles_and_search_filters(spark):
    schema = "project string, stable_id string, kind string, qualified_name string, simple_name string, module_name string, package_name string, namespace_path string, file_path string, metadata string"
    rows = [
        ("p", "type:a.OrderController", "TYPE", "a.OrderController", "OrderController", "m", "a", None, "f", '{"annotations":["x.Odd","web.RestController"]}'), ("p", "method:a.OrderController#orders()", "METHOD", "a.OrderController.orders", "orders", "m", "a", "a.b", "f", '{"has_body":true}'),
        ("p", "bean:orders", "BEAN", "orders", "orders", None, "a", None, None, '{"stereotype":"Service"}'), ("p", "entity:b.Order", "ENTITY", "b.Order", "Order", "n", "b", "b", "f", "{}"), ("q", "type:x", "TYPE", "x.Order", "Order", None, None, None, None, None),
    ]
    nodes = spark.createDataFrame(rows, schema)
    assert {r.stable_id: (r.direct, r.role) for r in symbols.framework_roles(nodes).collect()} == {"type:a.OrderController": ("CONTROLLER",) * 2, "method:a.OrderController#orders()": (None, "CONTROLLER"), "bean:orders": ("SERVICE",) * 2, "entity:b.Order": ("ENTITY",) * 2, "type:x": (None, None)}
    found = lambda *a, **k: [(r.stable_id, r["rank"], r.n_matched) for r in symbols.search(nodes.where("project = 'p'"), *a, **k).orderBy("nth").collect()]
    assert found("orders") == [("bean:orders", 745, 1 + 1), ("method:a.OrderController#orders()", 690, 2)]
    assert found("order", roles=("controller",), limit=1, offset=1) == [("method:a.OrderController#orders()", 490, 2)]
    assert found("order", module="n") == [("entity:b.Order", 600 + 80 + 20 + 25 + 40, 1)] and found("order", namespace_prefix="a") == [("method:a.OrderController#orders()", 400 + 80 + 10 + 30, 1)] and found("nothing") == []
    assert [r.stable_id for r in symbols.candidates(nodes.where("project = 'p'"), "orders", 1).collect()] == ["bean:orders"]


def test_shortest_traces_and_counts(spark):
    hops = spark.createDataFrame([("p", a, b, k, b == "h", b != "u") for a, b, k in (("a", "b", "X"), ("a", "b", "C"), ("a", "c", "C"), ("b", "d", "C"), ("c", "d", "B"), ("d", "a", "C"), ("b", "h", "C"), ("b", "u", "C"))], "project string, node string, next string, kind string, hidden boolean, wanted boolean")
    starts = spark.createDataFrame([("p", "a")], "project string, stable_id string")
    paths, tally = traverse.traces(starts, hops, 3, shortest=True)
    assert {("".join(r.path), "".join(r.kinds)) for r in paths.collect()} == {("abd", "CC"), ("ac", "C")}
    every, counts_ = traverse.traces(starts, hops, 3)
    assert {("".join(r.path), "".join(r.kinds)) for r in every.collect()} == {("abd", "CC"), ("abd", "XC"), ("acd", "CB")}
    assert [tuple(r) for r in counts_.collect()] == [("p", "a", 4, 3, 2)] and tally.first().n_cycles == 1


def test_accuracy_and_compared_sessions(spark):
    rows = lambda *ks: spark.createDataFrame([("g", k) for k in ks], "g string, k string")
    got = sessions.graph_accuracy(rows("a", "b", None, "d"), rows("x", "y"), rows("a", "b", None, "x", "z"), ["g"], ["k"]).first()
    assert (got.n_expected, got.n_true, got.n_missing, got.n_forbidden, got.precision, got.recall) == (4, 3, 1, 1, 0.75, 0.75)
    runs = [("s", "q1", "base", True, 0, 1000, 10), ("s", "q1", "new", True, 0, 300, 4), ("s", "q2", "base", False, 1, 0, 10), ("s", "q2", "new", False, 0, 5, None), ("s", "q3", "base", True, 0, 1, 1)]
    df = spark.createDataFrame(runs, "g string, question_id string, mode string, correct boolean, n_unsupported long, tokens long, calls long")
    one = sessions.compared_sessions(df, ["g"], "base", "new", {"tokens": 60.0, "calls": 70.0}).first()
    assert (one.n_pairs, one.reduction_tokens, one.meets_tokens, one.reduction_calls, one.meets_calls, one.no_less_correct, one.none_unsupported) == (2, 70.0, True, 60.0, False, True, True)
    whole = {r.mode: r for r in sessions.session_aggregates(df, ["mode"], ["tokens"]).collect()}
    assert (whole["base"].correctness, whole["base"].n_unsupported, whole["base"].median_tokens) == (2 / 3, 1, 1) and whole["new"].median_tokens == 300


def test_endpoint_of_a_small_graph(spark):
    """Two handlers of one route, a library call, a repository, a cycle and a branch."""
    n = lambda i, kind, name, file="f", meta="{}": ("p", i, kind, i.split(":")[1].replace("#", "."), name, file, "COMPILER_RESOLVED", meta)
    nodes = [n("route:GET:/a", "ROUTE", "/a"), n("method:a.C#one()", "METHOD", "one"), n("method:a.C#two()", "METHOD", "two"), n("method:a.S#run()", "METHOD", "run"), n("method:a.S#walk()", "METHOD", "walk"), n("method:java.util.L#f()", "METHOD", "f"), n("method:a.S#getX()", "METHOD", "getX"), n("method:b.OrderRepository#saveAll(b.Order)", "METHOD", "saveAll", "f", '{"parameter_types":["b.Order"]}'), n("type:b.Order", "TYPE", "Order"), n("type:a.C", "TYPE", "C"), n("bean:s", "BEAN", "s", "f", '{"declared_type":"a.S"}')]
    edges = [("route:GET:/a", "method:a.C#one()", "HANDLED_BY"), ("route:GET:/a", "method:a.C#two()", "HANDLED_BY"), ("method:a.C#one()", "method:a.S#run()", "CALLS"), ("method:a.C#one()", "method:a.S#walk()", "CALLS"), ("method:a.C#one()", "method:java.util.L#f()", "CALLS"), ("method:a.C#one()", "method:a.S#getX()", "CALLS"), ("method:a.S#run()", "method:a.S#walk()", "CALLS"), ("method:a.S#walk()", "method:b.OrderRepository#saveAll(b.Order)", "CALLS"), ("method:a.S#walk()", "method:a.C#one()", "CALLS"), ("type:a.C", "bean:s", "INJECTS"), ("method:a.S#run()", "type:b.Order", "READS")]
    df = spark.createDataFrame(nodes, "project string, stable_id string, kind string, qualified_name string, simple_name string, file_path string, confidence string, metadata string")
    links = spark.createDataFrame([("p", *e) for e in edges], "project string, source string, target string, kind string")
    handlers = endpoints.route_handlers(df, links)
    flow = endpoints.Flow(df, links, handlers, 3)
    assert {r.path for r in flow.paths().collect()} == {"a.C.two()", "a.C.one() > a.S.walk() > b.OrderRepository.saveAll(b.Order)"}
    facts = {(r.category, r.item) for r in flow.facts().collect()}
    assert facts == {("writes", "b.Order"), ("reads", "b.Order"), ("branch points", "a.C.one()"), ("branch points", "a.S.walk()"), ("injections", "a.C > a.S")}
    one = endpoints.endpoint_summary(handlers, flow, df).first()
    assert (one.n_handlers, one.n_paths, one.n_hidden, one.n_writes, one.completeness) == (2, 2, 4, 1, "ambiguous")
    assert {r.stable_id: r.domain for r in endpoints.repository_domains(df).collect()} == {"method:b.OrderRepository#saveAll(b.Order)": "b.Order"}
    with pytest.raises(ValueError):
        endpoints.Flow(df, links, handlers, 0)
