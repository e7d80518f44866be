import pytest
from pyspark.sql import functions as F

from symweave.operators import beans

SERVICE, CONTROLLER = "org.springframework.stereotype.Service", "org.springframework.web.bind.annotation.RestController"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stereotypes(spark):
    given = [
        ("p", "T", 0, "A"), ("p", "T", 0, "A"), ("p", "T", 1, SERVICE), ("p", "A", 0, "B"), ("p", "A", 1, CONTROLLER), ("p", "B", 0, "A"), ("p", "B", 1, "other.Note"),
        ("p", "U", 1, SERVICE), ("p", "U", 0, "C"), ("p", "C", 0, "C"), ("p", "V", 0, "B"), ("q", "T", 0, "A"), ("p", "W", 0, None), (None, "T", 0, SERVICE),
    ]
    found = beans.stereotypes(spark.createDataFrame(given, "project string, type string, nth int, annotation string"))
    assert rows(found) == sorted([
        ("p", "A", "RestController", ["B", "A", CONTROLLER]), ("p", "B", "RestController", ["A", CONTROLLER]), ("p", "T", "RestController", ["A", CONTROLLER]), ("p", "U", "Service", [SERVICE]), ("p", "V", "RestController", ["B", "A", CONTROLLER]),
    ], key=repr)
    assert rows(beans.stereotypes(spark.createDataFrame([], "project string, type string, nth int, annotation string"))) == []


def test_scans(spark):
    types = spark.createDataFrame(
        [("p", "a.b.T", "a.b", "T", None, False, True), ("p", "a.b.c.URLMap", "a.b.c", "URLMap", " ", True, None), ("p", "a.bc.X", "a.bc", "X", None, False, False), ("p", "N", None, "N", None, None, None), ("q", "Q", None, "Q", "own", None, False), ("p", "x.y.Z", "x.y", "Z", "z1", None, None)],
        "project string, type string, package_name string, simple_name string, explicit_name string, conditional boolean, is_application boolean",
    )
    scans = spark.createDataFrame([("p", [" ", None], ["x.y.Marker", "Plain", None]), ("p", None, None)], "project string, packages array<string>, classes array<string>")
    roots = beans.scan_roots(types, scans)
    assert rows(roots) == [("p", "a.b"), ("p", "x.y")]
    found = types.select("project", "type", F.lit("Service").alias("stereotype"), F.lit("clash").alias("bean"))
    got = beans.scanned_beans(types, found, roots)
    assert rows(got) == sorted([
        ("p", "a.b.T", "t", "Service", "FRAMEWORK_RESOLVED", True), ("p", "a.b.c.URLMap", "URLMap", "Service", "STATIC_INFERRED", True), ("p", "x.y.Z", "z1", "Service", "FRAMEWORK_RESOLVED", True), ("q", "Q", "own", "Service", "STATIC_INFERRED", False),
    ], key=repr)
    assert rows(beans.unknown_scans(got)) == [("q", 1)]


def test_factories_and_constructors(spark):
    methods = spark.createDataFrame([("p", "m1", "one", ["a", "b", "b"], "T", True), ("p", "m2", "two", [], "U", None), ("p", "m3", "three", None, None, False), ("p", "m2", "two", [], "U", None)], "project string, method_id string, method string, names array<string>, return_type string, conditional boolean")
    above = spark.createDataFrame([("p", "T", "S"), ("p", "T", "R"), ("p", "T", "S"), ("q", "U", "X")], "project string, type string, super string")
    assert rows(beans.factory_beans(methods, above)) == [("p", "m1", "a", ["b"], ["R", "S", "T"], "STATIC_INFERRED"), ("p", "m2", "two", [], ["U"], "FRAMEWORK_RESOLVED"), ("p", "m3", "three", [], [], "FRAMEWORK_RESOLVED")]
    made = spark.createDataFrame([("p", "T", "c1", None), ("p", "T", "c2", True), ("p", "U", "c3", False), ("p", "U", "c3", None), ("p", "V", "c4", None), ("p", "V", "c5", False)], "project string, type string, constructor string, autowired boolean")
    assert rows(beans.injected_constructors(made)) == [("p", "T", "c2"), ("p", "U", "c3")]


BEANS = [("p", "a", "TA", ["I", "A"], ["fast"], True, None), ("p", "b", "TB", ["I", "B", "B"], None, False, True), ("p", "k", "TK", ["K"], ["both"], None, None), ("p", "l", "TL", ["K"], ["both"], None, None), ("q", "a", "TQ", ["A"], [], None, None)]
POINTS = [("p", "TB", "c1", "x", "A", None), ("p", "N", "c2", "x", "I", None), ("p", "N", "c3", "b", "B", "slow"), ("p", "N", "c4", "l", "K", None), ("p", "N", "c5", "x", "K", "both"), ("p", "TA", "c6", "x", "B", None), ("p", "N", "c7", "x", "Z", None), ("p", "N", "c8", "x", None, None), ("p", "N", "c9", "x", "K", None)]


@pytest.fixture
def given(spark):
    return (
        lambda points: spark.createDataFrame(points, "project string, consumer string, point string, parameter string, required string, qualifier string"),
        spark.createDataFrame(BEANS, "project string, bean string, type string, assignable array<string>, qualifiers array<string>, is_primary boolean, conditional boolean"),
    )


def test_injections(given):
    points, all_beans = given
    got = rows(beans.injections(points(POINTS), all_beans).select("source", "target", "kind", "confidence", "reason"))
    sure, maybe, several = "FRAMEWORK_RESOLVED", "STATIC_INFERRED", "AMBIGUOUS"
    candidates = [("c1", "a", sure), ("c2", "a", several), ("c2", "b", several), ("c3", "b", sure), ("c6", "b", sure)] + [(c, b, several) for c in ("c4", "c5", "c9") for b in ("k", "l")]
    assert got == sorted([(s, t, "BEAN_CANDIDATE", c, None) for s, t, c in candidates] + [
        ("c1", "a", "SELECTED_BEAN", sure, "UNIQUE_CANDIDATE"), ("c2", "a", "SELECTED_BEAN", sure, "PRIMARY"), ("c4", "l", "SELECTED_BEAN", sure, "INJECTION_POINT_NAME"), ("c5", "k", "SELECTED_BEAN", sure, "QUALIFIER"), ("c6", "b", "SELECTED_BEAN", maybe, "UNIQUE_CANDIDATE"),
        ("TB", "a", "INJECTS", sure, None), ("TA", "b", "INJECTS", maybe, None),
    ], key=repr)


def test_injections_of_factories(given):
    points, all_beans = given
    got = rows(beans.injections(points([("p", "a", "f1", "b", "I", None), ("p", "l", "f2", "k", "K", "both"), ("p", "z", "f3", "k", "K", None)]), all_beans, factories=True).where("kind <> 'BEAN_CANDIDATE'").select("source", "target", "kind", "confidence", "reason"))
    sure = "FRAMEWORK_RESOLVED"
    assert got == sorted([("f1", "b", "SELECTED_BEAN", sure, "FACTORY_PARAMETER"), ("a", "b", "INJECTS", sure, None), ("f2", "k", "SELECTED_BEAN", sure, "QUALIFIER"), ("l", "k", "INJECTS", sure, None)], key=repr)


def shuffled(spark):
    """Rows written for shuffles so far."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("factories", [True, False])
def test_pairs_of_injections_are_not_shuffled(spark, given, factories):
    many = spark.range(400).selectExpr("'p' AS project", "'b' || id AS bean", "'b' || id AS type", "array('I') AS assignable", "array('q' || id % 3) AS qualifiers", "id = 7 AS is_primary", "false AS conditional")
    points = spark.range(300).selectExpr("'p' AS project", "'b' || id AS consumer", "'c' || id AS point", "'b9' AS parameter", "'I' AS required", "CASE WHEN id < 3 THEN 'q' || id END AS qualifier")
    before = shuffled(spark)
    got = beans.injections(points, many, factories).groupBy("kind").count().collect()
    assert shuffled(spark) - before < 20_000
    assert {r["kind"]: r["count"] for r in got} == {"BEAN_CANDIDATE": 300 * (399 if factories else 400), "SELECTED_BEAN": 299 if factories else 300, "INJECTS": 299 if factories else 300}


@pytest.mark.parametrize("factories", [True, False])
def test_pairs_of_injections_take_little_space(spark, given, tmp_path, factories):
    many = spark.range(4801).selectExpr("'p' AS project", "'b' || id AS bean", "'b' || id AS type", "array('I') AS assignable", "array('q') AS qualifiers", "false AS is_primary", "false AS conditional")
    points = spark.range(256).selectExpr("'p' AS project", "'b' || id AS consumer", "'c' || id AS point", "'x' AS parameter", "'I' AS required", "CAST(NULL AS STRING) AS qualifier")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with tables that are too large for it
    try:
        beans.injections(points, many, factories).write.parquet(f"{tmp_path}/out")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert (got.count(), got.distinct().count()) == (256 * (4800 if factories else 4801),) * 2
    assert sum(f.stat().st_size for f in (tmp_path / "out").rglob("*.parquet")) < 0.6 * 1_200_000


@pytest.mark.parametrize("factories", [True, False])
def test_repeated_points_in_slices(given, monkeypatch, factories):
    monkeypatch.setattr(beans, "PAIRS_AT_ONCE", 1)
    points, all_beans = given
    twice = [("p", "a", "c1", "x", "I", None), ("p", "b", "c1", "x", "I", None), ("p", "a", "c2", "x", "A", None), ("p", "a", "c2", "x", "I", None), ("p", "k", "c3", "k", "K", "both"), (None, "a", "c4", "x", "I", None), ("p", "a", None, "x", "K", None)]
    got = rows(beans.injections(points([*twice, twice[0]]), all_beans, factories).where("kind <> 'INJECTS'").select("source", "target", "kind", "confidence", "reason"))
    sure, several = "FRAMEWORK_RESOLVED", "AMBIGUOUS"
    if factories:
        want = [("c1", "a", "BEAN_CANDIDATE", sure, None), ("c1", "b", "BEAN_CANDIDATE", sure, None), ("c1", "a", "SELECTED_BEAN", sure, "FACTORY_PARAMETER"), ("c1", "b", "SELECTED_BEAN", sure, "FACTORY_PARAMETER"), ("c2", "b", "BEAN_CANDIDATE", sure, None), ("c2", "b", "SELECTED_BEAN", sure, "FACTORY_PARAMETER"), ("c3", "l", "BEAN_CANDIDATE", sure, None), ("c3", "l", "SELECTED_BEAN", sure, "QUALIFIER")]
    else:
        want = [(c, b, "BEAN_CANDIDATE", several, None) for c, b in (("c1", "a"), ("c1", "b"), ("c2", "a"), ("c2", "b"), ("c3", "k"), ("c3", "l"))] + [("c1", "a", "SELECTED_BEAN", sure, "PRIMARY"), ("c3", "k", "SELECTED_BEAN", sure, "QUALIFIER")]
    assert got == sorted(want, key=repr)


def test_bindings_components_and_bodies(spark):
    annotation = "array<struct<annotation: string, name: string, value: string, required: boolean>>"
    parameters = spark.createDataFrame([(1, "x", None, None), (2, "x", True, [("RequestParam", "", "q", None), (None, None, None, None), ("Size", None, None, True)]), (3, None, True, [])], f"id int, name string, optional boolean, annotations {annotation}")
    assert rows(beans.bindings(parameters, ["id"])) == [(1, "JAVA", "x", True), (2, "REQUEST_PARAM", "q", True), (3, "JAVA", None, False)]
    fields = spark.createDataFrame([("p", "D", "b", "int", ["Min"]), ("p", "D", "a", "int", ["Min", "Max"]), ("p", "D", "c", "int", []), ("p", "D", "d", "int", None), ("p", "E", "a", "int", ["Min"]), ("p", "D", "b", "int", ["Min"])], "project string, type string, field string, java_type string, validation array<string>")
    held = spark.createDataFrame([("p", "D", 1), ("p", "D", 2), ("p", None, 3)], "project string, type string, field int")
    assert [(r.type, [c.field for c in r.components]) for r in beans.validated_components(held, fields).collect()] == [("D", ["a", "b"])]
    routes = spark.createDataFrame([("p", "r1", '{"handler_parameters":[{"binding_kind":"JAVA"},{"binding_kind":"REQUEST_BODY","java_type":"T"}]}'), ("p", "r2", "broken"), ("p", "r3", None), ("p", "r4", "{}")], "project string, stable_id string, metadata string")
    assert rows(beans.request_bodies(routes)) == [("p", "r1", "T")]


def test_repositories_and_targets(spark):
    crud, base = "org.springframework.data.repository.CrudRepository", "org.springframework.data.repository.Repository"
    faces = spark.createDataFrame([("p", "R", 0, "x.Y", ["E", "L"]), ("p", "R", 2, base, ["F", "L"]), ("p", "R", 1, crud, ["E", "L", "M"]), ("p", "S", 0, crud, ["E"]), ("p", "S", 1, None, None), ("p", "U", 0, base, ["F", "L"])], "project string, type string, nth int, interface string, arguments array<string>")
    entities = spark.createDataFrame([("p", "E"), ("p", "E"), ("q", "F"), ("p", None)], "project string, entity string")
    assert rows(beans.repositories(faces, entities)) == [("p", "R", "E", "L", crud, True), ("p", "U", "F", "L", base, False)]
    files = spark.createDataFrame([("p", f) for f in ("a/src/lib.rs", "a/src/x/y.rs", "a/tests/t.rs", "b.rs", "a/src/x/y.rs", None)] + [("q", "b.rs")], "project string, path string")
    targets = spark.createDataFrame([("p", 0, "a/src/main.rs", "bin"), ("p", 1, "a/src/lib.rs", "lib"), ("p", 2, "a/src/bin.rs", "bin"), ("p", 3, "a/tests/t.rs", "test"), ("p", 4, "a/src/lib.rs", "rlib"), ("p", 5, "build.rs", "bin"), ("p", 6, None, "bin")], "project string, nth int, source string, kind string")
    assert rows(beans.owning_targets(files, targets)) == [("p", "a/src/lib.rs", "a/src/lib.rs", "lib"), ("p", "a/src/x/y.rs", "a/src/lib.rs", "rlib"), ("p", "a/tests/t.rs", "a/tests/t.rs", "test"), ("p", "b.rs", "build.rs", "bin")]
    assert ("p", "a/tests/t.rs", "build.rs", "bin") in rows(beans.owning_targets(files, targets, tests=False))
