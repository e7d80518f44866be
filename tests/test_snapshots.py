from symweave.operators import snapshots

NODES = "project_id string, generation long, stable_id string, kind string, start_line int, metadata_json string, unresolved_json string, island string, first int"
GENERATIONS = "project_id string, generation long, state string"


def run(spark, nodes, generations):
    df = snapshots.snapshot_changes(spark.createDataFrame(nodes, NODES), spark.createDataFrame(generations, GENERATIONS))
    return sorted((r.project_id, r.generation, r.stable_id, r.change) for r in df.collect())


def node(generation, stable_id, kind="T", line=1, metadata="{}", unresolved="[]", project="p"):
    return (project, generation, stable_id, kind, line, metadata, unresolved, "x", 1)


def test_changes_over_incomplete_and_empty_generations(spark):
    generations = [("p", 1, "STALE"), ("p", 2, "FAILED"), ("p", 3, "STALE"), ("p", 3, "STALE"), ("p", 4, "BUILDING"), ("p", 7, "STALE"), ("p", 8, "READY"), ("q", 5, "READY")]
    nodes = [
        node(1, "same"), node(1, "gone"), node(1, "edited"), node(1, "back"), node(2, "same", "X"), node(2, "phantom"),
        node(3, "same"), node(3, "edited", line=2), node(3, "new"), node(3, "new"), node(4, "other"),
        node(8, "same"), node(8, "back"), node(5, "only", project="q"), node(8, None),
    ]
    # Generation 7 is complete and has no rows.
    assert run(spark, nodes, generations) == sorted(
        [("p", 3, "back", "removed"), ("p", 3, "edited", "changed"), ("p", 3, "gone", "removed"), ("p", 3, "new", "added")]
        + [("p", 7, k, "removed") for k in ("same", "edited", "new")] + [("p", 8, "back", "added"), ("p", 8, "same", "added")]
    )


def test_json_spelling_nulls_and_repeated_rows(spark):
    generations = [("p", 1, "STALE"), ("p", 2, "READY")]
    before, after = '{"a": 1, "b": ["x", "ñ"], "c": {"d": null}}', '{"c":{"d":null},"b":["x","\\u00f1"],"a":1}'
    nodes = [
        node(1, "spelled", metadata=before), node(2, "spelled", metadata=after), node(2, "spelled", metadata=before),
        node(1, "order", unresolved='["x", "y"]'), node(2, "order", unresolved='["y", "x"]'),
        node(1, "nulls", kind=None, metadata=None), node(2, "nulls", kind=None, metadata=None),
        node(1, "null", line=None), node(2, "null", line=0), node(1, "text", metadata="not json"), node(2, "text", metadata="not  json"),
    ]
    assert run(spark, nodes, generations) == [("p", 2, k, "changed") for k in ("null", "order", "text")]


def test_empty(spark):
    assert run(spark, [], [("p", 1, "READY")]) == [] == run(spark, [node(1, "a")], [])


def test_intervals(spark):
    generations = [("p", g, "READY") for g in (1, 2, 3, 5)]
    nodes = [node(1, "a"), node(2, "a"), node(3, "a", line=9), node(5, "a")]
    df = snapshots.validity_intervals(spark.createDataFrame(nodes, NODES), spark.createDataFrame(generations, GENERATIONS))
    assert sorted((r["first"], r["last"], r.prior, r.following) for r in df.collect()) == [(1, 2, None, 3), (3, 3, 2, 5), (5, 5, 3, None)]
