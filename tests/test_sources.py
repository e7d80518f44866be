import json

import pytest
from pyspark.sql import functions as F

from symweave.sources import files, sinks
from symweave.streaming import events as stream


def test_graph_documents(spark, tmp_path):
    doc = {"project": "p", "nodes": [{"stable_id": "type:A", "kind": "TYPE", "qualified_name": "A", "metadata": {"a": [1]}}], "edges": [{"source_stable_id": "type:A", "target_stable_id": "type:B", "kind": "CALLS", "occurrences": [{"file_path": "f", "start_line": 1, "end_line": 2, "metadata": {}}]}]}
    (tmp_path / "one.json").write_text(json.dumps(doc, indent=1))
    nodes, edges = files.graph_documents(spark, str(tmp_path / "*.json"))
    n, e = nodes.first(), edges.first()
    assert (n.stable_id, json.loads(n.metadata), n.unresolved) == ("type:A", {"a": [1]}, [])
    assert (e.metadata, e.occurrences[0].end_line) == ("{}", 2)
    (tmp_path / "two.json").write_text("{broken")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        files.graph_documents(spark, str(tmp_path / "*.json"))[0].collect()


def test_event_stream_and_claims(spark, tmp_path):
    lines = [
        {"type": "analysis_started", "request_id": "r"}, {"type": "node", "stable_id": "type:A", "kind": "TYPE", "unresolved": ["x"]}, {"type": "edge", "source": "a", "target": "b", "kind": "CALLS"},
        {"type": "edge", "source": "a", "kind": "CALLS"}, {"type": "diagnostic", "diagnostic": {"kind": "K", "file_path": "f", "start_line": 1, "end_line": 1, "reason": "why", "symbol_text": "s"}},
        {"type": "analysis_summary", "summary": {"language": "java", "nodes_emitted": 1, "capabilities": {"calls": True}, "timings_ms": {"parse": 5}}},
    ]
    (tmp_path / "r1.jsonl").write_text("\n".join(json.dumps(x) for x in lines[:2]) + "\n\n" + "\r\n".join(json.dumps(x) for x in lines[2:]))
    events = files.event_stream(spark, str(tmp_path))
    assert [(r.request_id, r.type) for r in events.orderBy("ordinal").collect()] == [("r1", x["type"]) for x in lines]
    assert files.events_of(events, "node").first().unresolved == ["x"]
    assert [r.target_stable_id for r in files.events_of(events, "edge").orderBy("ordinal").collect()] == ["b", None]
    assert files.events_of(events, "diagnostic").first().severity == "warning"
    assert files.events_of(events, "analysis_summary").first().timings_ms == {"parse": 5}
    got = {(r.event, r.stable_id, r.source, r.kind, r.symbol_text) for r in files.claims(spark, str(tmp_path)).collect()}
    assert got == {("node", "type:A", None, "TYPE", None), ("edge", None, "a", "CALLS", None), ("diagnostic", None, None, "K", "s")}


def test_texts_keys_and_roots(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/good.txt").write_text("é")
    (tmp_path / "a/bad.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "a/nul.txt").write_bytes(b"a\0b")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.problem) for r in files.source_texts(spark, str(tmp_path), "*.txt", 100).collect()}
    assert got == {"good.txt": ("é", None), "bad.txt": (None, "not UTF-8"), "nul.txt": (None, "binary")}
    texts = spark.createDataFrame([("x/application.yml", "a:\n  b: 1\n  c:\n    - d\n    e: 'f'\n# g: 1\nh: 2\n"), ("y.properties", "k.l=1\n#m=2\n n : 3\n"), ("z.yml", None)], "path string, text string")
    keys = {(r.path[0], r.key, r.line) for r in files.config_keys(texts).collect()}
    assert keys == {("x", "a.b", 2), ("x", "a.c.e", 5), ("x", "h", 7), ("y", "k.l", 1), ("y", "n", 3)}
    roots = spark.createDataFrame([("s",), ("s/main/",)], "root string")
    paths = spark.createDataFrame([("s/main/A",), ("s/mainly/B",), ("t/C",)], "path string")
    assert {(r.path, r.root) for r in files.owning_roots(paths, roots).collect()} == {("s/main/A", "s/main/"), ("s/mainly/B", "s"), ("t/C", None)}


def test_generations(spark, tmp_path):
    folder = str(tmp_path)
    table = lambda *ids: spark.createDataFrame([(i,) for i in ids], "stable_id string")
    assert sinks.manifest(spark, folder).count() == 0
    sinks.write_generation(folder, "p", 1, table("a"), table("e"))
    sinks.write_generation(folder, "p", 2, table("b", "c"), table())
    sinks.write_generation(folder, "q", 1, table("d"), table())
    for generation, nodes in ((2, table("x")), (3, table())):
        with pytest.raises(ValueError):
            sinks.write_generation(folder, "p", generation, nodes, table())
    assert {(r.project_id, r.stable_id) for r in sinks.read_active(spark, folder, "nodes").collect()} == {("p", "b"), ("p", "c"), ("q", "d")}
    sinks.write_json_lines(table("b", None, "a"), ["stable_id"], folder + "/lines")
    text = "".join(p.read_text() for p in sorted((tmp_path / "lines").glob("part-*")))
    assert [json.loads(x)["stable_id"] for x in text.splitlines()] == [None, "a", "b"]


def test_streams(spark, tmp_path):
    rows = [("r", i, t, "") for i, t in enumerate(("analysis_started", "node", "project_metadata", "odd", "analysis_completed"))] + [("s", 0, "node", "")]
    spark.createDataFrame(rows, stream.SCHEMA).write.json(str(tmp_path / "in"))
    events = stream.event_files(spark, str(tmp_path / "in"))
    for name, df, mode in (("problems", stream.order_problems(events), "append"), ("counts", stream.running_counts(events), "complete")):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert {(r.request_id, r.ordinal, r.problem) for r in spark.table("problems").collect()} == {("r", 2, "out of order"), ("r", 3, "unknown type"), ("s", 0, "no start")}
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 6
    stream.write_tables(events, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where("type = 'node'").count() == 2


def test_life_of_a_generation(spark, tmp_path):
    folder = str(tmp_path / "store")
    nodes, edges = spark.createDataFrame([("a",)], "stable_id string"), spark.createDataFrame([("a", "a")], "source string, target string")
    assert sinks.begin_generation(spark, folder, "p") == 1
    with pytest.raises(ValueError):
        sinks.begin_generation(spark, folder, "p")
    sinks.activate_generation(spark, folder, "p", 1, nodes, edges)
    assert sinks.begin_generation(spark, folder, "p") == 2
    sinks.fail_generation(spark, folder, "p", 2, "x" * 900)
    with pytest.raises(ValueError):
        sinks.fail_generation(spark, folder, "p", 2, "again")
    with pytest.raises(ValueError):
        sinks.mark_stale(spark, folder, "other")
    sinks.mark_stale(spark, folder, "p")
    states = {r.generation: (r.state, r.summary and len(r.summary)) for r in sinks.generation_states(spark, folder).collect()}
    assert states == {1: ("STALE", None), 2: ("FAILED", 500)} and sinks.read_active(spark, folder, "nodes").count() == 1


def test_streams_are_numbered_and_strict(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "r1.jsonl").write_text('{"type":"a"}\n\n{"type":"b"}\r\n' + '{"type":"c"}\n' * 500)
    (tmp_path / "s" / "r2.jsonl").write_text('{"type":"a"}\nno json\n')
    loose = files.event_stream(spark, str(tmp_path / "s"), strict=False).collect()
    assert [(r.request_id, r.ordinal, r.type) for r in sorted(loose, key=lambda r: (r.request_id, r.ordinal))][:3] == [("r1", 0, "a"), ("r1", 2, "b"), ("r1", 3, "c")] and len(loose) == 504
    with pytest.raises(Exception, match="no JSON in line 2 of r2"):
        files.event_stream(spark, str(tmp_path / "s")).collect()


def test_truth_and_session_documents(spark, tmp_path):
    (tmp_path / "t").mkdir()
    truth = {"fixture": "f", "expected": [{"question_id": "q", "category": "c", "event": "node", "stable_id": "type:A", "kind": "TYPE"}], "unsupported_questions": [{"question_id": "u", "category": "c", "reason": "r"}]}
    (tmp_path / "t" / "a.json").write_text(json.dumps(truth, indent=1))
    found = files.ground_truth(spark, str(tmp_path / "t"))
    assert [(r.fixture, r.question_id, r.stable_id, r.source) for r in found["expected"].collect()] == [("f", "q", "type:A", None)]
    assert found["forbidden"].count() == 0 and found["unsupported_questions"].first().reason == "r"
    (tmp_path / "s").mkdir()
    run = {"question_id": "q", "answer": "a", "claims": ["x"], "metrics": {"input_tokens": 5}}
    (tmp_path / "s" / "a.json").write_text(json.dumps({"schema_version": "1.0.0", "mode": "base", "runs": [run, {"question_id": "p"}]}))
    rows = {r.question_id: r for r in files.agent_sessions(spark, str(tmp_path / "s")).collect()}
    assert (rows["q"].input_tokens, rows["q"].claims, rows["p"].claims, rows["p"].tool_calls, rows["p"].uncertainty_reported) == (5, ["x"], [], None, False)
