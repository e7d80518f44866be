"""Readers of graph documents, analyzer streams, claims, source and configuration files, with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symweave.session import ship

RANGE = "file_path STRING, start_line INT, end_line INT"
NODE = (
    "stable_id STRING, kind STRING, qualified_name STRING, simple_name STRING, module_name STRING, package_name STRING, namespace_path STRING, "
    f"{RANGE}, confidence STRING, provenance STRING, metadata STRING, unresolved ARRAY<STRING>"
)
OCCURRENCES = f"ARRAY<STRUCT<{', '.join(f.replace(' ', ': ', 1) for f in RANGE.split(', '))}, metadata: STRING>>"
EDGE = f"source_stable_id STRING, target_stable_id STRING, kind STRING, confidence STRING, provenance STRING, metadata STRING, occurrences {OCCURRENCES}"
DIAGNOSTIC = f"kind STRING, {RANGE}, symbol_text STRING, reason STRING, severity STRING"
SUMMARY = (
    "language STRING, files_discovered BIGINT, files_parsed BIGINT, files_failed BIGINT, bindings_resolved BIGINT, bindings_unresolved BIGINT, nodes_emitted BIGINT, edges_emitted BIGINT, "
    "duration_ms BIGINT, capabilities MAP<STRING, BOOLEAN>, timings_ms MAP<STRING, BIGINT>, status STRING"
)


def _struct(ddl: str) -> str:
    """A column list as a struct type."""
    return "STRUCT<" + ddl.replace(" ", ": ", 1) + ">"


def graph_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of graph documents, one JSON object for each file; missing metadata is an empty object, missing arrays are empty.

    A document that is no such object fails the read.
    """
    schema = f"project STRING, nodes ARRAY<STRUCT<{NODE}>>, edges ARRAY<STRUCT<{EDGE}>>"
    docs = spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")
    nodes = docs.select("project", F.explode("nodes").alias("n")).select("project", "n.*")
    edges = docs.select("project", F.explode("edges").alias("e")).select("project", "e.*")
    empty = F.coalesce("metadata", F.lit("{}"))
    return (
        nodes.withColumns({"metadata": empty, "unresolved": F.coalesce("unresolved", F.array().cast("array<string>"))}),
        edges.withColumns({"metadata": empty, "occurrences": F.coalesce("occurrences", F.array().cast(OCCURRENCES))}),
    )


def event_lines(lines: DataFrame) -> DataFrame:
    """(request_id, type, line, value): analyzer events from rows (request_id, value), as they came."""
    return lines.select("request_id", F.get_json_object("value", "$.type").alias("type"), "value")


def event_stream(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(request_id, ordinal, type, value) of analyzer streams: JSON lines, one file for each request, in order of their lines.

    Blank lines are no events. The file's name without its ending is the request. Streams are read line by line, in as
    many parts as the files have, and numbered by the part and the place in it. A line that is no JSON fails the read if
    strict, else it has no type.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    order = Window.partitionBy("name").orderBy("block", "place")
    placed = lines.select(F.regexp_replace("name", r"\.[^.]*$", "").alias("request_id"), (F.row_number().over(order) - 1).alias("ordinal"), "value").where(F.trim("value") != "")
    kind = F.get_json_object("value", "$.type")
    if strict:
        kind = F.when(F.try_parse_json("value").isNull(), F.raise_error(F.concat(F.lit("no JSON in line "), (F.col("ordinal") + 1).cast("string"), F.lit(" of "), F.col("request_id"))).cast("string")).otherwise(kind)
    return placed.select("request_id", "ordinal", kind.alias("type"), "value")


def events_of(events: DataFrame, kind: str) -> DataFrame:
    """The typed rows of one kind of event: node, edge, diagnostic or analysis_summary."""
    own = events.where(F.col("type") == kind)
    if kind == "node":
        return own.select("request_id", "ordinal", F.from_json("value", NODE).alias("v")).select("request_id", "ordinal", "v.*")
    if kind == "edge":
        wire = EDGE.replace("source_stable_id", "source", 1).replace("target_stable_id", "target", 1)
        rows = own.select("request_id", "ordinal", F.from_json("value", wire).alias("v")).select("request_id", "ordinal", "v.*")
        return rows.withColumnsRenamed({"source": "source_stable_id", "target": "target_stable_id"})
    member, schema = ("diagnostic", DIAGNOSTIC) if kind == "diagnostic" else ("summary", SUMMARY)
    rows = own.select("request_id", "ordinal", F.from_json(F.get_json_object("value", f"$.{member}"), schema).alias("v")).select("request_id", "ordinal", "v.*")
    return rows.fillna({"severity": "warning"}) if kind == "diagnostic" else rows


def claims(spark: SparkSession, path: str) -> DataFrame:
    """(event, stable_id, source, target, kind, symbol_text): the distinct graph claims of JSON lines.

    Other events, blank lines and rows without their key are left out.
    """
    v = F.from_json("value", f"type STRING, stable_id STRING, source STRING, target STRING, kind STRING, diagnostic {_struct('kind STRING, symbol_text STRING').replace('symbol_text STRING', 'symbol_text: STRING')}").alias("v")
    rows = spark.read.text(path).select(v).select(
        F.col("v.type").alias("event"), "v.stable_id", "v.source", "v.target", F.coalesce("v.kind", "v.diagnostic.kind").alias("kind"), F.col("v.diagnostic.symbol_text").alias("symbol_text")
    )
    keyed = "(event = 'node' AND stable_id IS NOT NULL) OR (event = 'edge' AND source IS NOT NULL AND target IS NOT NULL AND kind IS NOT NULL) OR (event = 'diagnostic' AND kind IS NOT NULL)"
    return rows.where(keyed).distinct()


_CLAIM = "question_id STRING, category STRING, event STRING, stable_id STRING, source STRING, target STRING, kind STRING, symbol_text STRING"
METRICS = ("input_tokens", "output_tokens", "tool_calls", "file_reads", "files_opened", "evidence_lines_read", "wall_time_ms")


def _as_type(ddl: str) -> str:
    return ", ".join(f.replace(" ", ": ", 1) for f in ddl.split(", "))


def ground_truth(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The expected and forbidden claims and the unsupported questions of documents of graph truth, each with its fixture.

    Missing lists are empty; a document that is no such object fails the read.
    """
    schema = f"fixture STRING, expected ARRAY<STRUCT<{_as_type(_CLAIM)}>>, forbidden ARRAY<STRUCT<{_as_type(_CLAIM)}>>, unsupported_questions ARRAY<STRUCT<question_id: STRING, category: STRING, reason: STRING>>"
    docs = spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")
    return {part: docs.select("fixture", F.explode(part).alias("c")).select("fixture", "c.*") for part in ("expected", "forbidden", "unsupported_questions")}


def agent_sessions(spark: SparkSession, path: str) -> DataFrame:
    """(mode, question_id, answer, claims, evidence, uncertainty_reported, metrics..) of the runs of session documents; missing lists are empty, missing metrics null."""
    run = f"question_id: STRING, answer: STRING, claims: ARRAY<STRING>, evidence: ARRAY<STRUCT<file: STRING, start_line: INT, end_line: INT>>, uncertainty_reported: BOOLEAN, metrics: STRUCT<{', '.join(f'{m}: BIGINT' for m in METRICS)}>"
    docs = spark.read.schema(f"schema_version STRING, mode STRING, runs ARRAY<STRUCT<{run}>>").json(path, multiLine=True, mode="FAILFAST")
    rows = docs.select("mode", F.explode("runs").alias("r")).select("mode", "r.*")
    empty = {"claims": F.coalesce("claims", F.array().cast("array<string>")), "evidence": F.coalesce("evidence", F.array().cast("array<struct<file: string, start_line: int, end_line: int>>")), "uncertainty_reported": F.coalesce("uncertainty_reported", F.lit(False))}
    return rows.withColumns(empty).select("mode", "question_id", "answer", "claims", "evidence", "uncertainty_reported", "metrics.*")


def source_texts(spark: SparkSession, root: str, pattern: str = "*", largest: int = 64 << 20) -> DataFrame:
    """(path, text, problem) of the files below a folder: text in UTF-8, null with a problem where there is none.

    Larger files, such with a NUL byte and such that aren't UTF-8 are problems.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    problem = (
        F.when(F.col("length") > largest, "too large").when(F.locate("\0", F.col("content").cast("string")) > 0, "binary").when(F.col("content").isNotNull() & text.isNull(), "not UTF-8")
    )
    return files.select("path", F.when(problem.isNull(), text).alias("text"), problem.alias("problem"))


def config_keys(files: DataFrame) -> DataFrame:
    """(path, key, line) of the keys of properties and YAML files, rows (path, text); never a value.

    YAML keys are joined by dots along their indentation; lists, comments and document marks are no keys.
    """

    def keys(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"]):
                stack: list[tuple[int, str]] = []
                for number, line in enumerate((text or "").splitlines(), 1):
                    bare = line.strip()
                    if not bare or bare[0] in "#!-":
                        continue
                    if path.endswith(".properties"):
                        name = bare.replace(":", "=", 1).split("=", 1)[0].strip()
                        rows.append((path, name, number))
                        continue
                    name, colon, value = bare.partition(":")
                    if not colon or value and not value.startswith(" "):
                        continue
                    indent = len(line) - len(line.lstrip())
                    stack = [s for s in stack if s[0] < indent] + [(indent, name.strip("'\""))]
                    if value.strip():
                        rows.append((path, ".".join(n for _, n in stack), number))
            yield pd.DataFrame(rows, columns=["path", "key", "line"])

    ship(files.sparkSession)
    return files.mapInPandas(keys, "path string, key string, line int")


def owning_roots(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, root) of each file: the deepest of the roots that holds it, joined by equality on the path's prefixes."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, F.lit(1), n)))
    known = roots.select(F.regexp_replace("root", "/$", "").alias("prefix"), "root").distinct()
    met = files.select("path", F.explode(prefixes).alias("prefix")).join(known, "prefix", "left")
    return met.groupBy("path").agg(F.max_by("root", F.when(F.col("root").isNotNull(), F.length("prefix"))).alias("root"))
