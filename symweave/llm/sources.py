"""Source files that do not parse (problem 5).

Each file is cut into chunks. A chunk becomes a map from the lexer's state at its start to the state at its end, its
tokens and its unmatched brackets. Maps of neighbouring chunks are joined, which is associative: first within each task,
whose chunks of a large file are a part of it only, then for each file. Its balanced groups and statements are held
against the local grammars of its language at last.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.llm.syntax import data, lexing
from symweave.llm.syntax.java import Java
from symweave.llm.syntax.rust import Rust
from symweave.llm.syntax.shapes import WRONG, Bad

#: A chunk ends at the first line end after so many characters, or, if none follows soon, behind a comma or semicolon.
CHUNK = 24_000
#: Neighbouring chunks of a file that are lexed in one task; files with more of them are spread over several.
SPAN = 64
#: More frames than the grammars need for each token, however deep groups and statements are nested.
FRAMES = 64
LANGUAGES = ("java", "rust", "json", "toml")


def parses(tokens: str | None, language: str) -> bool:
    """Whether the tokens of a whole file follow the language's grammar; None for tokens that were found wrong before."""
    if tokens is None or WRONG in tokens:
        return False
    limit = sys.getrecursionlimit()
    try:
        # The grammars take a bounded number of frames for a token. They call each other in plain Python only, whose frames lie on the heap.
        sys.setrecursionlimit(min(limit + FRAMES * len(tokens), 2**31 - 1))
        if language in ("json", "toml"):
            (data.json_file if language == "json" else data.toml_file)(tokens)
            return True
        grammar = Java if language == "java" else Rust
        return grammar.holds("file", grammar.shapes.reduce(tokens))
    except Bad:
        return False
    finally:
        sys.setrecursionlimit(limit)


def source_files(docs: DataFrame, extensions: DataFrame) -> DataFrame:
    """(doc_id, repo, file_path, language, text) of the source files in a known language, by the extension of their path.

    Files without a path or with an unknown extension are left out: no language says what is valid. The table of
    extensions doesn't grow. A null text counts as an empty one.
    """
    known = F.broadcast(extensions.select(F.lower(F.ltrim("extension", F.lit("."))).alias("extension"), "language").where(F.col("language").isin(*LANGUAGES)).dropDuplicates(["extension"]))
    files = docs.where("doc_kind = 'source' AND file_path IS NOT NULL").select(
        "doc_id", "repo", "file_path", F.coalesce("text", F.lit("")).alias("text"), F.lower(F.substring_index("file_path", ".", -1)).alias("extension")
    )
    return files.join(known, "extension").drop("extension")


def _joined(parts: list[tuple[int, int, lexing.Map]], language: str) -> list[tuple[int, int, lexing.Map]]:
    """Rows (first chunk, last chunk, map) with all neighbours joined; of parts that are given twice the longest counts."""
    longest = {at: p for p in sorted(parts, key=lambda p: p[1]) for at in (p[0],)}
    joined: list[tuple[int, int, lexing.Map]] = []
    for at in sorted(longest):
        first, last, own = longest[at]
        if joined and first <= joined[-1][1]:
            continue
        if joined and first == joined[-1][1] + 1:
            start, _, before = joined.pop()
            first, own = start, lexing.join(before, own, language == "rust", not start)
        joined.append((first, last, own))
    return joined


def checked_files(files: DataFrame, chunk: int = CHUNK, span: int = SPAN) -> DataFrame:
    """(doc_id, valid) for each doc_id of rows (doc_id, language, text); rows that are given twice count once.

    Empty and blank Java, Rust and TOML files are valid, such JSON files aren't. Texts of any length are looked at
    whole, and lines of any length are cut; only a single literal or comment without comma and semicolon is not.
    """
    piece = rf"(?s).{{1,{chunk}}}(?:[^\n]{{0,{chunk}}}+\n|[^\n]*?(?:\n|[,;](?!')|\z))"
    cut_up = F.regexp_extract_all("text", F.lit(piece), F.lit(0))
    at_line_start = lambda p, i: F.struct(p.alias("piece"), ((i > 0) & ~F.endswith(F.get("pieces", i - 1), F.lit("\n"))).alias("within_line"))
    exploded = lambda df: (
        df.select("doc_id", "language", cut_up.alias("pieces")).select("doc_id", "language", F.posexplode_outer(F.transform("pieces", at_line_start)).alias("at", "p"))
        .select("doc_id", "language", F.coalesce("at", F.lit(0)).alias("at"), F.coalesce("p.piece", F.lit("")).alias("piece"), F.coalesce("p.within_line", F.lit(False)).alias("within_line"))
    )
    large = F.char_length("text") > span * chunk
    spread = exploded(files.where(large)).withColumn("part", F.expr(f"at div {span}"))
    chunks = exploded(files.where(~large)).unionByName(spread.repartition("doc_id", "part").sortWithinPartitions("doc_id", "at").drop("part"))

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for (doc, language), own in b.groupby(["doc_id", "language"], sort=False):
                maps = [(at, at, lexing.chunk_map(t, language, not at, within)) for at, t, within in zip(own["at"].tolist(), own["piece"].tolist(), own["within_line"].tolist())]
                for first, last, (states, deeper) in _joined(maps, language):
                    rows.append((doc, language, first, last, [dict(zip(("entry", "exit", "tokens", "brackets"), r)) for r in states], deeper))
            yield pd.DataFrame(rows, columns=["doc_id", "language", "first", "last", "states", "deeper"])

    schema = "doc_id bigint, language string, first int, last int, states array<struct<entry string, exit string, tokens string, brackets string>>, deeper int"
    maps = chunks.mapInPandas(summarise, schema)
    whole = maps.groupBy("doc_id", "language").agg(F.collect_list(F.struct("first", "last", "states", "deeper")).alias("parts"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            valid = []
            for language, parts in zip(b["language"].tolist(), b["parts"].tolist()):
                maps = [(p["first"], p["last"], ([(r["entry"], r["exit"], r["tokens"], r["brackets"]) for r in p["states"]], p["deeper"])) for p in parts]
                valid.append(parses(lexing.whole_file(_joined(maps, language)[0][2]), language))
            yield b[["doc_id"]].assign(valid=valid)

    return whole.mapInPandas(parse, "doc_id bigint, valid boolean")


def invalid_rates(docs: DataFrame, extensions: DataFrame, diagnostics: DataFrame, summaries: DataFrame) -> DataFrame:
    """Per repo and language: files, invalid ones and their share, beside what the analyzer reports.

    n_reported are the files for which any diagnostic names a parse error, whatever the spelling of kind and path;
    n_reported_invalid those among them that are invalid now; files_failed is that of the latest analysis with one.
    A repo or language without files, or files without any analysis, come out with zeros or nulls.
    """
    files = source_files(docs, extensions)
    path = lambda c: F.lower(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"^(\./|/)+", ""))
    reported = (
        diagnostics.where(F.upper(F.trim("kind")).endswith("PARSE_ERROR") & F.col("file_path").isNotNull())
        .select("repo", path("file_path").alias("path"))
        .distinct()
        .withColumn("reported", F.lit(True))
    )
    checked = files.select("doc_id", "repo", "language", path("file_path").alias("path")).join(checked_files(files), "doc_id").join(reported, ["repo", "path"], "left")
    rates = checked.groupBy("repo", "language").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(~F.col("valid")).alias("n_invalid"),
        F.count_if("reported").alias("n_reported"),
        F.count_if(F.col("reported") & ~F.col("valid")).alias("n_reported_invalid"),
    )
    latest = summaries.where("files_failed IS NOT NULL").groupBy("repo", "language").agg(F.max_by("files_failed", F.struct("finished_at", "request_id")).alias("files_failed"))
    zero = {c: 0 for c in ("n_files", "n_invalid", "n_reported", "n_reported_invalid")}
    both = rates.join(latest, ["repo", "language"], "full").fillna(zero)
    return both.withColumn("invalid_share", F.when(F.col("n_files") > 0, F.col("n_invalid") / F.col("n_files")))
