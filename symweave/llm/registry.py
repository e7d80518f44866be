"""Queries of the problems tagged llm and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symweave.llm import garbling, packing, percentiles, sources, tokens
from symweave.tables import table


def p1_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return percentiles.percentiles(table(spark, folder, "performance_runs"))


def p1_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """The daily sketches, from which any further combination can be merged."""
    return percentiles.daily_sketches(table(spark, folder, "performance_runs"))


def p1_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """How many percentiles lie outside their stated bound, against the exact ranks of all values."""
    return percentiles.bound_report(table(spark, folder, "performance_runs"))


def p1_small_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The percentiles of days with so few values that they are exact."""
    found = percentiles.percentiles_of(percentiles.daily_sketches(table(spark, folder, "performance_runs")))
    return found.where("n < 192").selectExpr("fixture", "CAST(day AS STRING) AS day", "metric", "n", *percentiles.NAMES, "exact")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    files = sources.source_files(table(spark, folder, "documents"), table(spark, folder, "file_extensions"))
    return sources.checked_files(files).where("NOT valid").select("doc_id")


def p5_rates(spark: SparkSession, folder: str) -> DataFrame:
    names = ("documents", "file_extensions", "analyzer_diagnostics", "analysis_summaries")
    return sources.invalid_rates(*(table(spark, folder, n) for n in names))


def p5_reported(spark: SparkSession, folder: str) -> DataFrame:
    """The side of p5_rates that the analyzer reports, and the files it speaks of."""
    return p5_rates(spark, folder).select("repo", "language", "n_files", "n_reported", "files_failed")


def p5_data_files(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each JSON file is valid."""
    files = sources.source_files(table(spark, folder, "documents"), table(spark, folder, "file_extensions"))
    return sources.checked_files(files.where("language = 'json'"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, folder, "documents"))


def p6_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """The texts, read back from their ids, in the form of their length and hash."""
    decoded = tokens.decode_corpus(p6_ids(spark, folder), tokens.piece_table(spark))
    return decoded.selectExpr("doc_id", "CAST(char_length(text) AS BIGINT) AS n_chars", "md5(text) AS digest")


def p6_decoded_rare(spark: SparkSession, folder: str) -> DataFrame:
    """As p6_decoded, with only the thousand most frequent words broadcast, so that most words take the shuffled join."""
    encoded = tokens.encode_corpus(table(spark, folder, "documents"), head=1000)
    decoded = tokens.decode_corpus(encoded, tokens.piece_table(spark))
    return decoded.selectExpr("doc_id", "CAST(char_length(text) AS BIGINT) AS n_chars", "md5(text) AS digest")


def p7_packs(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_corpus(table(spark, folder, "documents"), table(spark, folder, "pack_budgets"))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(p7_packs(spark, folder), table(spark, folder, "pack_budgets"))


def p7_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What would be wrong with the packs, counted."""
    return packing.check_report(p7_packs(spark, folder), table(spark, folder, "documents"), table(spark, folder, "pack_budgets"))


def p7_locality(spark: SparkSession, folder: str) -> DataFrame:
    return packing.locality_report(p7_packs(spark, folder), table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return garbling.garbled_texts(table(spark, folder, "documents")).select("doc_id").distinct()


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Each garbled text with its chains, its original as far as it can be restored, and whether all of it could."""
    found = garbling.garbled_texts(table(spark, folder, "documents"), with_text=True)
    return found.selectExpr(
        "doc_id", "array_sort(array_distinct(transform(stretches, s -> array_join(s.chain, ' ')))) AS chains",
        "size(stretches) AS n_stretches", "forall(stretches, s -> s.original IS NOT NULL) AS complete", "restored AS text",
    )


QUERIES = {
    f.__name__: f
    for f in (
        p1_percentiles, p1_sketches, p1_bounds, p1_small_groups, p5_found, p5_rates, p5_reported, p5_data_files, p6_ids, p6_decoded, p6_decoded_rare, p7_packs, p7_fill, p7_checks, p7_locality, p8_found, p8_restored,
    )
}

_DIGESTS = "SELECT doc_id, length(coalesce(text, '')) AS n_chars, md5(coalesce(text, '')) AS digest FROM documents"

_RUNS = """WITH latest AS (
    SELECT replace(lower(trim(fixture)), '_', '-') AS fixture, CAST(measured_at AS DATE) AS day, total_index_ms, parsing_ms FROM (
      SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY reported_at DESC NULLS LAST, total_index_ms DESC NULLS LAST, parsing_ms DESC NULLS LAST, replace(lower(trim(fixture)), '_', '-') DESC NULLS LAST) AS nth
      FROM performance_runs WHERE run_id IS NOT NULL) WHERE nth = 1),
  measured AS (SELECT fixture, day, 'total_index_ms' AS metric, total_index_ms AS value FROM latest WHERE total_index_ms >= 0 UNION ALL SELECT fixture, day, 'parsing_ms', parsing_ms FROM latest WHERE parsing_ms >= 0)"""

_SHARES = ", ".join(f"max(CASE WHEN nth = greatest(CAST(ceil({share} * n - 1e-9) AS BIGINT), 1) THEN value END) AS {name}" for share, name in zip(percentiles.PERCENTILES, percentiles.NAMES))

_FILES = """WITH files AS (
    SELECT d.doc_id, d.repo, e.language, coalesce(d.text, '') AS text, lower(regexp_replace(replace(d.file_path, '\\', '/'), '^(\\./|/)+', '')) AS path
    FROM documents d JOIN (SELECT DISTINCT lower(ltrim(extension, '.')) AS extension, language FROM file_extensions) e ON e.extension = lower(regexp_extract(d.file_path, '[^.]*$'))
    WHERE doc_kind = 'source' AND file_path IS NOT NULL AND language IN ('java', 'rust', 'json', 'toml'))"""

SQL = {
    "p1_bounds": f"""{_RUNS}, l AS (SELECT 'day' AS level, fixture, day, metric FROM measured UNION ALL SELECT 'fixture', fixture, NULL, metric FROM measured),
        k AS (SELECT level, fixture, day, metric, count(*) AS n FROM l GROUP BY ALL)
        SELECT level, metric, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_values, CAST(0 AS BIGINT) AS n_outside, CAST(0 AS BIGINT) AS n_uneven FROM k GROUP BY ALL""",
    "p1_small_groups": f"""{_RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY fixture, day, metric ORDER BY value) AS nth, count(*) OVER (PARTITION BY fixture, day, metric) AS n FROM measured)
        SELECT fixture, CAST(day AS VARCHAR) AS day, metric, n, {_SHARES}, true AS exact FROM r WHERE n < 192 GROUP BY fixture, day, metric, n""",
    "p5_reported": f"""{_FILES}, reported AS (SELECT DISTINCT repo, lower(regexp_replace(replace(file_path, '\\', '/'), '^(\\./|/)+', '')) AS path FROM analyzer_diagnostics WHERE upper(trim(kind)) LIKE '%PARSE_ERROR' AND file_path IS NOT NULL),
        a AS (SELECT f.repo, f.language, count(*) AS n_files, count(r.path) AS n_reported FROM files f LEFT JOIN reported r USING (repo, path) GROUP BY ALL),
        s AS (SELECT repo, language, files_failed FROM (SELECT *, row_number() OVER (PARTITION BY repo, language ORDER BY finished_at DESC, request_id DESC) AS nth FROM analysis_summaries WHERE files_failed IS NOT NULL) WHERE nth = 1)
        SELECT repo, language, coalesce(n_files, 0) AS n_files, coalesce(n_reported, 0) AS n_reported, files_failed FROM a FULL JOIN s USING (repo, language)""",
    # The database also reads trailing commas and numbers without a value, which JSON doesn't have: they are looked for outside of strings.
    "p5_data_files": f"""{_FILES}, j AS (SELECT doc_id, text, regexp_replace(text, '"(?:[^"\\\\]|\\\\.)*"', 's', 'g') AS bare FROM files WHERE language = 'json')
        SELECT doc_id, json_valid(text) AND NOT regexp_matches(bare, ',[ \\t\\r\\n]*[\\]}}]|[nN]a[nN]|[iI]nf') AS valid FROM j""",
    "p6_decoded": _DIGESTS,
    "p6_decoded_rare": _DIGESTS,
    "p7_checks": "SELECT CAST(budget_id AS BIGINT) AS budget_id, (SELECT count(*) FROM documents) AS n_texts, CAST(0 AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_gaps, CAST(0 AS BIGINT) AS n_split, CAST(0 AS BIGINT) AS n_above FROM pack_budgets WHERE capacity_tokens > 0",
}
