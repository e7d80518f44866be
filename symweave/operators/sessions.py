"""Scores of answered questions: claims, evidence, and paired sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.functions.names import ascii_lower
from symweave.operators.counts import upper_median


def matched_questions(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """(question_id, category, n_matched, n_expected, passed): which expected claims there are, null keys equal to null."""
    claims = actual.select(*(F.col(k).alias(f"a_{k}") for k in key)).distinct()
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"a_{k}"))
    met = expected.select("question_id", "category", *key).distinct().join(claims.withColumn("met", F.lit(1)), same, "left")
    counted = met.groupBy("question_id", "category").agg(F.count("met").alias("n_matched"), F.count(F.lit(1)).alias("n_expected"))
    return counted.withColumn("passed", F.col("n_matched") == F.col("n_expected"))


def verified_evidence(given: DataFrame, expected: DataFrame) -> DataFrame:
    """(question_id, verified): all given ranges are sound, and each expected one is met by one of the same file.

    Rows are (question_id, file_path, start_line, end_line). Without expected evidence sound ranges are enough; with it
    at least one must be given.
    """
    sound = F.coalesce((F.col("start_line") > 0) & (F.col("end_line") >= F.col("start_line")) & F.col("file_path").isNotNull(), F.lit(False))
    own = given.groupBy("question_id").agg(F.bool_and(sound).alias("sound"))
    wanted = expected.select("question_id", "file_path", F.col("start_line").alias("s"), F.col("end_line").alias("e")).distinct()
    hit = wanted.join(given.where(sound), ["question_id", "file_path"], "left").groupBy("question_id", "file_path", "s", "e").agg(
        F.bool_or(F.coalesce((F.col("start_line") <= F.col("e")) & (F.col("end_line") >= F.col("s")), F.lit(False))).alias("met")
    )
    needs = hit.groupBy("question_id").agg(F.bool_and("met").alias("met"))
    both = own.join(needs, "question_id", "full")
    return both.select("question_id", F.when(F.col("met").isNull(), F.col("sound")).otherwise(F.col("met") & F.coalesce("sound", F.lit(False))).alias("verified"))


def scored_runs(runs: DataFrame, truth: DataFrame) -> DataFrame:
    """(mode, question_id, correct, n_forbidden) of each run: all required claims, no forbidden one, uncertainty where it is due.

    runs are (mode, question_id, answer, claims, uncertainty_reported), truth (question_id, required, forbidden,
    needs_uncertainty). A forbidden claim counts if it is among the claims, whatever the case, or within the answer.
    """
    both = runs.join(truth, "question_id")
    low = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), ascii_lower)
    said = F.filter(low("forbidden"), lambda f: F.array_contains(low("claims"), f) | F.coalesce(F.lower("answer").contains(F.lower(f)), F.lit(False)))
    complete = F.size(F.array_except("required", F.coalesce("claims", F.array().cast("array<string>")))) == 0
    due = ~F.coalesce("needs_uncertainty", F.lit(False)) | F.coalesce("uncertainty_reported", F.lit(False))
    return both.select("mode", "question_id", (complete & (F.size(said) == 0) & due).alias("correct"), F.size(said).alias("n_forbidden"))


def graph_accuracy(expected: DataFrame, forbidden: DataFrame, actual: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """(by, n_expected, n_true, n_missing, n_forbidden, precision, recall) of claims.

    Claims that are neither expected nor forbidden don't count. precision is the share of true ones among true and
    forbidden claims, recall among the expected; a share of nothing is 1. Null keys are equal to null.
    """
    marks = [df.select(*by, *key).distinct().withColumn(name, F.lit(True)) for name, df in (("e", expected), ("f", forbidden), ("a", actual))]
    both = marks[0]
    for m in marks[1:]:
        both = both.unionByName(m, allowMissingColumns=True)
    met = both.groupBy(*by, *key).agg(*(F.bool_or(c).alias(c) for c in "efa"))
    counted = met.groupBy(*by).agg(
        F.count("e").alias("n_expected"), F.count_if(F.col("e") & F.col("a")).alias("n_true"), F.count_if(F.col("e") & F.col("a").isNull()).alias("n_missing"), F.count_if(F.col("f") & F.col("a")).alias("n_forbidden")
    )
    share = lambda n: F.when(n == 0, 1.0).otherwise(F.col("n_true") / n)
    return counted.select("*", share(F.col("n_true") + F.col("n_forbidden")).alias("precision"), share(F.col("n_expected")).alias("recall"))


def session_aggregates(runs: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """(by, n_runs, correctness, n_unsupported, median_..) of runs (by, question_id, correct, n_unsupported, metrics): shares, sums and upper medians."""
    whole = runs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_runs"), (F.count_if("correct") / F.count(F.lit(1))).alias("correctness"), F.sum("n_unsupported").alias("n_unsupported"))
    for m in metrics:
        whole = whole.join(upper_median(runs, by, m).select(*by, F.col("median").alias(f"median_{m}")), by, "left")
    return whole


def compared_sessions(runs: DataFrame, by: list[str], base: str, other: str, targets: dict[str, float]) -> DataFrame:
    """Per group: the upper median of the reduction of each metric from mode base to mode other, over the questions with runs of both, and whether it meets its target.

    runs are (by, question_id, mode, correct, n_unsupported, metrics), one for each question and mode. Pairs without a
    value or with a base of 0 are left out of a metric. The other mode must also be as correct as the base, and
    give no unsupported claim.
    """
    kept = [*by, "question_id", "correct", "n_unsupported", *targets]
    sides = [runs.where(F.col("mode") == m).select(*kept) for m in (base, other)]
    renamed = sides[1].withColumnsRenamed({c: f"o_{c}" for c in kept[len(by) + 1 :]})
    pairs = sides[0].join(renamed, [*by, "question_id"])
    met = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"), (F.count_if("o_correct") >= F.count_if("correct")).alias("no_less_correct"), (F.sum("o_n_unsupported") == 0).alias("none_unsupported"))
    for m, target in targets.items():
        reduction = F.when(F.col(m) != 0, 100.0 * (F.col(m) - F.col(f"o_{m}")) / F.col(m))
        median = upper_median(pairs.select(*by, reduction.alias("reduction")), by, "reduction").select(*by, F.col("median").alias(f"reduction_{m}"))
        met = met.join(median, by, "left").withColumn(f"meets_{m}", F.coalesce(F.col(f"reduction_{m}") >= target, F.lit(False)))
    return met
