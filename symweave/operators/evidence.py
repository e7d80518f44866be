"""Evidence: locations, their identifiers, overlaps, and numbered source lines."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symweave.functions import names


def locations(nodes: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(project, file_path, start_line, end_line): the distinct locations of nodes and of edges' evidence."""
    columns = ["project", "file_path", "start_line", "end_line"]
    return nodes.where("file_path IS NOT NULL").select(*columns).union(occurrences.where("file_path IS NOT NULL").select(*columns)).distinct()


def with_evidence_id(places: DataFrame, generation: int = 1) -> DataFrame:
    """Adds evidence_id, a hash of the generation and the location."""
    text = F.concat_ws("\0", F.lit(str(generation)), "file_path", F.col("start_line").cast("string"), F.col("end_line").cast("string"))
    return places.withColumn("evidence_id", F.concat(F.lit(f"evidence:{generation}:"), names.fnv1a64(text)))


def first_occurrences(occurrences: DataFrame, limit: int) -> DataFrame:
    """The first rows of evidence of each edge, in order of loading."""
    w = Window.partitionBy("project", "source", "target", "kind").orderBy("edge_id", "nth")
    return occurrences.withColumn("ordinal", F.row_number().over(w)).where(F.col("ordinal") <= limit).withColumn("ordinal", F.col("ordinal") - 1)


def overlapping_symbols(nodes: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(project, file_path, start_line, end_line, n_symbols) of each distinct evidence location: the symbols whose lines meet it.

    These are the symbols that begin up to its last line, less those that end before its first one. Both are running sums
    over the lines of a file, so that no range is taken apart and no pair is formed, however long ranges are.
    """
    key = ["project", "file_path"]
    sound = "file_path IS NOT NULL AND start_line > 0 AND end_line >= start_line"
    places = occurrences.where(sound).select(*key, "start_line", "end_line").distinct()
    marks = F.array(F.struct(F.col("start_line").alias("line"), F.lit(1).alias("begun"), F.lit(0).alias("ended")), F.struct(F.col("end_line").alias("line"), F.lit(0).alias("begun"), F.lit(1).alias("ended")))
    asked = F.array(*(F.struct(line.alias("line"), F.lit(0).alias("begun"), F.lit(0).alias("ended")) for line in (F.col("start_line") - 1, F.col("end_line"))))
    at = lambda df, points: df.select(*key, F.explode(points).alias("p")).select(*key, "p.*")
    lines = at(nodes.where(sound), marks).unionByName(at(places, asked)).groupBy(*key, "line").agg(F.sum("begun").alias("begun"), F.sum("ended").alias("ended"))
    upto = Window.partitionBy(*key).orderBy("line")
    sums = lines.select(*key, "line", F.sum("begun").over(upto).alias("begun"), F.sum("ended").over(upto).alias("ended"))
    before = sums.select(*key, (F.col("line") + 1).alias("start_line"), "ended")
    return places.join(sums.select(*key, F.col("line").alias("end_line"), "begun"), [*key, "end_line"]).join(before, [*key, "start_line"]).select(
        *key, "start_line", "end_line", (F.col("begun") - F.col("ended")).alias("n_symbols")
    )


def numbered_lines(references: DataFrame, texts: DataFrame, key: list[str], context: int = 2) -> DataFrame:
    """(key, start_line, end_line, line, text) of the referenced lines and so many around them.

    Lines end with a line feed, a carriage return before it doesn't count, and no empty line follows the last one.
    References beyond the end of a text give fewer lines or none. Only the lines' number goes to the references, which
    are then joined with the lines themselves one by one.
    """
    lines = F.split(F.regexp_replace(F.col("text"), "\r?\n\\z", ""), "\r?\n")
    wanted = references.where("start_line > 0 AND end_line >= start_line").select(*key, "start_line", "end_line").distinct()
    held = texts.where("text IS NOT NULL AND text <> ''").join(wanted.select(*key).distinct(), key, "left_semi").select(*key, lines.alias("lines"))
    sized = wanted.join(held.groupBy(*key).agg(F.max(F.size("lines")).alias("n")), key).where("start_line <= n")
    numbers = F.sequence(F.greatest(F.col("start_line") - context, F.lit(1)), F.least((F.col("end_line").cast("bigint") + context).cast("bigint"), F.col("n").cast("bigint")).cast("int"))
    asked = sized.select(*key, "start_line", "end_line", F.explode(numbers).alias("line"))
    single = held.select(*key, F.posexplode("lines").alias("nth", "text")).select(*key, (F.col("nth") + 1).alias("line"), "text")
    return asked.join(single, [*key, "line"]).select(*key, "start_line", "end_line", "line", "text")


def shared_budget(wants: DataFrame, by: list[str], order: list[str], want: str, budget: int) -> DataFrame:
    """Adds taken: what each row gets of a budget that is used up in order, never more than it wants.

    by and order together tell rows apart. Rows that want nothing, or null, get nothing. As each other row takes one at
    least, no more than the first budget rows of a group can get any; only these are put in order in one task.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    first = wants.where(F.col(want) > 0).select(*by, *order, want).withColumn("budget_nth", F.row_number().over(w)).where(F.col("budget_nth") <= max(budget, 0))
    before = F.coalesce(F.sum(want).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    given = first.select(*(F.col(c).alias(f"g_{c}") for c in [*by, *order]), F.greatest(F.lit(0), F.least(F.col(want), F.lit(budget) - before)).alias("g_taken"))
    same = functools.reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"g_{c}")) for c in [*by, *order]))
    return wants.join(given, same, "left").withColumn("taken", F.coalesce("g_taken", F.lit(0))).select(*wants.columns, "taken")
