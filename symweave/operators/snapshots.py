"""What changed between full snapshots (problem 3).

Gaps and islands: the rows of a key in consecutive complete snapshots with the same content form one validity
interval. The start of an interval right after another one is a change, any other start an addition, and an end
without a following interval a removal. Everything after the scan runs on one partitioning by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COMPLETE = ("READY", "STALE")
JSON_COLUMNS = ("metadata_json", "unresolved_json")


def complete_generations(generations: DataFrame) -> DataFrame:
    """(project_id, generation, prior, following): the complete generations and their neighbours in order."""
    order = Window.partitionBy("project_id").orderBy("generation")
    return (
        generations.where(F.col("state").isin(*COMPLETE) & F.col("project_id").isNotNull() & F.col("generation").isNotNull())
        .select("project_id", "generation")
        .distinct()
        .select("*", F.lag("generation").over(order).alias("prior"), F.lead("generation").over(order).alias("following"))
    )


def canonical_json(column: str) -> F.Column:
    """The JSON value as text in one spelling (members in order of name); text that is no JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(column)), F.concat(F.lit("text:"), F.col(column)))


def content_hash(columns: list[str]) -> list[F.Column]:
    """Two independent 64-bit hashes of the named columns; null differs from every value."""
    parts: list[F.Column] = []
    for c in columns:
        value = canonical_json(c) if c in JSON_COLUMNS else F.col(c)
        parts += [value.isNull(), value]
    return [F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(17), *reversed(parts)).alias("h2")]


def validity_intervals(nodes: DataFrame, generations: DataFrame) -> DataFrame:
    """(project_id, stable_id, island, first, last, prior, following, h1, h2) for each interval of equal content.

    first and last are generations; prior is the complete generation before first, following the one after last,
    null where there is none. Rows delivered twice count once; if the rows of a key within one snapshot really
    differ, the set of them is its content. Rows without project, generation or stable_id have no key and are left
    out, as are those of incomplete generations.
    """
    compared = sorted(c for c in nodes.columns if c not in ("project_id", "generation", "stable_id"))
    hashed = nodes.where("stable_id IS NOT NULL").select("project_id", "generation", "stable_id", *content_hash(compared))
    rows = hashed.join(complete_generations(generations), ["project_id", "generation"]).repartition("project_id", "stable_id")
    whole = (
        rows.groupBy("project_id", "stable_id", "generation", "prior", "following", "h1", "h2").agg(F.lit(1).alias("one"))
        .groupBy("project_id", "stable_id", "generation", "prior", "following")
        .agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"), F.count(F.lit(1)).alias("variants"))
    )
    w = Window.partitionBy("project_id", "stable_id").orderBy("generation")
    same = (
        (F.lag("generation").over(w) == F.col("prior")) & (F.lag("h1").over(w) == F.col("h1"))
        & (F.lag("h2").over(w) == F.col("h2")) & (F.lag("variants").over(w) == F.col("variants"))
    )
    islands = whole.withColumn("begins", F.when(same, 0).otherwise(1)).withColumn("island", F.sum("begins").over(w))
    return islands.groupBy("project_id", "stable_id", "island").agg(
        F.min("generation").alias("first"),
        F.max("generation").alias("last"),
        F.min_by("prior", "generation").alias("prior"),
        F.max_by("following", "generation").alias("following"),
        F.first("h1").alias("h1"),
        F.first("h2").alias("h2"),
    )


def snapshot_changes(nodes: DataFrame, generations: DataFrame) -> DataFrame:
    """(project_id, generation, stable_id, change) between each two consecutive complete snapshots.

    change is added, removed or changed; generation is the later snapshot. The first complete snapshot of a project
    gives no event. A complete snapshot without rows removes every key of the one before it.
    """
    w = Window.partitionBy("project_id", "stable_id").orderBy("island")
    near = validity_intervals(nodes, generations).select(
        "project_id", "stable_id", "first", "prior", "following",
        (F.lag("last").over(w) == F.col("prior")).alias("adjacent"),
        (F.lead("first").over(w) == F.col("following")).alias("continued"),
    )
    start = F.when(
        F.col("prior").isNotNull(),
        F.struct(F.col("first").alias("generation"), F.when(F.col("adjacent"), "changed").otherwise("added").alias("change")),
    )
    end = F.when(
        F.col("following").isNotNull() & ~F.coalesce("continued", F.lit(False)),
        F.struct(F.col("following").alias("generation"), F.lit("removed").alias("change")),
    )
    return (
        near.select("project_id", "stable_id", F.explode(F.array(start, end)).alias("event"))
        .where("event IS NOT NULL")
        .select("project_id", "event.generation", "stable_id", "event.change")
    )
