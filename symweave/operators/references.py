"""References to records that do not exist (problem 2).

Each reference (a key, a period, a moment) is held against the validity intervals of the referenced records. A moment
is covered by an interval that began in an earlier period exactly if the latest end among those intervals lies after
it, so the records shrink to one row per key, with one element for each period in which a version began. References are
pre-aggregated per key (as its hash) and period. Keys with more than a thousandth of all references are heavy: there are fewer than a
thousand of them, their validity is broadcast and their references stay where they are. All other keys go through a
shuffled anti-join, and both orphan sets are united.

Only a reference in the very period in which a version of its key began can need the versions themselves. Those few are
put in order with the versions, minute by minute, so that no key, however hot, is in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symweave.session import cut

#: A key with at least this share of all references is heavy; so there are at most 1 / HEAVY_SHARE heavy keys.
HEAVY_SHARE = 0.001
FAR = "TIMESTAMP_NTZ '9999-12-31 00:00:00'"


def reference_rows(edges: DataFrame) -> DataFrame:
    """(edge_id, side, project, ref, at, day) for each endpoint that is not null."""
    ends = F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_stable_id").alias("ref")) for s in ("source", "target")))
    return (
        edges.select("edge_id", "project", F.col("loaded_at").cast("timestamp_ntz").alias("at"), F.explode(ends).alias("end"))
        .where("end.ref IS NOT NULL")
        .select("edge_id", "end.side", "project", "end.ref", "at", F.to_date("at").alias("day"))
    )


def _versions(nodes: DataFrame) -> DataFrame:
    """(project, ref, begins, ends, day): the non-empty validity intervals, an open end as a far one."""
    return (
        nodes.select(
            "project",
            F.col("stable_id").alias("ref"),
            F.col("loaded_at").cast("timestamp_ntz").alias("begins"),
            F.coalesce(F.col("deleted_at").cast("timestamp_ntz"), F.expr(FAR)).alias("ends"),
        )
        .where("project IS NOT NULL AND ref IS NOT NULL AND begins < ends")
        .withColumn("day", F.to_date("begins"))
    )


KEY = ["project", "ref"]


def _per_period(refs: DataFrame) -> DataFrame:
    """(project, side, ref, day, n): the references of each key and period."""
    return refs.groupBy(*KEY, "side", "day").agg(F.count(F.lit(1)).alias("n"))


def _heavy_keys(refs: DataFrame, n_references: int, share: float) -> DataFrame:
    """(h): the hashes of the keys with at least the share of all references, so at most 1 / share of them."""
    per_period = refs.groupBy(_hash().alias("h"), "day").agg(F.count(F.lit(1)).alias("n"))
    return per_period.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2, int(n_references * share))).select("h")


def _hash() -> F.Column:
    return F.xxhash64(*KEY)


def _periods(versions: DataFrame) -> DataFrame:
    """(project, ref, periods): for each period in which versions of the key began, their latest end; bounded by the calendar."""
    per_day = versions.groupBy(*KEY, "day").agg(F.max("ends").alias("ends"))
    return per_day.groupBy(*KEY).agg(F.collect_list(F.struct("day", "ends")).alias("periods"))


def _open(rows: DataFrame) -> DataFrame:
    """The references that no version from an earlier period covers, with maybe: whether a version of their key began
    in their own period."""
    earlier = F.array_max(F.transform(F.filter("periods", lambda p: p.day < F.col("day")), lambda p: p.ends))
    same_day = F.coalesce(F.exists("periods", lambda p: p.day == F.col("day")), F.lit(False))
    return rows.withColumn("maybe", same_day).where(~F.coalesce(earlier > F.col("at"), F.lit(False))).drop("periods")


def _uncovered(maybe: DataFrame, versions: DataFrame) -> DataFrame:
    """Those of the references that no version of their own period covers either.

    Versions and references of a key are put in order within each minute. What covers from the minutes before is the
    latest end up to there, from one row for each minute, of which a day has no more than 1,440.
    """
    minute = lambda c: (60 * F.hour(c) + F.minute(c)).cast("int")
    timed = maybe.withColumn("minute", minute("at"))
    begun = versions.withColumn("minute", minute("begins"))
    never, no_row = F.lit(None).cast("timestamp_ntz"), F.lit(None).cast(maybe.schema.simpleString())
    by = [*KEY, "day", "minute"]
    marks = begun.groupBy(*by).agg(F.max("ends").alias("ends")).unionByName(timed.select(*by).distinct().withColumn("ends", never))
    so_far = F.max("ends").over(Window.partitionBy(*KEY, "day").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1))
    carried = marks.groupBy(*by).agg(F.max("ends").alias("ends")).withColumn("ends", so_far).where("ends IS NOT NULL")
    events = (
        carried.select(*by, never.alias("moment"), "ends", no_row.alias("row"))
        .unionByName(begun.select(*by, F.col("begins").alias("moment"), "ends", no_row.alias("row")))
        .unionByName(timed.select(*by, F.col("at").alias("moment"), never.alias("ends"), F.struct(*maybe.columns).alias("row")))
    )
    # At one moment versions come before references: a version is valid from its beginning on.
    order = Window.partitionBy(*by).orderBy(F.asc_nulls_first("moment"), F.col("row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    swept = events.withColumn("until", F.max("ends").over(order)).where("row IS NOT NULL AND NOT coalesce(until > moment, false)")
    return swept.select("row.*")


def _orphans(edges: DataFrame, nodes: DataFrame, heavy_share: float) -> DataFrame:
    """As orphan_references, with heavy: whether the key is heavy (null if not)."""
    refs, versions = reference_rows(edges), _versions(nodes)
    periods = _periods(versions)
    heavy = _heavy_keys(refs, 2 * edges.count(), heavy_share)
    heavy = F.broadcast(heavy.withColumn("heavy", F.lit(True)))
    marked = refs.withColumn("h", _hash()).join(heavy, "h", "left").drop("h")
    hot_periods = F.broadcast(periods.withColumn("h", _hash()).join(heavy, "h", "left_semi").drop("h"))
    hot = marked.where("heavy").join(hot_periods, KEY, "left")
    others = marked.where("heavy IS NULL").join(periods, KEY, "left")
    left = cut(_open(hot.unionByName(others)))
    return left.where("NOT maybe").drop("maybe").unionByName(_uncovered(left.where("maybe").drop("maybe"), versions))


def orphan_references(edges: DataFrame, nodes: DataFrame, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """(edge_id, side, project, ref, at, day) of each reference without a record that is valid at its moment.

    A record is valid from loaded_at, included, until deleted_at, excluded. Null references are no references; a
    reference with a null project or a null moment has no valid record. Repeated rows of records make no
    difference, each repeated row of a reference comes out, and further columns of either input are ignored.
    """
    return _orphans(edges, nodes, heavy_share).drop("heavy")


def orphan_counts(edges: DataFrame, nodes: DataFrame, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """Per project, side and day: the references, those without a valid record, and the missing keys.

    Days are those of the edge's loaded_at, null for a null moment. Days without orphans come out with zero. The counts
    of heavy keys and of all others are united.
    """
    by = ["project", "side", "day"]
    zero = F.lit(0).cast("bigint")
    counts = _per_period(reference_rows(edges)).groupBy(*by).agg(F.sum("n").alias("n_references"), zero.alias("n_orphans"), zero.alias("n_missing_keys"))
    lost = _orphans(edges, nodes, heavy_share)
    for part in (lost.where("heavy"), lost.where("heavy IS NULL")):
        counts = counts.unionByName(_per_period(part).groupBy(*by).agg(zero.alias("n_references"), F.sum("n").alias("n_orphans"), F.count(F.lit(1)).alias("n_missing_keys")))
    return counts.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("n_references", "n_orphans", "n_missing_keys")))
