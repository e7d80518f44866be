"""Percentiles of very large numeric columns (problem 1).

A sketch holds levels of values; a value of level h stands for 2 ** h of them. When a level is full, its smaller part
is compacted: every second value of it moves one level up. How much of the level stays untouched follows the number
of its compactions so far, so the largest values are hardly ever thinned and the rank error shrinks towards the upper
tail in proportion to the distance from it. Percentiles below the median come from a second sketch, of the negated
values, as soon as the first one was compacted. Sketches of parts, days or fixtures are merged level by level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.session import cut

#: Values of a section, and sections of a level at first; a level holds up to twice that.
SECTION, SECTIONS = 32, 3
PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999)
NAMES = tuple(f"p{100 * p:g}".replace(".", "_") for p in PERCENTILES)
METRICS = ("total_index_ms", "parsing_ms")
#: Relative standard error of the distance from the nearer tail in a sketch that was compacted: FACTOR / SECTION; three of them are stated as the bound.
FACTOR = 0.15
#: Parts of a key that are merged by one task before the others' results are.
FAN_IN = 64

#: Stands for null within a partition.
NULL = "\x01null"

Levels = list[np.ndarray]
Side = tuple[Levels, list[int]]
#: The sketch that spares large values, and the one of the negated values, which is None while the first was never compacted.
Sketch = tuple[Side, Side | None]


def _limit(compactions: int) -> tuple[int, int]:
    """Sections and section size of a level after so many compactions: more and smaller sections as they add up."""
    sections, size = SECTIONS, float(SECTION)
    while compactions >= 1 << (sections - 1) and size / 2**0.5 >= 4:
        sections, size = sections * 2, size / 2**0.5
    return sections, 2 * int(round(size / 2))


def compact(levels: Levels, counts: list[int]) -> Side:
    """One side of a sketch with no level above its limit. counts are the compactions of each level, and are kept up."""
    h = 0
    while h < len(levels):
        sections, size = _limit(counts[h])
        if len(levels[h]) >= 2 * sections * size:
            values = np.sort(levels[h], kind="stable")
            # Of the lower half of the sections' room, as many sections as the count has trailing ones, and one more.
            ones = (~counts[h] & (counts[h] + 1)).bit_length() - 1
            kept = sections * size + max(0, sections - 1 - ones) * size
            n = (len(values) - kept) & ~1
            # A pair of compactions takes opposite halves; which comes first follows the number of pairs.
            odd = ((counts[h] >> 1) * 0x9E3779B1 >> 16 ^ counts[h]) & 1
            if h + 1 == len(levels):
                levels, counts = [*levels, values[:0]], [*counts, 0]
            levels[h + 1] = np.concatenate([levels[h + 1], values[odd:n:2]])
            levels[h], counts[h] = values[n:], counts[h] + 1
        h += 1
    return levels, counts


def merge(a: Side, b: Side) -> Side:
    """One side of what both stand for; the counts join so that no schedule starts anew."""
    n = max(len(a[0]), len(b[0]))
    none = np.zeros(0, dtype=np.int64)
    at = lambda s, h: s[0][h] if h < len(s[0]) else none
    count = lambda s, h: s[1][h] if h < len(s[1]) else 0
    return compact([np.concatenate([at(a, h), at(b, h)]) for h in range(n)], [count(a, h) | count(b, h) for h in range(n)])


def sketch(values: np.ndarray) -> Sketch:
    upper = compact([values], [0])
    return upper, compact([-values], [0]) if len(upper[0]) > 1 else None


def lower(s: Sketch) -> Side:
    """The side of the negated values."""
    return s[1] or ([-v for v in s[0][0]], s[0][1])


def combine(a: Sketch, b: Sketch) -> Sketch:
    """One sketch of what both stand for. Both sides hold as many values, so they are compacted at the same time."""
    upper = merge(a[0], b[0])
    return upper, merge(lower(a), lower(b)) if len(upper[0]) > 1 else None


def _at_ranks(levels: Levels, ranks: np.ndarray) -> np.ndarray:
    """The value of least rank at or above each rank, counted from 1."""
    values = np.concatenate(levels)
    weights = np.concatenate([np.full(len(v), 1 << h, dtype=np.int64) for h, v in enumerate(levels)])
    order = np.argsort(values, kind="stable")
    at = np.searchsorted(np.cumsum(weights[order]), ranks, side="left")
    return values[order][np.minimum(at, len(values) - 1)]


def quantiles(s: Sketch, shares: tuple[float, ...] = PERCENTILES) -> list[int]:
    """The value of least rank at or above share * n, for each share, from the side whose tail is nearer."""
    n = sum(len(v) << h for h, v in enumerate(s[0][0]))
    ranks = np.maximum(np.ceil(np.array(shares) * n - 1e-9), 1).astype(np.int64)
    return np.where(np.array(shares) < 0.5, -_at_ranks(lower(s)[0], n + 1 - ranks), _at_ranks(s[0][0], ranks)).tolist()


def measurements(runs: DataFrame) -> DataFrame:
    """(fixture, day, values): each run once, as it was reported last.

    A fixture's name is compared without case, surrounding spaces, and with hyphens for underscores; null is a
    fixture of its own. A run reported twice counts as its latest row, ties by the larger values. Null and negative
    values are no measurements; day is that of measured_at, or null.
    """
    name = F.translate(F.lower(F.trim("fixture")), "_", "-")
    latest = runs.where("run_id IS NOT NULL").groupBy("run_id").agg(
        F.max_by(F.struct(name.alias("fixture"), F.to_date("measured_at").alias("day"), *METRICS), F.struct("reported_at", *METRICS, name)).alias("r")
    )
    valid = [F.when(F.col(f"r.{m}") >= 0, F.col(f"r.{m}")).alias(m) for m in METRICS]
    return latest.select("r.fixture", "r.day", *valid)


_KEYS = ["fixture", "day", "metric"]
_SIDES = ("levels", "counts", "low_levels", "low_counts")
_SCHEMA = "fixture string, day date, metric string, part int, n bigint, levels array<array<bigint>>, counts array<bigint>, low_levels array<array<bigint>>, low_counts array<bigint>"


def _rows(keys: list[tuple], sketches: list[Sketch]) -> pd.DataFrame:
    frame = pd.DataFrame(keys, columns=[*_KEYS, "part"], dtype=object)
    frame["n"] = pd.Series([sum(len(v) << h for h, v in enumerate(s[0][0])) for s in sketches], dtype="int64")
    for i, (levels, counts) in enumerate((_SIDES[:2], _SIDES[2:])):
        frame[levels] = pd.Series([[v.tolist() for v in s[i][0]] if s[i] else None for s in sketches], dtype=object)
        frame[counts] = pd.Series([list(s[i][1]) if s[i] else None for s in sketches], dtype=object)
    return frame


def _sketch_of(levels, counts, low_levels, low_counts) -> Sketch:
    side = lambda ls, cs: ([np.asarray(v, dtype=np.int64) for v in ls], [int(c) for c in cs])
    return side(levels, counts), None if low_levels is None else side(low_levels, low_counts)


def partial_sketches(values: DataFrame) -> DataFrame:
    """One row of _SCHEMA for each fixture, day and metric of each partition; nothing is shuffled. part numbers groups of FAN_IN partitions."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketches: dict[tuple, Sketch] = {}
        group = TaskContext.get().partitionId() // FAN_IN
        for b in batches:
            codes, keys = pd.MultiIndex.from_arrays([b["fixture"].fillna(NULL), b["day"].fillna(NULL)]).factorize()
            for metric in METRICS:
                column = b[metric].to_numpy(dtype=np.int64)
                own = np.flatnonzero(column >= 0)
                order = own[np.argsort(codes[own], kind="stable")]
                starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
                for part in np.split(order, starts[1:]) if len(order) else []:
                    fixture, day = keys[codes[part[0]]]
                    key = (None if fixture == NULL else fixture, None if day == NULL else day, metric, group)
                    new = sketch(column[part])
                    sketches[key] = combine(sketches[key], new) if key in sketches else new
        yield _rows(list(sketches), list(sketches.values()))

    return values.withColumns({m: F.coalesce(m, F.lit(-1)).cast("bigint") for m in METRICS}).mapInPandas(build, _SCHEMA)


def merged_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of rows of _SCHEMA merged by some of its keys, with part or without; the other keys become null.

    Sketches are bounded, so a group takes no more than the number of its parts; they are merged in a fixed order as
    they stream by, and never gathered.
    """
    types = {"fixture": "string", "day": "date", "metric": "string", "part": "int"}
    keyed = sketches.select(*(F.col(k) if k in by else F.lit(None).cast(t).alias(k) for k, t in types.items()), "n", *_SIDES)
    sorted_parts = keyed.repartition(*by).sortWithinPartitions(*by, "n", F.xxhash64("levels"))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, whole = None, None
        for b in batches:
            keys, sketches = [], []
            for *own, levels, counts, low_levels, low_counts in zip(*(b[k].astype(object).where(b[k].notna(), None) for k in types), *(b[c] for c in _SIDES)):
                new = _sketch_of(levels, counts, low_levels, low_counts)
                if whole is not None and own == key:
                    whole = combine(whole, new)
                    continue
                if whole is not None:
                    keys.append(tuple(key))
                    sketches.append(whole)
                key, whole = own, new
            yield _rows(keys, sketches)
        if whole is not None:
            yield _rows([tuple(key)], [whole])

    return sorted_parts.mapInPandas(join, _SCHEMA)


def daily_sketches(runs: DataFrame) -> DataFrame:
    """The combinable form: one sketch for each fixture, day and metric, merged from the partitions' in two steps."""
    groups = merged_sketches(partial_sketches(measurements(runs)), [*_KEYS, "part"])
    return merged_sketches(groups, _KEYS)


def percentiles_of(sketches: DataFrame) -> DataFrame:
    """(fixture, day, metric, n, p.., exact, rank_error) of rows of _SCHEMA.

    rank_error is the stated bound: with three standard errors, the rank share of the value given for share p differs
    from p by no more than rank_error * min(p, 1 - p), or by one value. It is 0 where nothing was compacted.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [quantiles(_sketch_of(*own)) for own in zip(*(b[c] for c in _SIDES))]
            exact = [len(levels) == 1 for levels in b["levels"]]
            frame = pd.DataFrame(found, columns=NAMES, dtype="int64")
            yield pd.concat([b[[*_KEYS, "n"]].reset_index(drop=True), frame], axis=1).assign(exact=exact, rank_error=[0.0 if e else 3 * FACTOR / SECTION for e in exact])

    columns = ", ".join(f"{n} bigint" for n in NAMES)
    return sketches.mapInPandas(read, f"fixture string, day date, metric string, n bigint, {columns}, exact boolean, rank_error double")


def percentiles(runs: DataFrame) -> DataFrame:
    """The percentiles of each fixture and day, and of each fixture as a whole (level 'fixture', a null day).

    The daily sketches are computed once; the fixtures' ones are merged from them.
    """
    daily = cut(daily_sketches(runs))
    whole = merged_sketches(daily, ["fixture", "metric"])
    return percentiles_of(daily).withColumn("level", F.lit("day")).unionByName(percentiles_of(whole).withColumn("level", F.lit("fixture")))


def bound_report(runs: DataFrame, salts: int = 16) -> DataFrame:
    """(level, metric, n_keys, n_values, n_outside, n_uneven): the percentiles held against the exact ranks of all values.

    n_outside counts the percentiles outside their stated bound, n_uneven the keys whose n isn't that of their values.
    The values of a key are split by a hash, with its percentiles repeated for each salt, so a hot key is in no one task.
    """
    found = cut(percentiles(runs))
    levels = F.array(F.struct(F.lit("day").alias("level"), F.col("day").alias("day")), F.struct(F.lit("fixture").alias("level"), F.lit(None).cast("date").alias("day")))
    metrics = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS))
    values = measurements(runs).select("fixture", F.explode(levels).alias("l"), metrics.alias("m")).select("fixture", "l.*", F.explode("m").alias("m")).select("fixture", "level", "day", "m.*").where("value IS NOT NULL")
    salted = values.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts).cast("bigint")))
    key = ["level", "metric", "salt"]
    own = found.select("level", "metric", F.col("fixture").alias("f"), F.col("day").alias("d"), F.array(*NAMES).alias("est"), "n", "rank_error", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")).alias("salt"))
    met = salted.join(own.select(*key, "f", "d", "est"), (salted.fixture.eqNullSafe(own.f)) & (salted.day.eqNullSafe(own.d)) & (salted.level == own.level) & (salted.metric == own.metric) & (salted.salt == own.salt))
    below = [F.count_if(salted.value < F.col("est")[i]).alias(f"lt{i}") for i in range(len(NAMES))]
    upto = [F.count_if(salted.value <= F.col("est")[i]).alias(f"le{i}") for i in range(len(NAMES))]
    ranks = met.groupBy(salted.level.alias("level"), salted.metric.alias("metric"), "f", "d").agg(F.count(F.lit(1)).alias("n_values"), *below, *upto)
    both = found.select("level", "metric", F.col("fixture").alias("f2"), F.col("day").alias("d2"), "n", "rank_error")
    joined = both.join(ranks.withColumnsRenamed({"level": "l2", "metric": "m2"}), (F.col("level") == F.col("l2")) & (F.col("metric") == F.col("m2")) & F.col("f2").eqNullSafe(F.col("f")) & F.col("d2").eqNullSafe(F.col("d")), "left")
    outside = F.lit(0)
    for i, share in enumerate(PERCENTILES):
        target = F.greatest(F.ceil(F.lit(share) * F.col("n") - 1e-9), F.lit(1))
        tail = target if share < 0.5 else F.col("n") + 1 - target
        error = F.greatest(F.col(f"lt{i}") + 1 - target, target - F.col(f"le{i}"), F.lit(0))
        outside = outside + F.when(F.col("rank_error") == 0, (error > 0).cast("int")).otherwise((error > F.greatest(F.lit(1.0), F.col("rank_error") * tail)).cast("int"))
    return joined.groupBy("level", "metric").agg(
        F.count(F.lit(1)).alias("n_keys"), F.sum("n_values").alias("n_values"), F.sum(outside.cast("bigint")).alias("n_outside"), F.count_if(~F.col("n").eqNullSafe(F.col("n_values"))).alias("n_uneven")
    )
