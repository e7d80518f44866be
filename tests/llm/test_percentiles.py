import numpy as np
import pytest

from symweave.llm import percentiles as p


@pytest.mark.parametrize("shape", ["uniform", "sorted", "skewed", "ties"])
def test_rank_errors_stay_within_the_bound(shape):
    rng = np.random.default_rng(5)
    values = {"uniform": rng.integers(0, 1 << 40, 60_000), "sorted": np.arange(60_000), "skewed": (rng.pareto(0.7, 60_000) * 1000).astype(np.int64), "ties": rng.integers(0, 50, 60_000)}[shape]
    parts = [p.sketch(part.astype(np.int64)) for part in np.array_split(values, 37)]
    whole = parts[0]
    for part in parts[1:]:
        whole = p.combine(whole, part)
    for levels in (whole[0][0], whole[1][0]):
        assert sum(len(v) << h for h, v in enumerate(levels)) == len(values) and sum(map(len, levels)) < 4000
    ordered = np.sort(values)
    for share, got in zip(p.PERCENTILES, p.quantiles(whole)):
        target = np.ceil(share * len(values))
        low, high = np.searchsorted(ordered, got, "left") + 1, np.searchsorted(ordered, got, "right")
        assert max(low - target, target - high, 0) <= max(1, 3 * p.FACTOR / p.SECTION * min(target, len(values) - target + 1))


def runs(spark, rows):
    return spark.createDataFrame(rows, "run_id long, measured_at timestamp_ntz, reported_at timestamp_ntz, fixture string, total_index_ms long, parsing_ms long, n long, day string, metric string")


def test_measurements_and_small_groups(spark, at):
    rows = [(i, at(1), at(2), "A_b", i, None, 1, "x", "y") for i in range(1, 102)]
    rows += [(1, at(1), at(9), " a-B", 1000, -1, 1, "x", "y"), (200, at(30), at(31), None, 7, 5, 1, "x", "y"), (201, None, at(1), "a-b", -5, 3, 1, "x", "y"), (None, at(1), at(1), "a-b", 9, 9, 1, "x", "y")]
    got = {(r.level, r.fixture, str(r.day), r.metric): r for r in p.percentiles(runs(spark, rows)).collect()}
    day = got["day", "a-b", "2026-03-01", "total_index_ms"]
    assert (day.n, day.p50, day.p99_9, day.exact, day.rank_error) == (101, 52, 1000, True, 0.0)
    assert {k for k in got if k[0] == "day"} == {("day", "a-b", "2026-03-01", "total_index_ms"), ("day", None, "2026-03-02", "total_index_ms"), ("day", None, "2026-03-02", "parsing_ms"), ("day", "a-b", "None", "parsing_ms")}
    assert got["fixture", "a-b", "None", "parsing_ms"].n == 1 and got["fixture", None, "None", "total_index_ms"].p50 == 7


def test_sketches_combine(spark, at):
    rows = [(i, at(24 * (i % 3)), at(99), "f", (i * 7919) % 10_007, 1, 1, "x", "y") for i in range(10_007)]
    daily = p.daily_sketches(runs(spark, rows))
    whole = p.percentiles_of(p.merged_sketches(daily, ["metric"])).where("metric = 'total_index_ms'").first()
    assert whole.n == 10_007 and not whole.exact and abs(whole.p50 - 5003) <= whole.rank_error * 5004 + 1 and abs(whole.p99_9 - 9996) <= 2
    assert abs(whole.p1 - 100) <= 3 and abs(whole.p5 - 500) <= whole.rank_error * 501 + 1
    report = {(r.level, r.metric): r for r in p.bound_report(runs(spark, rows)).collect()}
    assert {(r.n_outside, r.n_uneven) for r in report.values()} == {(0, 0)} and report["fixture", "total_index_ms"].n_values == 10_007 and report["day", "total_index_ms"].n_keys == 3


def test_large_integers_stay_exact(spark, at):
    rows = [(i, at(1), at(2), "f", (1 << 53) + i, 1 if i else None, 1, "x", "y") for i in range(3)]
    got = {r.metric: r for r in p.percentiles(runs(spark, rows)).where("level = 'day'").collect()}
    assert (got["total_index_ms"].p1, got["total_index_ms"].p50, got["total_index_ms"].p99_9) == ((1 << 53), (1 << 53) + 1, (1 << 53) + 2) and got["parsing_ms"].n == 2


def test_empty(spark):
    assert p.percentiles(runs(spark, [])).collect() == [] and p.bound_report(runs(spark, [])).collect() == []
