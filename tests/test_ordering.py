import math

import numpy as np
import pytest

from gradeflow.operators import ordering as od


def skewed(spark, n=5000):
    """A third of all rows in one group, one value very frequent."""
    return spark.range(n).selectExpr(
        "id", "case when id % 3 = 0 then 0 else id % 50 end as g",
        "cast(case when id % 4 = 0 then 7 else (id * 37) % 1000 end as double) as v", "(id * 7919) % 100003 as o")


@pytest.mark.parametrize("hot_rows", [0, 10**6])
def test_position_is_the_rank(spark, partitions, hot_rows):
    rows = partitions(lambda: od.with_position(
        skewed(spark), ["o"], by=["g"], ranges=16, hot_rows=hot_rows).select("g", "o", "position"))
    groups = {}
    for g, o, p in rows:
        groups.setdefault(g, []).append((o, p))
    for members in groups.values():
        assert [p for _, p in sorted(members)] == list(range(len(members)))


def test_position_keeps_null_groups(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, o long")
    for hot_rows in (0, 10):
        got = sorted((r.g or "", r.position) for r in od.with_position(df, ["o"], by=["g"], hot_rows=hot_rows).collect())
        assert got == [("", 0), ("", 1), ("a", 0)]


@pytest.mark.parametrize("ranges, hot_rows", [(2, 0), (64, 0), (64, 10**6)])
def test_quantiles_are_exact(spark, ranges, hot_rows):
    df = skewed(spark)
    probs = [0.0, 0.1, 0.25, 0.5, 0.95, 1.0]
    got = {(r.g, r.prob): r.value for r in od.exact_quantiles(od.value_counts(df, "v", ["g"]), probs, ["g"], ranges, hot_rows).collect()}
    frame = df.toPandas()
    for g, part in frame.groupby("g"):
        for p in probs:
            assert math.isclose(got[(g, p)], np.quantile(part.v, p), abs_tol=1e-9)


@pytest.mark.parametrize("hot_rows, margin", [(10**6, 0.005), (40, 0.005), (40, 0.0001), (3, 0.2)])
def test_bracketed_quantiles_are_exact(spark, hot_rows, margin):
    """In one count, in brackets of brackets, and in brackets that miss at first."""
    probs = [0.0, 0.1, 0.25, 0.5, 0.95, 0.999, 1.0]
    rng = np.random.default_rng(3)
    for values in (rng.normal(size=4001), np.r_[np.full(3000, 2.5), rng.integers(0, 9, 500)], np.r_[rng.exponential(size=900), [np.inf, -np.inf]], [7.0], [1.0, 2.0]):
        df = spark.createDataFrame([(float(x),) for x in values] + [(None,)], "v double").repartition(3)
        got = {r.prob: r.value for r in od.bracketed_quantiles(df, "v", probs, hot_rows, margin).collect()}
        for p in probs:
            at = np.sort(values)
            low, high = at[math.floor(p * (len(at) - 1))], at[math.ceil(p * (len(at) - 1))]
            want = low if low == high else low + (high - low) * (p * (len(at) - 1) - math.floor(p * (len(at) - 1)))
            assert math.isclose(got[p], want, abs_tol=1e-12), (p, len(at))


def test_bracketed_quantiles_of_odd_columns(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (1.0,), (2.0,), (float("nan"),)], "v double")
    got = {r.prob: r.value for r in od.bracketed_quantiles(df, "v", [0.0, 0.3, 1.0]).collect()}
    assert got[0.0] == 1.0 and math.isclose(got[0.3], 1.9) and math.isnan(got[1.0])
    assert od.bracketed_quantiles(df.limit(0), "v", [0.5]).count() == 0


def test_ranges_follow_the_rows(spark):
    """As many ranges as hold the set number of rows, also for texts with an outlier and for many null keys."""
    from gradeflow.operators.ranges import in_order, range_of

    df = spark.range(6000).selectExpr("case when id = 0 then 'A' else concat('prefix-that-all-share/', lpad(cast(id as string), 9, '0')) end as k", "id")
    results = [sorted(map(tuple, od.with_position(df, ["k", "id"], ranges=n, hot_rows=h).collect())) for n, h in ((3, 0), (50, 0), (None, 500), (None, 10**6))]
    assert all(r == results[0] for r in results)
    sizes = [r["count"] for r in in_order(df, ["k", "id"], "ordered", 12).groupBy(range_of().alias("r")).count().collect()]
    assert len(sizes) == 12 and max(sizes) < 1500
    hot = spark.range(4000).selectExpr("'one' as k")  # equal rows
    assert max(r["count"] for r in in_order(hot, ["k"], "ordered", 8).groupBy(range_of().alias("r")).count().collect()) < 1500


@pytest.mark.parametrize("hot_rows", [0, 10**6])
def test_next_row_across_ranges(spark, hot_rows):
    rows = od.with_next(skewed(spark), ["o"], ["id"], by=["g"], ranges=16, hot_rows=hot_rows).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.g, []).append((r.o, r.id, r.next_id))
    for members in groups.values():
        members.sort()
        assert [m[2] for m in members] == [m[1] for m in members[1:]] + [None]


def test_split_sizes_and_disjointness(spark, partitions):
    for n, ratio, want in [(1, 0.1, 1), (5, 0.1, 1), (100, 0.1, 10), (101, 0.25, 25)]:
        df = spark.range(n)
        rows = partitions(lambda: od.exact_split(df, "id", ratio))
        assert sorted(r[0] for r in rows) == list(range(n))
        assert sum(r[1] == "eval" for r in rows) == want
    assert od.ratio_split(spark.range(10), "id", 0).where("split = 'eval'").count() == 0
    assert od.ratio_split(spark.range(101), "id", 0.1).where("split = 'eval'").count() == 11


def test_sample(spark):
    df = spark.range(1000)
    first = sorted(r.id for r in od.seeded_sample(df, "id", 100).collect())
    again = sorted(r.id for r in od.seeded_sample(df.repartition(7), "id", 100).collect())
    assert first == again and len(first) == 100
    assert first != sorted(r.id for r in od.seeded_sample(df, "id", 100, seed=1).collect())
    assert od.seeded_sample(df, "id", 5000).count() == 1000
    assert od.seeded_sample(df, "id", 0).count() == 0


def test_sample_with_equal_hash_keys(spark):
    df = spark.createDataFrame([(1,)] * 4 + [(2,)], "id long")
    assert od.seeded_sample(df, "id", 5).count() == 5


def test_carry_forward_across_blocks(spark):
    df = spark.range(100).selectExpr("id % 2 as g", "id div 2 as p", "case when id div 2 in (3, 17) then id end as v")
    rows = od.carry_forward(df, ["g"], "p", "v", "held", block=5).collect()
    for r in rows:
        want = None if r.p < 3 else (3 * 2 + r.g if r.p < 17 else 17 * 2 + r.g)
        assert r.held == want


def test_top_per_group(spark):
    rows = od.top_per_group(skewed(spark), ["g"], ["o"], 2).collect()
    assert {r["rank"] for r in rows} == {1, 2}
    plan = od.top_per_group(skewed(spark), ["g"], ["o"], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # groups are cut before the shuffle


def test_global_order_of_times(spark):
    df = spark.range(500).selectExpr("id", "timestamp_ntz'2024-03-31 01:00:00' + make_dt_interval(0, 0, cast(id * 7 % 500 as int)) as t")
    rows = od.with_position(df, ["t"], hot_rows=0, ranges=8).collect()
    assert all(r.position == r.id * 7 % 500 for r in rows)


ORDERS = {
    "number": "cast(o as double)", "whole": "o", "text": "concat('user-', lpad(cast(o as string), 9, '0'))", "plain text": "cast(o as string)",
    "time": "timestamp_ntz'2024-03-31 01:00:00' + make_dt_interval(0, 0, 0, o)", "date": "date_add(date'2020-01-01', cast(o div 40 as int))",
    "decimal": "cast(o as decimal(20, 3)) / 7",
}


@pytest.mark.parametrize("kind", ORDERS)
def test_both_limits_agree_for_every_order(spark, kind):
    """Numbers, times, dates and texts, with null keys and null order values."""
    df = skewed(spark, 1500).selectExpr("id", "nullif(g, 3) as g", f"case when id % 97 = 0 then null else {ORDERS[kind]} end as k")
    small, large = ([sorted(map(tuple, od.with_position(df, ["k", "id"], by=["g"], hot_rows=n, ranges=16).collect()), key=str)
                     for n in (10**6, 0)])
    assert small == large
    small, large = ([sorted(map(tuple, od.with_next(df, ["k", "id"], ["id"], by=["g"], hot_rows=n, ranges=16).collect()), key=str)
                     for n in (10**6, 0)])
    assert small == large


@pytest.mark.parametrize("hot_rows", [0, 10**6])
def test_other_orders_are_refused_at_any_size(spark, hot_rows):
    df = spark.range(3).selectExpr("id", "array(id) as a")
    for run in (lambda: od.with_position(df, ["a"], hot_rows=hot_rows), lambda: od.with_next(df, ["a"], ["id"], hot_rows=hot_rows)):
        with pytest.raises(ValueError, match="cannot order by a"):
            run()


def test_group_figures_reach_every_row(spark):
    df = skewed(spark, 900).selectExpr("id", "nullif(g, 4) as g")
    figures = df.groupBy("g").count()
    got = od.join_groups(df, figures, ["g"], salts=7)
    want = {r.g: r["count"] for r in figures.collect()}
    assert got.columns == ["id", "g", "count"] and all(r["count"] == want[r.g] for r in got.collect()) and got.count() == 900
