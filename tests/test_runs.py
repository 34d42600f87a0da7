import random

import pytest
from pyspark.sql import functions as F

from gradeflow.operators import registry as rg
from gradeflow.operators import telemetry as tm
from gradeflow.streaming import runs

SERIES = "run long, metric string, value double, ts long, seq long"


def series(spark, n=200):
    rng = random.Random(4)
    rows = [(0 if i % 3 == 0 else i % 4, rng.choice("ab"), float(rng.randint(0, 40)), 1000 * i, i) for i in range(n)]
    return rows, spark.createDataFrame(rows, SERIES)


def plain_state(events):
    stage, at, current = {}, {}, None
    for v, s, ts, seq in sorted(events, key=lambda e: (e[2], e[3])):
        stage[v], at[v] = s, ts
        if s == "production":
            if current is not None and current != v:
                stage[current], at[current] = "retired", ts
            current = v
    return {v: (stage[v], at[v], v == current) for v in stage}


def events(seed, n=60, versions=6):
    rng = random.Random(seed)
    return [(rng.randrange(versions), rng.choice(rg.STAGES), 10 * i, i) for i in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_registry_fold_equals_replay(spark, seed):
    rows = events(seed)
    df = spark.createDataFrame(rows, "version long, stage string, ts long, seq long")
    got = {r.version: (r.stage, r.changed_at, r.is_current) for r in rg.registry_state(df).collect()}
    assert got == plain_state(rows)
    # folding in two parts over the compact table gives the same
    first = spark.createDataFrame(rows[:35], df.schema)
    again = rg.registry_state(rg.compact(first).unionByName(spark.createDataFrame(rows[35:], df.schema)))
    assert {r.version: (r.stage, r.changed_at, r.is_current) for r in again.collect()} == got


def test_promote_checks(spark):
    df = spark.createDataFrame([(1, "registered", 0, 0)], "version long, stage string, ts long, seq long")
    more = rg.promote(df, 1, "production", F.lit(5).cast("long"), F.lit(1).cast("long"))
    assert rg.current_production(more).first()[0] == 1
    with pytest.raises(ValueError, match="unknown version"):
        rg.promote(df, 9, "staged", F.lit(5), F.lit(1))
    with pytest.raises(ValueError, match="unknown stage"):
        rg.promote(df, 1, "shipped", F.lit(5), F.lit(1))


def test_register_replaces_the_whole_entry(spark):
    rows = [("v1", "d1", '{"f1": 1}', 1, 1), ("v1", None, "{bad", 2, 2)]
    df = spark.createDataFrame(rows, "version string, dataset string, training_metrics string, ts long, seq long")
    row = rg.registry_register(df).first()
    assert (row.dataset, row.training_metrics, row.stage) == (None, "{}", "registered")


def test_step_log_with_explicit_steps(spark):
    rows = [(1, "a", 0.0, i, i, g) for i, g in enumerate([None, None, 10, None, 5, None, None])]
    df = spark.createDataFrame(rows, SERIES + ", given long")
    got = [r.step for r in tm.step_log(df, explicit="given").orderBy("seq").collect()]
    assert got == [1, 2, 10, 11, 5, 6, 7]


def test_best_metric_ties_and_absence(spark):
    df = spark.createDataFrame([(1, "a", 2.0, 1), (1, "a", 1.0, 2), (1, "a", 1.0, 3), (1, "b", None, 4)],
                               "run long, metric string, value double, step long")
    assert [tuple(r) for r in tm.best_metric(df).collect()] == [(1, "a", 1.0, 2)]
    assert [tuple(r) for r in tm.best_metric(df, "max").collect()] == [(1, "a", 2.0, 1)]


def test_checkpoint_prefers_the_earlier_close_one(spark):
    df = spark.createDataFrame([(1, 100, 0.52), (1, 200, 0.5024), (1, 300, 0.5)], "run long, step long, loss double")
    assert tm.checkpoint_select(df).first().step == 200


def test_health_flags(spark):
    falling = [(1, "l", 30.0 - i, i, i) for i in range(25)]
    broken = [(2, "l", 1.0, i, i) for i in range(12)] + [(2, "l", 9.0, 12, 12), (2, "l", 10.0, 13, 13), (2, "l", 11.0, 14, 14),
                                                          (2, "l", float("nan"), 15, 15)]
    got = {r.run: r for r in tm.run_health_checks(spark.createDataFrame(falling + broken, SERIES)).collect()}
    assert (got[1].falling, got[1].rising, got[1].unstable, got[1].has_nan) == (True, False, False, False)
    assert (got[2].rising, got[2].unstable, got[2].has_nan) == (True, True, True)


def test_width_of_health_checks(spark):
    _, df = series(spark)
    with pytest.raises(ValueError, match="width"):
        tm.run_health_checks(df, width=2)


def test_hot_runs_are_never_whole_in_a_task(spark):
    """Between a join with figures of a run and the next aggregate on it stands a partial aggregate and an exchange."""
    _, df = series(spark)
    usual = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        steps = tm.step_log(df)
        losses = steps.select("run", "step", F.col("value").alias("loss"))
        for out in (tm.checkpoint_select(losses), tm.run_health_checks(df), tm.best_metric(steps)):
            lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
            top = next(i for i, line in enumerate(lines) if "Aggregate" in line)
            assert "Exchange" in lines[top + 1] + lines[top + 2], lines[:6]
            assert "partial_" in "".join(lines[top + 1 : top + 5])
            join = next(line for line in lines if "SortMergeJoin" in line)
            assert "_salt" in join
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v)


def test_frames_on_overlapping_blocks(spark):
    from pyspark.sql import Window as W

    from gradeflow.operators.ordering import with_halo

    df = spark.range(100).selectExpr("id as p", "id * id % 17 as v")
    inside = W.partitionBy("_block").orderBy("p").rowsBetween(-3, -1)
    blocks = with_halo(df, "p", before=3, block=8).withColumn("s", F.sum("v").over(inside)).where(~F.col("_halo"))
    got = {r.p: r.s for r in blocks.collect()}
    v = [i * i % 17 for i in range(100)]
    assert got == {i: (sum(v[max(0, i - 3):i]) if i else None) for i in range(100)}


def test_marker_lines(spark):
    lines = [
        '  __PROGRESS__:{"step": 1}  ', '__FINAL_METRICS__:{"f1": 1} __PROGRESS__:{"step": 2}', "x __TRAINING_COMPLETE__ y",
        '__BASELINE_METRICS__:{"f1": 2', "plain", "   ", '__PROGRESS__:{"a": 1}__PROGRESS__:{"b": 2}', "__PROGRESS__:[1] junk",
    ]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "run long, seq long, line string")
    got = [(r.seq, r.marker, r.payload) for r in tm.parse_marker(df).orderBy("seq").collect()]
    assert got == [(0, "progress", '{"step": 1}'), (1, "progress", '{"step": 2}'), (2, "complete", None), (4, "log", None),
                   (6, "progress", '{"a": 1}')]


# streams over several files and epochs

def stream_of(spark, df, tmp_path, parts, order):
    folder = str(tmp_path / "in")
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size:(i + 1) * size], df.schema).coalesce(1).write.parquet(f"{folder}/{i}")
    import os
    import time

    stamp = time.time() - 1000  # files are taken in order of their time
    for i in range(parts):
        for name in os.listdir(f"{folder}/{i}"):
            os.utime(f"{folder}/{i}/{name}", (stamp + i, stamp + i))
    return runs.stream_files(spark, folder + "/*", df.schema, "*.parquet", files_per_trigger=1)


def same(a, b):
    cols = sorted(a.columns)
    rows = lambda d: sorted(map(tuple, d.select(*cols).collect()), key=str)
    assert rows(a) == rows(b)


def test_stream_steps_continue_over_epochs(spark, tmp_path):
    _, df = series(spark)
    got = runs.stream_metric_log(stream_of(spark, df, tmp_path, 4, "seq"))
    same(got.select("run", "seq", "step"), tm.step_log(df).select("run", "seq", "step"))


def test_stream_best_metric(spark, tmp_path):
    rows, df = series(spark)
    got = {(r.run, r.metric): (r.value, r.seq) for r in runs.stream_best_metric(stream_of(spark, df, tmp_path, 3, "seq")).collect()}
    want = {}
    for run, metric, value, ts, seq in rows:
        want[(run, metric)] = min(want.get((run, metric), (value, seq)), (value, seq))
    assert got == want


def test_stream_registry(spark, tmp_path):
    df = spark.createDataFrame(events(9), "version long, stage string, ts long, seq long")
    same(runs.stream_registry_state(stream_of(spark, df, tmp_path, 4, "seq")), rg.registry_state(df))


@pytest.mark.parametrize("seed, parts", [(2, 9), (3, 20)])
def test_stream_registry_over_merged_epochs(spark, tmp_path, monkeypatch, seed, parts):
    """More epochs than one base holds; an epoch may hold several productions of one version."""
    monkeypatch.setattr(runs.EpochTable.__init__, "__defaults__", (4,))
    rows = [(v, s if i % 2 else "production", t, q) for i, (v, s, t, q) in enumerate(events(seed, n=100))]
    df = spark.createDataFrame(rows, "version long, stage string, ts long, seq long")
    got = runs.stream_registry_state(stream_of(spark, df, tmp_path, parts, "seq"))
    assert {r.version: (r.stage, r.changed_at, r.is_current) for r in got.collect()} == plain_state(rows)


def test_stream_goes_on_at_its_path(spark, tmp_path):
    _, df = series(spark)
    stream = stream_of(spark, df, tmp_path, 3, "seq")
    path = str(tmp_path / "job")
    for _ in range(2):
        same(runs.stream_metric_log(stream, path).select("run", "seq", "step"), tm.step_log(df).select("run", "seq", "step"))
        got = runs.stream_best_metric(stream, path + "-best")
    assert got.count() == df.select("run", "metric").distinct().count()


def test_streams_without_rows(spark, tmp_path):
    (tmp_path / "none").mkdir()
    read = lambda schema: runs.stream_files(spark, str(tmp_path / "none"), schema, "*.parquet")
    lines = "run long, seq long, line string"
    for out in (runs.drain_append(runs.stream_parse_markers(read(lines)), "markers"), runs.stream_last_progress(read(lines)),
                runs.stream_eval_metrics(read(lines)), runs.stream_metric_log(read(SERIES)), runs.stream_best_metric(read(SERIES)),
                runs.stream_registry_state(read("version long, stage string, ts long, seq long")),
                runs.daily_health(read("event_type string, value double, at timestamp")),
                runs.weekly_cycle(read("event_type string, value double, at timestamp")),
                runs.stream_feedback_dedup(read("user_id long, event_type string, at timestamp"))):
        assert out.columns and out.count() == 0


def test_log_of_text_lines(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.txt").write_text('1\t5\t__PROGRESS__:{"step": 1}\nno tabs\n1\t6\tx\ty\n')
    got = runs.drain_append(runs.stream_log(spark, str(tmp_path / "log")), "log").collect()
    assert sorted(map(tuple, got)) == [(1, 5, '__PROGRESS__:{"step": 1}'), (1, 6, "x\ty")]


def plain_timeline(rows):
    """Replay with one stamp per stage, overwritten at each move."""
    at, spent, stage, since, current = {}, {}, {}, {}, None

    def move(v, s, ts):
        if v in stage:
            spent.setdefault(v, {}).setdefault(stage[v], 0)
            spent[v][stage[v]] += ts - since[v]
        stage[v], since[v] = s, ts
        at.setdefault(v, {})[s] = ts

    for v, s, ts, seq in sorted(rows, key=lambda e: (e[2], e[3])):
        if s == "production":
            if current is not None and current != v:
                move(current, "retired", ts)
            current = v
        move(v, s, ts)
    return {v: [(at[v].get(s), spent.get(v, {}).get(s, 0)) for s in rg.STAGES] for v in stage}


@pytest.mark.parametrize("seed", range(3))
def test_timeline_equals_replay(spark, seed):
    rows = events(seed)
    df = spark.createDataFrame(rows, "version long, stage string, ts long, seq long")
    got = {r.version: [(r[f"{s}_at"], r[f"{s}_micros"]) for s in rg.STAGES] for r in rg.stage_timeline(df).collect()}
    assert got == plain_timeline(rows)


def test_stream_feedback_dedup_over_epochs(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, "view", 1_700_000_000 + 20 * (i % 40), i) for i in range(80)],
                               "user_id long, event_type string, s long, i long").withColumn("at", F.timestamp_seconds("s"))
    got = runs.stream_feedback_dedup(stream_of(spark, df, tmp_path, 3, "i"))
    want = df.select("user_id", "event_type", F.floor(F.col("s") / 60).alias("minute")).distinct()
    same(got, want)


def test_stream_days_equal_the_batch_twin(spark, tmp_path):
    df = spark.createDataFrame([("error" if i % 5 == 0 else "view", float(i % 50), 1_700_000_000 + 4000 * i, i) for i in range(200)],
                               "event_type string, value double, s long, i long").withColumn("at", F.timestamp_seconds("s"))
    same(runs.daily_health(stream_of(spark, df, tmp_path / "d", 3, "i")), runs.daily_health(df))
    same(runs.weekly_cycle(stream_of(spark, df, tmp_path / "w", 3, "i")), runs.weekly_cycle(df))


def test_stream_markers_and_last_payloads(spark, tmp_path):
    rows = [(i % 2, i, f'__PROGRESS__:{{"step": {i}}}' if i % 3 else '__FINAL_METRICS__:{"f1": 1') for i in range(30)]
    df = spark.createDataFrame(rows, "run long, seq long, line string")
    got = runs.stream_last_progress(stream_of(spark, df, tmp_path, 3, "seq"))
    want = tm.last_payloads(tm.parse_marker(df).where("marker in ('progress', 'final_metrics')"))
    same(got, want)


def test_sliding_median_equals_sorted_windows():
    import math
    import random
    import statistics

    rng = random.Random(6)
    nan, inf = float("nan"), float("inf")
    order = lambda x: (x != x, 0 if x != x else x)
    for width in (3, 10, 50):
        values = [rng.choice([rng.uniform(0, 9), rng.uniform(0, 9), rng.uniform(0, 90), 1.0, None, nan, inf]) for _ in range(400)]
        spikes, rises = tm.spikes_and_rises(values, width, 5.0)
        ups = [False] + [a is not None and b is not None and order(b) > order(a) for a, b in zip(values, values[1:])]
        for i, v in enumerate(values):
            before = sorted((x for x in values[max(0, i - width) : i] if x is not None), key=order)
            want = False
            if before and v is not None:
                low, high = before[(len(before) - 1) // 2], before[len(before) // 2]
                assert low != low or high != high or math.isinf(high) or math.isclose((low + high) / 2, statistics.median(before))
                want = order(v) > order(5.0 * ((low + high) / 2))
            assert spikes[i] == want and rises[i] == (i >= 3 and ups[i] and ups[i - 1] and ups[i - 2])


def test_health_of_a_run_in_blocks(spark, monkeypatch):
    """A run that spans blocks has the flags of one block; wide frames reach over the borders."""
    import random

    from gradeflow.operators import ordering as od

    rng = random.Random(9)
    rows = [(i % 3, "loss", rng.choice([rng.uniform(1, 3), rng.uniform(1, 3), 40.0 if rng.random() < 0.02 else 2.0, None]), i * 1000, i) for i in range(600)]
    df = spark.createDataFrame(rows, SERIES).repartition(4)
    want = sorted(map(tuple, tm.run_health_checks(df, width=20).collect()))
    monkeypatch.setattr(od.with_halo, "__defaults__", (25,))
    assert sorted(map(tuple, tm.run_health_checks(df, width=20).collect())) == want
