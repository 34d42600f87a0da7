"""Telemetry, registry and streaming queries.

A streaming query reads the events file as a stream, drains it, and returns the result;
its SQL statement says the same over the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeflow.functions.clock import wall_micros
from gradeflow.operators import compare as cm
from gradeflow.operators import registry as rg
from gradeflow.operators import telemetry as tm
from gradeflow.plans.catalog import register, six
from gradeflow.plans.views import Tables, log_lines_of, series_of, stage_events_of
from gradeflow.plans.views_sql import ENTRIES, LOG_LINES, METRICS, SERIES, STATE, STEPS, r6, verdict, with_views
from gradeflow.session import scratch_path
from gradeflow.streaming import runs


EPOCHS = 3


def _in_epochs(t: Tables, rows, write) -> str:
    """``rows`` with a ``ts`` as files that arrive one after the other, in the order of time."""
    folder = scratch_path(t.spark, "arrivals")
    instant = wall_micros("ts")
    cuts = rows.select(instant.cast("double").alias("at")).approxQuantile("at", [i / EPOCHS for i in range(1, EPOCHS)], 0.01)
    borders = [None, *cuts, None]
    for i, (low, high) in enumerate(zip(borders, borders[1:])):
        part = rows if low is None else rows.where(instant >= low)
        write(part if high is None else part.where(instant < high), f"{folder}/{i}")
    return folder


def _event_stream(t: Tables):
    """The events as a stream of several epochs."""
    folder = _in_epochs(t, t.events, lambda part, path: part.coalesce(1).write.parquet(path))
    return runs.stream_files(t.spark, f"{folder}/*", t.events.schema, "*.parquet", files_per_trigger=1)


def _log_stream(t: Tables):
    """The log as lines of text, in several epochs."""
    def write(part, path: str) -> None:
        line = F.concat_ws("\t", F.col("run").cast("string"), F.col("seq").cast("string"), F.col("line"))
        log_lines_of(part).select(line.alias("value")).coalesce(1).write.text(path)

    return runs.stream_log(t.spark, _in_epochs(t, t.events, write) + "/*", files_per_trigger=1)


def _timed(events):
    return events.withColumn("at", runs.as_instant("ts"))


# marker lines

@register("parse_marker", with_views(LOG_LINES, then="select run, seq, line, marker, payload from parsed"))
def parse_marker(t: Tables):
    return tm.parse_marker(t.log_lines())


@register("progress_round", with_views(LOG_LINES, then="""
    select run, seq, cast(payload->>'$.step' as bigint) step, round(cast(payload->>'$.epoch' as double) * 100) / 100 epoch,
      round(coalesce(cast(payload->>'$.loss' as double), cast(payload->>'$.train_loss' as double)) * 10000) / 10000 loss,
      round(cast(payload->>'$.elapsed_seconds' as double) * 10) / 10 elapsed_seconds from parsed where marker = 'progress'"""))
def progress_round(t: Tables):
    return tm.progress_round(tm.parse_marker(t.log_lines()))


@register("stream_parse_markers", with_views(LOG_LINES, then="select run, seq, line, marker, payload from parsed"))
def stream_parse_markers(t: Tables):
    return runs.drain_append(runs.stream_parse_markers(_log_stream(t)), "markers")


@register("stream_eval_metrics", with_views(LOG_LINES, then="""
    select run, arg_max(p, seq) payload, max(seq) seq from (select run, seq, split_part(trim(line), '__EVAL_METRICS__:', 2) p
      from log_lines where contains(line, '__EVAL_METRICS__:')) where json_valid(p) group by run"""))
def stream_eval_metrics(t: Tables):
    return runs.stream_eval_metrics(_log_stream(t))


@register("stream_last_progress", with_views(LOG_LINES, then="""
    select run, marker, arg_max(payload, seq) payload, max(seq) seq from parsed
    where marker in ('progress', 'final_metrics') group by run, marker"""))
def stream_last_progress(t: Tables):
    return runs.stream_last_progress(_log_stream(t))


@register("run_result", with_views(LOG_LINES, then="""
    select run, case when complete and run % 3 <> 0 then 'completed' else 'failed' end status,
      case when run % 3 = 0 then 1 else 0 end exit_code, complete training_complete,
      cast(round(elapsed) as bigint) elapsed_seconds, round(elapsed / 3600 * 100) / 100 elapsed_hours, last_progress, final_metrics
    from (select user_id run, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 elapsed from events group by user_id)
    left join (select run, bool_or(marker = 'complete') complete, arg_max(payload, seq) filter (marker = 'progress') last_progress,
      arg_max(payload, seq) filter (marker = 'final_metrics') final_metrics from parsed group by run) using (run)"""))
def run_result(t: Tables):
    parsed = runs.drain_append(runs.stream_parse_markers(_log_stream(t)), "markers")
    return tm.run_result(parsed, t.exits())


# metric series

@register("step_log", with_views(SERIES, STEPS, then=f"select run, metric, value, ts, seq, step, {r6('elapsed_seconds')} elapsed_seconds from steps"))
def step_log(t: Tables):
    return six(tm.step_log(t.series()), "elapsed_seconds")


@register("step_log_explicit", with_views(SERIES, """marks as (select *, case when metric = 'signup' then seq end given,
    row_number() over (partition by run order by ts, seq) p from series)""",
    "held as (select *, max(case when given is not null then p end) over (partition by run order by p) hp from marks)", then="""
    select h.run, h.seq, coalesce(m.given + h.p - h.hp, h.p) step from held h left join marks m on h.run = m.run and h.hp = m.p"""))
def step_log_explicit(t: Tables):
    """Signup rows carry a step of their own; the others count on from it."""
    given = t.series().withColumn("given", F.when(F.col("metric") == "signup", F.col("seq")))
    return tm.step_log(given, explicit="given").select("run", "seq", "step")


@register("best_metric", with_views(SERIES, STEPS, then="""
    select run, metric, value, step from (select *, row_number() over (partition by run, metric order by value, step) rn from steps) where rn = 1"""))
def best_metric(t: Tables):
    return tm.best_metric(tm.step_log(t.series()))


@register("run_summary", with_views(SERIES, STEPS, then=f"select run, max(step) steps, {r6('max(elapsed_seconds)')} elapsed_seconds from steps group by run"))
def run_summary(t: Tables):
    return six(tm.run_summary(t.series()), "elapsed_seconds")


@register("checkpoint_select", with_views(SERIES, STEPS, then="""
    select run, step, value loss, best best_loss from (select *, row_number() over (partition by run order by step) rn
      from (select run, step, value, min(value) over (partition by run) best from steps where metric = 'view')
      where value <= best * 1.005::double) where rn = 1"""))
def checkpoint_select(t: Tables):
    steps = tm.step_log(t.series()).where(F.col("metric") == "view")
    return tm.checkpoint_select(steps.select("run", "step", F.col("value").alias("loss")))


@register("run_health_checks", with_views(SERIES, """pos as (select *, row_number() over w - 1 p, count(*) over (partition by run, metric) n,
    median(value) over (partition by run, metric order by ts, seq rows between 10 preceding and 1 preceding) med,
    coalesce(value > lag(value) over w, false) up from series window w as (partition by run, metric order by ts, seq)),
  ups as (select *, up and coalesce(lag(up, 1) over w, false) and coalesce(lag(up, 2) over w, false) three
    from pos window w as (partition by run, metric order by ts, seq))""", then="""
    select run, metric, count(*) n, coalesce(avg(value) filter (p >= n - 10) < avg(value) filter (p < 10), false) falling,
      bool_or(three) rising, bool_or(coalesce(value > 5 * med, false)) unstable, bool_or(isnan(value) or isinf(value)) has_nan,
      avg(value) > 80 busy from ups group by run, metric"""))
def run_health_checks(t: Tables):
    return tm.run_health_checks(t.series())


@register("run_cost", with_views(SERIES, then=f"""
    select run, {r6('h')} duration_hours, {r6('h * 4')} gpu_hours, {r6('h * 4 * 2.5')} estimated_cost
    from (select run, (max(ts) - min(ts)) / 3.6e9 h from series group by run)"""))
def run_cost(t: Tables):
    return six(tm.run_cost(t.series()), "duration_hours", "gpu_hours", "estimated_cost")


@register("stream_metric_log", with_views(SERIES, STEPS, then="select run, metric, value, seq, step from steps"))
def stream_metric_log(t: Tables):
    return runs.stream_metric_log(series_of(_event_stream(t))).select("run", "metric", "value", "seq", "step")


@register("stream_best_metric", with_views(SERIES, then="""
    select run, metric, value, seq from (select *, row_number() over (partition by run, metric order by value, ts, seq) rn from series) where rn = 1"""))
def stream_best_metric(t: Tables):
    return runs.stream_best_metric(series_of(_event_stream(t)))


# events over time

@register("feedback_ingest", """
    select event_type, cast(ts as date) "day", count(*) n, count(distinct user_id) users from events group by all""")
def feedback_ingest(t: Tables):
    """The feedback log arrives as a stream and becomes a table."""
    landed = runs.drain_append(_timed(_event_stream(t)), "feedback")
    per_user = landed.groupBy("event_type", F.to_date("ts").alias("day"), "user_id").agg(F.count("*").alias("c"))
    return per_user.groupBy("event_type", "day").agg(F.sum("c").alias("n"), F.count("*").alias("users"))


@register("stream_feedback_dedup", """
    select distinct user_id, event_type, cast(floor(epoch_us(ts) / 60000000) as bigint) as "minute" from events""")
def stream_feedback_dedup(t: Tables):
    """The events arrive twice."""
    twice = _timed(_event_stream(t)).union(_timed(_event_stream(t)))
    return runs.stream_feedback_dedup(twice)


@register("daily_health", f"""
    select *, coalesce(mean_value > 2 * avg(mean_value) over (order by "day" rows between 7 preceding and 1 preceding), false) anomaly
    from (select cast(ts as date) "day", count(*) n, {r6("avg(cast(event_type = 'error' as int))")} error_share,
      {r6('avg(value)')} mean_value from events group by 1)""")
def daily_health(t: Tables):
    return six(runs.daily_health(_timed(_event_stream(t))), "error_share", "mean_value")


@register("weekly_cycle", f"""
    select cast(date_trunc('week', ts) as date) "week", event_type, count(*) n, {r6('sum(value)')} total from events group by all""")
def weekly_cycle(t: Tables):
    return six(runs.weekly_cycle(_timed(_event_stream(t))), "total")


# registry

@register("stream_registry_state", with_views(*STATE, then="select version, stage, changed_at, is_current from state"))
def stream_registry_state(t: Tables):
    return runs.stream_registry_state(stage_events_of(_event_stream(t)))


@register("registry_promote", with_views(*STATE, then="select version, stage, changed_at, is_current from state"))
def registry_promote(t: Tables):
    return rg.registry_state(t.stage_events())


@register("registry_register", with_views(ENTRIES, then="""
    select version, dataset, weakness_targeted, training_metrics, ts, seq, 'registered' stage from entries"""))
def registry_register(t: Tables):
    return rg.registry_register(t.entries())


@register("registry_current", with_views(*STATE, then="""
    select version, stage, changed_at, case when is_current then '*' else '' end marker from state"""))
def registry_current(t: Tables):
    return rg.registry_current(rg.registry_state(t.stage_events()), t.stage_events())


@register("stage_filter", with_views(*STATE, then="select version, stage from state where stage = 'evaluated'"))
def stage_filter(t: Tables):
    return rg.stage_filter(rg.registry_state(t.stage_events()), "evaluated").select("version", "stage")


@register("registry_lookup", with_views(*STATE, then="""
    select 'current' kind, version, stage from state where is_current
    union all select 'staged', version, stage from state where stage = 'staged'
    union all select 'version', version, stage from state where version = 7
    union all select 'dangling', version, stage from state where is_current and stage <> 'production'"""))
def registry_lookup(t: Tables):
    state = rg.registry_state(t.stage_events())
    found = {
        "current": rg.registry_lookup(state, current=True), "staged": rg.registry_lookup(state, stage="staged"),
        "version": rg.registry_lookup(state, version=7), "dangling": rg.dangling_production(state),
    }
    result = None
    for kind, df in found.items():
        one = df.select(F.lit(kind).alias("kind"), "version", "stage")
        result = one if result is None else result.unionByName(one)
    return result


@register("stage_timeline", with_views(*STATE, """spans as (select *, lead(ts) over (partition by version order by ts, seq) - ts span
    from effective)""", then="select version, " + ", ".join(
    f"max(ts) filter (stage = '{s}') {s}_at, coalesce(sum(span) filter (stage = '{s}'), 0)::bigint {s}_micros" for s in rg.STAGES
) + " from spans group by version"))
def stage_timeline(t: Tables):
    return rg.stage_timeline(t.stage_events())


@register("lineage", with_views(*STATE, ENTRIES, METRICS, verdict(), then="""
    select e.version, e.dataset, e.weakness_targeted, v.recommendation, s.stage from entries e
    left join verdict v on e.version = v.version left join state s on e.version = s.version"""))
def lineage(t: Tables):
    verdicts = cm.regression_verdict(cm.delta_status(cm.metric_full_join(*t.metric_tables())), "view")
    return rg.lineage(rg.registry_state(t.stage_events()), rg.registry_register(t.entries()), verdicts)


@register("production_candidates", with_views(*STATE, METRICS, verdict(), then="""
    select s.version, s.stage, v.recommendation from state s join verdict v on s.version = v.version
    where s.stage = 'evaluated' and v.recommendation = 'APPROVE'"""))
def production_candidates(t: Tables):
    verdicts = cm.regression_verdict(cm.delta_status(cm.metric_full_join(*t.metric_tables())), "view")
    return rg.production_candidates(rg.registry_state(t.stage_events()), verdicts)
