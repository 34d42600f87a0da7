"""Version comparison and verdict queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeflow.operators import compare as cm
from gradeflow.plans.catalog import register, six
from gradeflow.plans.views import Tables
from gradeflow.plans.views_sql import METRICS, r6, tenth_label, verdict, with_views

TARGET = "view"


def _joined(t: Tables):
    return cm.metric_full_join(*t.metric_tables())


def _compared(t: Tables):
    return cm.delta_status(_joined(t))


def _verdict(t: Tables, target: str | None = TARGET):
    return cm.regression_verdict(_compared(t), target)


@register("metric_full_join", with_views(METRICS, then=f"""
    select version, metric, {r6('baseline')} baseline, {r6('candidate')} candidate, missing_side from joined"""))
def metric_full_join(t: Tables):
    return six(_joined(t), "baseline", "candidate")


@register("metric_name_union", with_views(METRICS, then="select version, metric from baseline union select version, metric from candidate"))
def metric_name_union(t: Tables):
    return cm.metric_name_union(*t.metric_tables())


@register("numeric_metrics_only", with_views(METRICS, then="""
    select version, metric from baseline b full join candidate c using (version, metric)
    where not coalesce(b.value > 100, false) and not coalesce(c.value > 110, false)"""))
def numeric_metrics_only(t: Tables):
    """Values over 100 (110 on the other side) are written as unreadable text first."""
    base, cand = t.metric_tables()
    text = lambda df, top: df.withColumn(
        "value", F.when(F.col("value") > top, F.lit("n/a")).otherwise(F.col("value").cast("string")))
    return cm.metric_full_join(text(base, 100), text(cand, 110)).select("version", "metric")


@register("delta_status", with_views(METRICS, then=f"""
    select version, metric, {r6('delta')} delta, delta_pct, status from compared"""))
def delta_status(t: Tables):
    return six(_compared(t).select("version", "metric", "delta", "delta_pct", "status"), "delta")


_SIGNED = """concat(case when round(delta * 10000.0::double) < 0 then '-' else '+' end,
  cast(abs(cast(round(delta * 10000.0::double) as bigint)) // 10000 as varchar), '.',
  lpad(cast(abs(cast(round(delta * 10000.0::double) as bigint)) % 10000 as varchar), 4, '0'))"""
_LABEL = f"""concat({_SIGNED}, case when delta_pct is null then '' else concat(' (',
  case when round(delta_pct * 10000) < 0 then '-' else '+' end, {tenth_label('delta_pct')}, ')') end)"""


@register("delta_label", with_views(METRICS, then=f"select version, metric, {_LABEL} label from compared"))
def delta_label(t: Tables):
    return _compared(t).select("version", "metric", cm.delta_label(F.col("delta"), F.col("delta_pct")).alias("label"))


@register("sorted_metric_report", with_views(METRICS, then=f"""
    select version, metric, status, {_LABEL} label from compared order by version, metric"""))
def sorted_metric_report(t: Tables):
    return cm.sorted_metric_report(_compared(t)).select("version", "metric", "status", "label")


@register("comparison_summary", with_views(METRICS, then="""
    select version, count(*) total_metrics, count(*) filter (status = 'improved') improved,
      count(*) filter (status = 'regressed') regressed, count(*) filter (status = 'neutral') neutral from compared group by version"""))
def comparison_summary(t: Tables):
    return cm.comparison_summary(_compared(t))


@register("regression_verdict", with_views(METRICS, verdict(), then="select version, recommendation, reasons from verdict"))
def regression_verdict(t: Tables):
    return _verdict(t).select("version", "recommendation", F.array_join("reasons", " | ").alias("reasons"))


@register("gate_flags", with_views(METRICS, then="""
    select version, case when (select avg(toxic) from labels) <= 0.15 then 'PASS' else 'FAIL' end safety_gate,
      case when coalesce(max(cast(delta_pct < -0.02 as int)), 0) = 1 then 'FAIL' else 'PASS' end regression_gate,
      case when coalesce(max(coalesce(delta_pct, 0)) filter (metric = 'view') >= 0.03, true) then 'PASS' else 'FAIL' end target_improvement_gate
    from compared group by version"""))
def gate_flags(t: Tables):
    toxic = t.labels.agg(F.avg("toxic").alias("toxic_rate"))
    return cm.gate_flags(_compared(t), toxic, TARGET)


@register("perplexity", f"select user_id run, {r6('exp(avg(value / 112.0::double))')} perplexity from events group by user_id")
def perplexity(t: Tables):
    losses = t.events.select(F.col("user_id").alias("run"), (F.col("value") / 112.0).alias("loss"))
    return six(cm.perplexity(losses), "perplexity")
