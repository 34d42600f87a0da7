"""Comparing metric tables of two model versions and deciding on the newer one.

Metric tables are long: version, metric, value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.functions.numbers import percent_label, round_to, signed_label, signed_percent_label

# Relative change per metric that rejects, needs review, or meets a target.
HARD_LIMIT = -0.02
SOFT_LIMIT = -0.005
IMPROVED = 0.005
TARGET_GAIN = 0.03
# Report wording.
DEFAULT_REASON = "All metrics within acceptable range"


def metric_name_union(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    return baseline.select("version", "metric").union(candidate.select("version", "metric")).distinct()


def numeric_metrics_only(joined: DataFrame) -> DataFrame:
    """Keep metrics that are numbers on both sides; an absent side counts as 0.

    ``baseline`` and ``candidate`` may be text; ``*_present`` tells absent from unreadable.
    """
    def number(side: str) -> Column:
        return F.when(F.col(f"{side}_present"), F.expr(f"try_cast({side} as double)")).otherwise(F.lit(0.0))

    return (
        joined.withColumn("baseline", number("baseline")).withColumn("candidate", number("candidate"))
        .where(F.col("baseline").isNotNull() & F.col("candidate").isNotNull())
    )


def metric_full_join(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """All metrics of either version. ``missing_side`` names the side that lacks it."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("version", "metric", F.col("value").alias(name), F.lit(True).alias(f"{name}_present"))

    joined = side(baseline, "baseline").join(side(candidate, "candidate"), ["version", "metric"], "full_outer")
    flags = {f"{s}_present": F.coalesce(F.col(f"{s}_present"), F.lit(False)) for s in ("baseline", "candidate")}
    return numeric_metrics_only(joined.withColumns(flags)).select(
        "version", "metric", "baseline", "candidate",
        F.when(~F.col("baseline_present"), "baseline").when(~F.col("candidate_present"), "candidate")
        .alias("missing_side"),
    )


def delta_status(joined: DataFrame, lower_is_better: tuple[str, ...] = ()) -> DataFrame:
    """Change, relative change rounded to 4 places, and status decided on the rounded value.

    A zero baseline gives no relative change and status neutral. By default every metric is
    better when higher; names in ``lower_is_better`` are judged the other way round.
    """
    base, cand = F.col("baseline"), F.col("candidate")
    delta = F.when(base == 0, cand).otherwise(cand - base)
    pct = F.when(base != 0, round_to((cand - base) / F.abs(base), 4))
    compared = joined.withColumn("delta", delta).withColumn("delta_pct", pct)
    if lower_is_better:
        gain = F.when(F.col("metric").isin(*lower_is_better), -F.col("delta_pct")).otherwise(F.col("delta_pct"))
    else:
        gain = F.col("delta_pct")
    compared = compared.withColumn("gain", gain)
    return compared.withColumn(
        "status",
        F.when(F.col("gain") > IMPROVED, "improved").when(F.col("gain") < SOFT_LIMIT, "regressed")
        .otherwise("neutral"),
    )


def delta_label(delta: Column, pct: Column) -> Column:
    """Text such as ``+0.0343 (+14.5%)``; ``pct`` is a fraction."""
    return F.concat(
        signed_label(delta, 4), F.coalesce(F.concat(F.lit(" ("), signed_percent_label(pct), F.lit(")")), F.lit(""))
    )


def comparison_summary(compared: DataFrame) -> DataFrame:
    def n(status: str) -> Column:
        return F.count(F.when(F.col("status") == status, 1)).alias(status)

    return compared.groupBy("version").agg(
        F.count("*").alias("total_metrics"), n("improved"), n("regressed"), n("neutral")
    )


def sorted_metric_report(compared: DataFrame) -> DataFrame:
    """Rows in report order with the change as text."""
    return compared.withColumn("label", delta_label(F.col("delta"), F.col("delta_pct"))).orderBy("version", "metric")


def regression_verdict(compared: DataFrame, target: str | None = None) -> DataFrame:
    """APPROVE, NEEDS_REVIEW or REJECT per version, with reasons in metric order.

    Reasons hold at most one entry per metric name. A target that matches no metric is
    skipped, which ``target_matched`` shows.
    """
    gain = F.col("gain")
    hard = gain < HARD_LIMIT
    soft = (gain >= HARD_LIMIT) & (gain < SOFT_LIMIT)
    matches = F.contains(F.lower("metric"), F.lit(target.lower())) if target else F.lit(False)

    def collected(flag: Column, label: str) -> Column:
        text = F.concat(F.lit(f"{label} regression on "), F.col("metric"), F.lit(": "), percent_label(gain))
        entry = F.when(flag, F.struct("metric", text.alias("text")))
        return F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["text"])

    folded = compared.groupBy("version").agg(
        collected(hard, "Hard").alias("hard"), collected(soft, "Soft").alias("soft"),
        F.max(matches).alias("target_matched"),
        F.max(F.when(matches, F.coalesce(gain, F.lit(0.0)))).alias("best"),
    )
    rejected = F.size("hard") > 0
    short = F.coalesce(F.col("target_matched") & (F.col("best") < TARGET_GAIN), F.lit(False))
    short_text = F.concat(
        F.lit(f"Target weakness '{target}' improvement ("), percent_label(F.col("best")),
        F.lit(f") below minimum ({TARGET_GAIN:.0%})"),
    )
    reasons = F.concat(
        F.when(rejected, F.col("hard")).otherwise(F.col("soft")),
        F.when(short, F.array(short_text)).otherwise(F.array().cast("array<string>")),
    )
    return folded.select(
        "version",
        F.when(rejected, "REJECT").when((F.size("soft") > 0) | short, "NEEDS_REVIEW").otherwise("APPROVE")
        .alias("recommendation"),
        F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit(DEFAULT_REASON))).alias("reasons"),
        "target_matched",
    )


def gate_flags(compared: DataFrame, toxic: DataFrame, target: str, toxic_limit: float = 0.15) -> DataFrame:
    """Regression, target and safety gate per version as PASS or FAIL.

    ``toxic`` is a one-row table with ``toxic_rate``.
    """
    gain = F.col("gain")
    matches = F.contains(F.lower("metric"), F.lit(target.lower()))
    rate = toxic.agg(F.max("toxic_rate")).scalar()
    flags = compared.groupBy("version").agg(
        F.max(F.coalesce(gain < HARD_LIMIT, F.lit(False))).alias("dropped"),
        F.max(F.when(matches, F.coalesce(gain, F.lit(0.0)))).alias("best"),
    )

    def gate(passed: Column) -> Column:
        return F.when(passed, "PASS").otherwise("FAIL")

    return flags.select(
        "version",
        gate(rate <= toxic_limit).alias("safety_gate"),
        gate(~F.col("dropped")).alias("regression_gate"),
        gate(F.coalesce(F.col("best") >= TARGET_GAIN, F.lit(True))).alias("target_improvement_gate"),
    )


def perplexity(losses: DataFrame, by: str = "run") -> DataFrame:
    return losses.groupBy(by).agg(F.exp(F.avg("loss")).alias("perplexity"))
