"""Run telemetry: marker lines, metric series, best values, health, cost.

series: run, metric, value, ts (microseconds), seq; (ts, seq) orders a run.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.functions.numbers import round_to
from gradeflow.functions.text import is_json, strip
from gradeflow.operators.ordering import carry_forward, join_groups, with_halo, with_position

# Marker texts in the order they are looked for.
PROGRESS = "__PROGRESS__:"
FINAL = "__FINAL_METRICS__:"
COMPLETE = "__TRAINING_COMPLETE__"
BASELINE = "__BASELINE_METRICS__:"
EVAL = "__EVAL_METRICS__:"
TRAINING_MARKERS = (
    ("progress", PROGRESS), ("final_metrics", FINAL), ("complete", COMPLETE), ("baseline", BASELINE),
)
EVAL_MARKERS = (("eval_metrics", EVAL),)


def _payload(line: Column, marker: str) -> Column:
    """Text after the first marker, up to a second copy of it."""
    return F.split_part(line, F.lit(marker), F.lit(2))


def _read_line(line: Column, markers) -> Column:
    kind: Column = F.lit("log")
    payload: Column = F.lit(None).cast("string")
    for name, marker in reversed(markers):
        here = F.contains(line, F.lit(marker))
        kind = F.when(here, name).otherwise(kind)
        text = F.lit(None).cast("string") if marker == COMPLETE else _payload(line, marker)
        payload = F.when(here, text).otherwise(payload)
    return F.struct(line.alias("line"), kind.alias("marker"), payload.alias("payload"))


def parse_marker(lines: DataFrame, line: str = "line", markers=TRAINING_MARKERS) -> DataFrame:
    """Non-blank lines with ``marker`` and ``payload``; lines without a marker are "log".

    Lines whose payload is not JSON are dropped. The completion marker has no payload. Each
    line is read once inside an array of one, so no filter repeats the work.
    """
    filled = F.filter(F.array(strip(line)), lambda one: one != "")
    read = F.transform(filled, lambda one: _read_line(one, markers))
    good = F.filter(read, lambda r: r["marker"].isin("log", "complete") | is_json(r["payload"]))
    return lines.select(*[c for c in lines.columns if c != line], F.inline(good))


def number_at(payload: Column | str, name: str) -> Column:
    return F.get_json_object(payload, f"$.{name}").try_cast("double")


def progress_round(parsed: DataFrame) -> DataFrame:
    """Progress records with the rounding of the live report; loss falls back to train_loss, then 0."""
    zero = F.lit(0.0)
    loss = F.coalesce(number_at("payload", "loss"), number_at("payload", "train_loss"), zero)
    return parsed.where(F.col("marker") == "progress").select(
        "run", "seq", number_at("payload", "step").cast("long").alias("step"),
        round_to(F.coalesce(number_at("payload", "epoch"), zero), 2).alias("epoch"),
        round_to(loss, 4).alias("loss"),
        round_to(number_at("payload", "elapsed_seconds"), 1).alias("elapsed_seconds"),
    )


def last_payloads(parsed: DataFrame) -> DataFrame:
    """Newest payload per run and marker kind."""
    return (
        parsed.where(F.col("payload").isNotNull()).groupBy("run", "marker")
        .agg(F.max_by("payload", "seq").alias("payload"), F.max("seq").alias("seq"))
    )


def run_result(parsed: DataFrame, exits: DataFrame) -> DataFrame:
    """Status per run: completed needs the completion marker and exit code 0.

    exits: run, exit_code, elapsed_seconds.
    """
    def newest(kind: str) -> Column:
        return F.max_by("payload", F.when(F.col("marker") == kind, F.col("seq")))

    seen = parsed.groupBy("run").agg(
        F.max(F.col("marker") == "complete").alias("training_complete"),
        newest("progress").alias("last_progress"), newest("final_metrics").alias("final_metrics"),
    )
    joined = exits.join(seen, "run", "left").withColumn(
        "training_complete", F.coalesce("training_complete", F.lit(False))
    )
    done = F.col("training_complete") & (F.col("exit_code") == 0)
    return joined.select(
        "run", F.when(done, "completed").otherwise("failed").alias("status"), "exit_code", "training_complete",
        F.round("elapsed_seconds").cast("long").alias("elapsed_seconds"),
        round_to(F.col("elapsed_seconds") / 3600, 2).alias("elapsed_hours"),
        "last_progress", "final_metrics",
    )


def step_log(series: DataFrame, explicit: str | None = None) -> DataFrame:
    """Add ``step`` and ``elapsed_seconds`` per run.

    A call without a step takes the previous one plus 1 (starting at 1); a call with a step
    (column ``explicit``) sets the counter.
    """
    placed = with_position(series, ["ts", "seq"], by=["run"], name="_position")
    if explicit:
        anchor = F.when(F.col(explicit).isNotNull(), F.struct(F.col(explicit).alias("s"), F.col("_position").alias("p")))
        held = carry_forward(placed.withColumn("_anchor", anchor), ["run"], "_position", "_anchor", "_held")
        step = F.coalesce(F.col("_held.s") + F.col("_position") - F.col("_held.p"), F.col("_position") + 1)
        placed = held.withColumn("step", step).drop("_anchor", "_held")
    else:
        placed = placed.withColumn("step", F.col("_position") + 1)
    starts = series.groupBy("run").agg(F.min("ts").alias("_started"))
    return join_groups(placed, starts, ["run"]).withColumn(
        "elapsed_seconds", (F.col("ts") - F.col("_started")) / 1e6
    ).drop("_position", "_started")


def run_summary(series: DataFrame) -> DataFrame:
    return series.groupBy("run").agg(
        F.count("*").alias("steps"), ((F.max("ts") - F.min("ts")) / 1e6).alias("elapsed_seconds")
    )


def best_metric(steps: DataFrame, mode: str = "min") -> DataFrame:
    """Best value per run and metric with its step; ties go to the earliest step.

    A partial aggregate; a metric that never occurs gives no row.
    """
    if mode not in ("min", "max"):
        raise ValueError("mode is 'min' or 'max'")
    rank = F.col("value") if mode == "min" else -F.col("value")
    return steps.where(F.col("value").isNotNull()).groupBy("run", "metric").agg(
        F.min(F.struct(rank.alias("r"), F.col("step").alias("step"), F.col("value").alias("value"))).alias("_b")
    ).select("run", "metric", F.col("_b.value").alias("value"), F.col("_b.step").alias("step"))


def checkpoint_select(losses: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Earliest checkpoint whose loss is within ``tolerance`` of the run's lowest.

    losses: run, step, loss.
    """
    best = losses.groupBy("run").agg(F.min("loss").alias("best_loss"))
    close = join_groups(losses, best, ["run"]).where(F.col("loss") <= F.col("best_loss") * (1 + tolerance))
    return close.groupBy("run").agg(
        F.min("step").alias("step"), F.min_by("loss", "step").alias("loss"), F.max("best_loss").alias("best_loss")
    )


def _greater(a: float, b: float) -> bool:
    """a > b with not-a-number as the largest value, as in SQL."""
    return a > b or (a != a and b == b)


def spikes_and_rises(values: Sequence[float | None], width: int, spike: float) -> tuple[list[bool], list[bool]]:
    """For each value: more than ``spike`` times the median of the ``width`` values before it, and the third rise in a row.

    The window is a sorted list, so a step costs a search whatever the width. Nulls are no values, but places.
    """
    window: list[float] = []  # sorted, without not-a-number
    odd = 0
    spikes, rises, risen = [], [], 0
    for i, v in enumerate(values):
        n = len(window) + odd
        if i and n and v is not None:
            low, high = (window[k] if k < len(window) else math.nan for k in ((n - 1) // 2, n // 2))
            spikes.append(_greater(v, spike * ((low + high) / 2)))
        else:
            spikes.append(False)
        before = values[i - 1] if i else None
        risen = risen + 1 if v is not None and before is not None and _greater(v, before) else 0
        rises.append(risen >= 3)
        if v is not None:
            if v == v:
                insort(window, v)
            else:
                odd += 1
        if i >= width and (gone := values[i - width]) is not None:
            if gone == gone:
                window.pop(bisect_left(window, gone))
            else:
                odd -= 1
    return spikes, rises


def _marked(width: int, spike: float, keys: Sequence[str]):
    """Rows of one block of a run, without those that only serve as neighbours, with ``_spike`` and ``_three``."""

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("_position")
        spikes, rises = spikes_and_rises(block["value"].to_pylist(), width, spike)
        block = block.append_column("_three", pa.array(rises, pa.bool_())).append_column("_spike", pa.array(spikes, pa.bool_()))
        return block.filter(pc.invert(block["_halo"])).select([*keys, "value", "_position", "_three", "_spike"])

    return run


def run_health_checks(series: DataFrame, width: int = 10, spike: float = 5.0, busy: float = 80.0) -> DataFrame:
    """Per run and metric: falling, rising (three rises in a row), unstable, has_nan, busy.

    Frames look back ``width`` rows (three at least). Positions of a run of ordinary size
    come from one window; a longer one is positioned by ranges, and its frames run on
    overlapping blocks of bounded size, each in one pass with a sliding median. The number of rows reaches each
    row by a salted join, so no task holds a whole long run.
    """
    if width < 3:
        raise ValueError("three rises in a row need a width of 3 or more")
    keys = ["run", "metric"]
    series = series.withColumn("value", F.col("value").cast("double"))
    placed = with_position(series, ["ts", "seq"], by=keys, name="_position")
    blocks = with_halo(placed.select(*keys, "value", "_position"), "_position", before=width)
    kinds = dict(blocks.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*keys, "value", "_position")) + ", _three boolean, _spike boolean"
    marked = blocks.groupBy(*keys, "_block").applyInArrow(_marked(width, spike, keys), schema)
    counts = series.groupBy(*keys).agg(F.count("*").alias("n"))
    joined = join_groups(marked, counts, keys)
    first = F.avg(F.when(F.col("_position") < width, F.col("value")))
    last = F.avg(F.when(F.col("_position") >= F.col("n") - width, F.col("value")))
    broken = F.isnan("value") | (F.abs("value") == float("inf"))
    return joined.groupBy(*keys).agg(
        F.count("*").alias("n"), F.coalesce(last < first, F.lit(False)).alias("falling"),
        F.max("_three").alias("rising"), F.max("_spike").alias("unstable"),
        F.coalesce(F.max(broken), F.lit(False)).alias("has_nan"), (F.avg("value") > busy).alias("busy"),
    )


def run_cost(series: DataFrame, gpu_count: int = 4, rate_per_hour: float = 2.5) -> DataFrame:
    hours = (F.max("ts") - F.min("ts")) / 3.6e9
    return series.groupBy("run").agg(hours.alias("duration_hours")).select(
        "run", "duration_hours", (F.col("duration_hours") * gpu_count).alias("gpu_hours"),
        (F.col("duration_hours") * gpu_count * rate_per_hour).alias("estimated_cost"),
    )
