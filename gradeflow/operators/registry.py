"""Model versions as an append-only event table.

events: version, stage, ts (any ordered type), seq (breaks ties; (ts, seq) is unique).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.functions.text import is_json
from gradeflow.operators.ordering import with_next

# Stages a version may be moved to.
STAGES = ("registered", "evaluated", "staged", "production", "retired")


def check_stage(stage: str) -> str:
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}, expected one of {STAGES}")
    return stage


def registry_register(entries: DataFrame) -> DataFrame:
    """Latest entry per version replaces the whole older one; the stage is reset to registered.

    ``training_metrics`` is JSON text; unreadable text becomes an empty object.
    """
    rest = [c for c in entries.columns if c != "version"]
    latest = entries.groupBy("version").agg(F.max_by(F.struct(*rest), F.struct("ts", "seq")).alias("_e"))
    readable = is_json("training_metrics")
    return latest.select("version", *[F.col(f"_e.{c}") for c in rest]).withColumn(
        "training_metrics", F.when(readable, F.col("training_metrics")).otherwise("{}")
    ).withColumn("stage", F.lit("registered"))


def promote(events: DataFrame, version: str, stage: str, ts: Column, seq: Column) -> DataFrame:
    """Append one promotion. Any stage may follow any other; an unknown version fails."""
    check_stage(stage)
    if events.where(F.col("version") == version).isEmpty():
        raise ValueError(f"unknown version {version!r}")
    event = events.sparkSession.range(1).select(
        F.lit(version).alias("version"), F.lit(stage).alias("stage"), ts.alias("ts"), seq.alias("seq")
    )
    return events.unionByName(event)


def registry_state(events: DataFrame) -> DataFrame:
    """Current stage per version after folding all events in order.

    A production event retires the version that was current before it, unless it is the
    same one. So a version is retired if, after its last own event, another version took
    production directly after this one's last production event.
    """
    place = F.struct("ts", "seq")
    is_production = F.col("stage") == "production"
    last = events.groupBy("version").agg(
        F.max_by("stage", place).alias("own_stage"), F.max(place).alias("own_at"),
        F.max(F.when(is_production, place)).alias("produced_at"),
    )
    chain = with_next(
        events.where(is_production).select("version", "ts", "seq"), ["ts", "seq"], ["ts", "seq"]
    ).groupBy("version").agg(
        F.max_by(F.when(F.col("next_ts").isNotNull(), F.struct(F.col("next_ts").alias("ts"), F.col("next_seq").alias("seq"))),
                 place).alias("replaced_at")
    )
    state = last.join(chain, "version", "left")
    replaced = F.coalesce(F.col("replaced_at") > F.col("own_at"), F.lit(False))
    return state.select(
        "version",
        F.when(replaced, "retired").otherwise(F.col("own_stage")).alias("stage"),
        F.when(replaced, F.col("replaced_at.ts")).otherwise(F.col("own_at.ts")).alias("changed_at"),
        (F.col("produced_at").isNotNull() & F.col("replaced_at").isNull()).alias("is_current"),
    )


def current_production(events: DataFrame) -> DataFrame:
    """One row: the version of the last production event."""
    return events.where(F.col("stage") == "production").agg(
        F.max_by("version", F.struct("ts", "seq")).alias("current_production")
    )


def registry_current(state: DataFrame, events: DataFrame) -> DataFrame:
    """All versions with a marker on the current one (one-row table, so broadcast is bounded)."""
    current = current_production(events).select(
        F.col("current_production").alias("version"), F.lit("*").alias("marker")
    )
    return state.drop("is_current").join(F.broadcast(current), "version", "left").withColumn(
        "marker", F.coalesce("marker", F.lit(""))
    )


def stage_filter(state: DataFrame, stage: str) -> DataFrame:
    return state.where(F.col("stage") == stage)


def registry_lookup(state: DataFrame, version: object = None, stage: str | None = None,
                    current: bool = False) -> DataFrame:
    found = state
    if version is not None:
        found = found.where(F.col("version") == version)
    if stage is not None:
        found = stage_filter(found, stage)
    if current:
        found = found.where("is_current")
    return found


def dangling_production(state: DataFrame) -> DataFrame:
    """Current production versions whose own stage says otherwise."""
    return state.where(F.col("is_current") & (F.col("stage") != "production"))


def effective_events(events: DataFrame) -> DataFrame:
    """The events and the retirements they imply: a version is retired when another one takes production after it."""
    chain = with_next(
        events.where(F.col("stage") == "production").select("version", "ts", "seq"), ["ts", "seq"], ["version", "ts", "seq"]
    )
    implied = chain.where(F.col("next_version") != F.col("version")).select(
        "version", F.lit("retired").alias("stage"), F.col("next_ts").alias("ts"), F.col("next_seq").alias("seq"))
    return events.select("version", "stage", "ts", "seq").unionByName(implied)


def stage_timeline(events: DataFrame) -> DataFrame:
    """Last arrival and total time per stage, wide; a stage still open counts no time.

    Time in production ends when another version takes it, which also stamps the retirement.
    ``ts`` is in microseconds.
    """
    ahead = with_next(effective_events(events), ["ts", "seq"], ["ts"], by=["version"])
    figures = []
    for stage in STAGES:
        here = F.col("stage") == stage
        figures += [
            F.max(F.when(here, F.col("ts"))).alias(f"{stage}_at"),
            F.coalesce(F.sum(F.when(here, F.col("next_ts") - F.col("ts"))), F.lit(0)).alias(f"{stage}_micros"),
        ]
    return ahead.groupBy("version").agg(*figures)


def lineage(state: DataFrame, entries: DataFrame, verdicts: DataFrame) -> DataFrame:
    """version -> dataset -> weakness -> evaluation verdict -> stage."""
    return (
        entries.select("version", "dataset", "weakness_targeted")
        .join(verdicts.select("version", "recommendation"), "version", "left")
        .join(state.select("version", "stage"), "version", "left")
    )


def production_candidates(state: DataFrame, verdicts: DataFrame) -> DataFrame:
    approved = verdicts.where(F.col("recommendation") == "APPROVE").select("version", "recommendation")
    return stage_filter(state, "evaluated").select("version", "stage").join(approved, "version")


def compact(events: DataFrame) -> DataFrame:
    """The events later folds can still depend on: at most three per version.

    These are the last one, the last production one, and the production event after it.
    """
    fields = F.struct("ts", "seq", "stage")
    cols = ["version", "ts", "seq", "stage"]
    last = events.groupBy("version").agg(F.max(fields).alias("e")).select("version", "e.*").select(*cols)
    production = with_next(
        events.where(F.col("stage") == "production").select(*cols), ["ts", "seq"], ["ts", "seq", "version", "stage"]
    ).groupBy("version").agg(F.max_by(F.struct(
        "ts", "seq", "stage", "next_version", "next_ts", "next_seq", "next_stage"), F.struct("ts", "seq")).alias("e"))
    own = production.select("version", "e.ts", "e.seq", "e.stage")
    after = production.select(
        F.col("e.next_version").alias("version"), F.col("e.next_ts").alias("ts"),
        F.col("e.next_seq").alias("seq"), F.col("e.next_stage").alias("stage"),
    ).where(F.col("version").isNotNull())
    return last.unionByName(own).unionByName(after).distinct()


def compact_part(events: DataFrame) -> DataFrame:
    """The events of one epoch that a fold over all epochs can depend on.

    These are those of ``compact`` and the first production event, which may replace a
    version of an earlier epoch.
    """
    cols = ["version", "ts", "seq", "stage"]
    first = events.where(F.col("stage") == "production").agg(F.min(F.struct("ts", "seq", "version", "stage")).alias("e"))
    return compact(events).unionByName(first.where("e is not null").select("e.*").select(*cols)).distinct()
