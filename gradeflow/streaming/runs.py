"""Sources, sinks and folds of the streaming jobs.

State that outlives a micro-batch is either Spark's own state store or an ``EpochTable``
in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from gradeflow.functions.clock import wall_micros
from gradeflow.operators import registry
from gradeflow.operators.ordering import join_groups, with_position
from gradeflow.operators.telemetry import EVAL_MARKERS, parse_marker
from gradeflow.session import scratch_path


def stream_files(spark: SparkSession, folder: str, schema: T.StructType | str, glob: str = "*",
                 kind: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(kind).schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def stream_log(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Lines of text ``run <tab> seq <tab> line`` as run, seq, line; other lines are left out."""
    lines = stream_files(spark, folder, "value string", "*.txt", "text", files_per_trigger)
    parts = F.split("value", "\t", 3)
    return lines.where(F.size(parts) == 3).select(
        parts[0].try_cast("long").alias("run"), parts[1].try_cast("long").alias("seq"), parts[2].alias("line"))


def _start(writer, path: str):
    return writer.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def _epochs(spark: SparkSession, folder: str) -> int:
    """How many epochs have been written below ``folder``; only file names are read."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        newest = files.agg(F.max(F.regexp_extract("path", r"/epoch=(\d+)/", 1).cast("long"))).first()[0]
    except AnalysisException:  # no epoch yet
        return 0
    return 0 if newest is None else newest + 1


def drain_append(stream: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Run until the source is empty; rows go to a parquet sink with exactly-once commit.

    With a ``path`` a later call goes on where the earlier one stopped (so do the others).
    A source without rows gives an empty table.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, name)
    _start(stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows"), path).awaitTermination()
    try:
        return spark.read.schema(stream.schema).parquet(f"{path}/rows")
    except AnalysisException:
        return spark.createDataFrame([], stream.schema)


class EpochTable:
    """A table kept as one small part per epoch, merged into a base every ``span`` epochs.

    Writing epoch n costs its own part; reading it costs the last base and fewer than
    ``span`` parts, however many epochs there were. Every path belongs to one epoch and is
    overwritten, so a repeated epoch replaces itself.
    """

    def __init__(self, path: str, schema: T.StructType, merge: Callable[[DataFrame], DataFrame], span: int = 16):
        self.path, self.schema, self.merge, self.span = path, schema, merge, span

    def before(self, spark: SparkSession, epoch: int) -> DataFrame:
        """The merged table after all epochs below ``epoch``."""
        base = epoch // self.span * self.span
        paths = [f"{self.path}/base/epoch={base - 1}"] if base else []
        paths += [f"{self.path}/part/epoch={i}" for i in range(base, epoch)]
        if not paths:
            return spark.createDataFrame([], self.schema)
        # the schema is given, and a folder name is no column of it
        return self.merge(spark.read.schema(self.schema).parquet(*paths).select(*self.schema.names))

    def write(self, part: DataFrame, epoch: int) -> None:
        part.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/part/epoch={epoch}")
        if (epoch + 1) % self.span == 0:
            spark = part.sparkSession
            base = epoch // self.span * self.span
            paths = [f"{self.path}/base/epoch={base - 1}"] if base else []
            paths += [f"{self.path}/part/epoch={i}" for i in range(base, epoch + 1)]
            merged = self.merge(spark.read.schema(self.schema).parquet(*paths).select(*self.schema.names))
            merged.write.mode("overwrite").parquet(f"{self.path}/base/epoch={epoch}")

    def whole(self, spark: SparkSession) -> DataFrame:
        return self.before(spark, _epochs(spark, f"{self.path}/part"))


def drain_update(stream: DataFrame, name: str, keys: Sequence[str], path: str | None = None) -> DataFrame:
    """Update mode: each epoch writes its changed rows; the newest epoch wins per key."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, name)
    rest = [c for c in stream.columns if c not in keys]
    schema = T.StructType([*stream.schema.fields, T.StructField("_epoch", T.LongType())])

    def newest(rows: DataFrame) -> DataFrame:
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest, "_epoch"), "_epoch").alias("_r"))
        return last.select(*keys, "_r.*").select(*schema.names)

    table = EpochTable(f"{path}/rows", schema, newest)

    def store(rows: DataFrame, epoch: int) -> None:
        table.write(rows.withColumn("_epoch", F.lit(epoch).cast("long")), epoch)

    _start(stream.writeStream.outputMode("update").foreachBatch(store), path).awaitTermination()
    return table.whole(spark).select(*stream.columns)


def fold_epochs(stream: DataFrame, name: str,
                step: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]],
                merge: Callable[[DataFrame], DataFrame], state: T.StructType, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Drain with a state table: ``step(rows, state before)`` returns (output rows, change of the state).

    ``merge`` turns the changes of several epochs into one state of the given schema. Gives
    back (all output, last state); a source without rows gives empty tables.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, name)
    table = EpochTable(f"{path}/state", state, merge)

    def run(rows: DataFrame, epoch: int) -> None:
        rows.persist()  # the step reads the epoch's rows several times
        try:
            out, change = step(rows, table.before(rows.sparkSession, epoch))
            out.write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")
            table.write(change, epoch)
        finally:
            rows.unpersist()

    _start(stream.writeStream.foreachBatch(run), path).awaitTermination()
    last = table.whole(spark)
    if not _epochs(spark, f"{path}/rows"):
        return step(spark.createDataFrame([], stream.schema), last)[0], last
    return spark.read.parquet(f"{path}/rows").drop("epoch"), last


def as_instant(ts: Column | str) -> Column:
    """Zone-free time as a timestamp, read as UTC whatever the session zone is."""
    return F.timestamp_micros(wall_micros(ts))


# --- jobs ---

def stream_parse_markers(lines: DataFrame) -> DataFrame:
    """Stateless: works on a stream exactly as on a table."""
    return parse_marker(lines)


def stream_eval_metrics(lines: DataFrame, path: str | None = None) -> DataFrame:
    """Last good evaluation payload per run."""
    found = parse_marker(lines, markers=EVAL_MARKERS).where(F.col("marker") == "eval_metrics")
    newest = found.groupBy("run").agg(F.max_by("payload", "seq").alias("payload"), F.max("seq").alias("seq"))
    return drain_update(newest, "eval", ["run"], path=path)


def stream_last_progress(lines: DataFrame, path: str | None = None) -> DataFrame:
    """Newest progress and newest final metrics per run."""
    found = parse_marker(lines).where(F.col("marker").isin("progress", "final_metrics"))
    newest = found.groupBy("run", "marker").agg(
        F.max_by("payload", "seq").alias("payload"), F.max("seq").alias("seq")
    )
    return drain_update(newest, "progress", ["run", "marker"], path=path)


def stream_metric_log(series: DataFrame, path: str | None = None) -> DataFrame:
    """Metric rows with a running step per run.

    Inside an epoch rows are positioned by (ts, seq) over ranges; the count per run of the
    earlier epochs is the starting point. Epochs are taken in arrival order.
    """
    def number(rows: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        placed = with_position(rows, ["ts", "seq"], by=["run"], name="_at")
        counts = rows.groupBy("run").agg(F.count("*").alias("n"))
        # a row per run of the epoch
        before = counts.select("run").join(state, "run", "left").select("run", F.coalesce("n", F.lit(0)).alias("_before"))
        out = join_groups(placed, before, ["run"]).withColumn("step", F.col("_before") + F.col("_at") + 1)
        return out.drop("_at", "_before"), counts

    def total(changes: DataFrame) -> DataFrame:
        return changes.groupBy("run").agg(F.sum("n").alias("n"))

    kind = T.StructType([series.schema["run"], T.StructField("n", T.LongType())])
    return fold_epochs(series, "metric_log", number, total, kind, path)[0]


def stream_best_metric(series: DataFrame, path: str | None = None) -> DataFrame:
    """Running lowest value per run and metric, earliest first on ties."""
    best = series.groupBy("run", "metric").agg(F.min(F.struct("value", "ts", "seq")).alias("b")).select(
        "run", "metric", F.col("b.value").alias("value"), F.col("b.seq").alias("seq")
    )
    return drain_update(best, "best", ["run", "metric"], path=path)


def stream_feedback_dedup(events: DataFrame, path: str | None = None) -> DataFrame:
    """One row per user, type and minute; repeats may arrive up to an hour late.

    events: user_id, event_type, at (timestamp).
    """
    minute = F.floor(F.unix_micros("at") / 60_000_000).cast("long").alias("minute")
    keyed = events.select("user_id", "event_type", "at", minute).withWatermark("at", "1 hour")
    unique = keyed.dropDuplicatesWithinWatermark(["user_id", "event_type", "minute"])
    return drain_append(unique.select("user_id", "event_type", "minute"), "feedback", path=path)


def _start_day(window: str) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_micros(F.col(f"{window}.start")) / 86_400_000_000).cast("int"))


def daily_totals(events: DataFrame) -> DataFrame:
    """Tumbling days: rows, share of errors, mean value. Batch or stream (1 hour watermark)."""
    timed = events.withWatermark("at", "1 hour") if events.isStreaming else events
    return timed.groupBy(F.window("at", "1 day").alias("w")).agg(
        F.count("*").alias("n"), F.avg((F.col("event_type") == "error").cast("int")).alias("error_share"),
        F.avg("value").alias("mean_value"),
    ).select(_start_day("w").alias("day"), "n", "error_share", "mean_value")


def daily_health(events: DataFrame, factor: float = 2.0) -> DataFrame:
    """Daily totals with a flag for days over ``factor`` times the mean of the 7 rows before.

    The flag runs on the drained day table, which has one row per calendar day.
    """
    totals = drain_update(daily_totals(events), "daily", ["day"]) if events.isStreaming else daily_totals(events)
    week = W.partitionBy().orderBy("day").rowsBetween(-7, -1)
    usual = F.avg("mean_value").over(week)
    return totals.withColumn("anomaly", F.coalesce(F.col("mean_value") > factor * usual, F.lit(False)))


def weekly_totals(events: DataFrame) -> DataFrame:
    """Tumbling weeks from Monday, totals per type."""
    timed = events.withWatermark("at", "1 hour") if events.isStreaming else events
    weeks = F.window("at", "7 days", startTime="4 days").alias("w")  # 1970-01-05 was a Monday
    return timed.groupBy(weeks, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        _start_day("w").alias("week"), "event_type", "n", "total"
    )


def weekly_cycle(events: DataFrame) -> DataFrame:
    if events.isStreaming:
        return drain_update(weekly_totals(events), "weekly", ["week", "event_type"])
    return weekly_totals(events)


def stream_registry_state(events: DataFrame, path: str | None = None) -> DataFrame:
    """Registry state after the drain; each epoch folds its events into a compact snapshot."""
    rows = events.select("version", "ts", "seq", "stage")
    _, snapshot = fold_epochs(rows, "registry", lambda new, state: (new, registry.compact_part(new)), registry.compact, rows.schema, path)
    return registry.registry_state(snapshot)
