"""The shapes the operators work on, derived from the given tables.

Each view has an SQL statement of the same name in ``views_sql``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.functions.clock import wall_micros
from gradeflow.functions.prompts import dataset_tag
from gradeflow.operators.layout import last_by_role
from gradeflow.session import dealt

TOPIC = "the ration tion de"
CUT_DAY = "2024-01-16"
SUBMISSION_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


class Tables:
    """Attribute access to the parquet tables of one folder, and the views on them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._read: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._read[name]

    def texts(self) -> DataFrame:
        """The documents, for heavy work on their texts."""
        return dealt(self.documents, "doc_id")

    # grading

    def truth(self) -> DataFrame:
        return self.orders.select(
            F.col("o_orderkey").alias("id"),
            F.expr("substr('ABCD', cast(1 + o_custkey % 4 as int), 1)").alias("answer_idx"),
            F.expr("nullif(o_orderpriority, '4-NOT SPECIFIED')").alias("meta_info"),
        )

    def submission(self, letter_from: str = "l_partkey") -> DataFrame:
        return self.lineitem.select(
            F.expr("case when l_quantity = 50 then -1 - l_orderkey else l_orderkey end").alias("id"),
            F.expr(
                "case when l_tax = 0 and l_discount = 0 then null "
                f"else substr(' aBCDE', cast(1 + {letter_from} % 6 as int), 1) end"
            ).alias("predicted_idx"),
            *SUBMISSION_ORDER,
        )

    # pairs

    def pairs(self) -> DataFrame:
        """Conversations and documents as instruction pairs with gaps, copies and blanks."""
        talks = last_by_role(self.conversations, "user", "system", "assistant").select(
            (F.col("conv_id") * 2).alias("pair_id"), F.col("user").alias("instruction"),
            F.coalesce("system", F.lit("")).alias("input"), F.col("assistant").alias("output"),
        )
        texts = self.documents.select(
            (F.col("doc_id") * 2 + 1).alias("pair_id"),
            F.expr("case when n_chars > 8000 then null else concat('Write in ', lang, ' for ', source) end")
            .alias("instruction"),
            F.lit("").alias("input"),
            F.expr("case when n_chars < 100 then ' ' else text end").alias("output"),
        )
        return talks.unionByName(texts)

    def text_pairs(self) -> DataFrame:
        both = last_by_role(self.conversations, "user", "assistant")
        return both.where("user is not null and assistant is not null").select(
            F.col("conv_id").alias("id"), F.col("assistant").alias("prediction"), F.col("user").alias("reference")
        )

    def items(self) -> DataFrame:
        """Multiple-choice items; some option texts hold quotes, some are no dict."""
        return self.part.select(
            F.col("p_partkey").alias("id"), F.col("p_name").alias("question"),
            F.expr(
                "case when p_size = 13 then concat('[', p_type, ']') else concat("
                "'{''D'': ''', p_type, ''', ''A'': \"', p_name, '''s\", ''C'': ''', p_brand, "
                "''', ''B'': ', cast(p_size as string), '}') end"
            ).alias("options"),
            F.col("p_brand").alias("meta_info"), F.col("p_type").alias("metamap_phrases"),
        )

    def preferences(self) -> DataFrame:
        size = F.length("text")
        answer = F.col("role") == "assistant"
        return self.conversations.groupBy("conv_id").agg(
            F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("prompt"),
            F.min_by("text", F.when(answer, F.struct((-size).alias("s"), "turn"))).alias("chosen"),
            F.min_by("text", F.when(answer, F.struct(size.alias("s"), "turn"))).alias("rejected"),
        )

    # telemetry

    def series(self) -> DataFrame:
        return series_of(self.events)

    def log_lines(self) -> DataFrame:
        return log_lines_of(self.events)

    def exits(self) -> DataFrame:
        return self.series().groupBy("run").agg(
            ((F.max("ts") - F.min("ts")) / 1e6).alias("elapsed_seconds")
        ).withColumn("exit_code", F.when(F.col("run") % 3 == 0, 1).otherwise(0))

    def stage_events(self) -> DataFrame:
        return stage_events_of(self.events)

    def entries(self) -> DataFrame:
        """Registrations: one per signup event."""
        return self.events.where("event_type = 'signup'").select(
            F.col("user_id").alias("version"), dataset_tag(F.concat(F.lit("area_"), F.col("user_id") % 10)).alias("dataset"),
            F.concat(F.lit("area_"), F.col("user_id") % 10).alias("weakness_targeted"),
            F.expr("case when value < 10 then '{bad' else props end").alias("training_metrics"),
            wall_micros("ts").alias("ts"), F.col("event_id").alias("seq"),
        )

    # comparison

    def metric_tables(self) -> tuple[DataFrame, DataFrame]:
        """Mean value per user and type before and after a day; cents are summed exactly."""
        early = F.col("ts") < F.lit(CUT_DAY).cast("timestamp_ntz")

        def side(condition: Column) -> DataFrame:
            return self.events.where(condition).groupBy(
                F.col("user_id").alias("version"), F.col("event_type").alias("metric")
            ).agg((F.sum(F.round(F.col("value") * 100).cast("long")) / F.count("*") / 100).alias("value"))

        return side(early), side(~early)

    def offers(self) -> DataFrame:
        """Parts as offers; the group is the part's brand."""
        return self.part.select(
            F.col("p_partkey").alias("offer_id"), F.col("p_type").alias("kind"), F.col("p_brand").alias("region"),
            F.col("p_size").alias("ram"), F.col("p_retailprice").alias("price"),
            ((F.col("p_partkey") % 20) / 20).alias("reliability"),
        )

    def reservations(self) -> DataFrame:
        """Suppliers as instances, nested per nation."""
        instance = F.struct(
            F.col("s_name").alias("instance_id"),
            F.concat(F.lit("type-"), F.col("s_nationkey").cast("string")).alias("instance_type"),
            F.when(F.col("s_acctbal") > 0, "running").alias("state"),
            F.when(F.col("s_acctbal") > 5000, F.array(F.struct(
                F.lit("Name").alias("key"), F.concat(F.lit("node "), F.col("s_suppkey").cast("string")).alias("value")
            ))).otherwise(F.array().cast("array<struct<key:string,value:string>>")).alias("tags"),
        )
        return self.supplier.select(F.array(instance).alias("instances"))

    def specs(self) -> DataFrame:
        return self.nation.where("n_regionkey <> 0").select(
            F.concat(F.lit("type-"), F.col("n_nationkey").cast("string")).alias("instance_type"),
            F.col("n_name").alias("gpu_type"), F.col("n_regionkey").alias("gpu_count"),
            (F.col("n_regionkey") * 16).alias("gpu_ram_gb"),
        )

    def vector_pairs(self) -> DataFrame:
        """Texts of 16 token vectors; the first 8 are the prediction."""
        placed = self.embeddings.select(
            F.floor(F.col("vec_id") / 16).cast("long").alias("id"), (F.col("vec_id") % 16 < 8).alias("p"),
            F.struct("vec_id", F.col("embedding").cast("array<double>").alias("v")).alias("e"),
        )
        side = lambda flag: F.transform(F.array_sort(F.collect_list(F.when(F.col("p") == flag, F.col("e")))), lambda e: e["v"])
        return placed.groupBy("id").agg(
            side(True).alias("prediction_vectors"), side(False).alias("reference_vectors")
        )


def series_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("run"), F.col("event_type").alias("metric"), "value",
        wall_micros("ts").alias("ts"), F.col("event_id").alias("seq"),
    )


def stage_events_of(events: DataFrame) -> DataFrame:
    stages = {"signup": "registered", "view": "evaluated", "click": "staged", "purchase": "production", "error": "retired"}
    chain = F.lit(None).cast("string")
    for kind, stage in stages.items():
        chain = F.when(F.col("event_type") == kind, stage).otherwise(chain)
    return events.select(
        F.col("user_id").alias("version"), chain.alias("stage"),
        wall_micros("ts").alias("ts"), F.col("event_id").alias("seq"),
    )


def log_lines_of(events: DataFrame) -> DataFrame:
    """Events as the lines of a run's log: run, seq, line."""
    number = F.col("value").cast("string")
    end = F.when(F.col("event_id") % 11 == 0, "").otherwise("}")
    ident = F.col("event_id").cast("string")
    loss_name = F.when(F.col("event_id") % 5 == 0, "train_loss").otherwise("loss")
    again = F.when(F.col("event_id") % 17 == 0, ' __PROGRESS__:{"step": 1}').otherwise("")
    progress = F.concat(
        F.lit('__PROGRESS__:{"step": '), ident, F.lit(', "epoch": '), number, F.lit(', "'), loss_name, F.lit('": '),
        number, F.lit(', "elapsed_seconds": '), number, end, again,
    )
    metrics = lambda marker: F.concat(F.lit(f'{marker}{{"f1": '), number, end)
    line = (
        F.when(F.col("event_id") % 13 == 0, "   ")
        .when(F.col("event_type") == "view", progress)
        .when(F.col("event_type") == "purchase", metrics("__FINAL_METRICS__:"))
        .when((F.col("event_type") == "signup") & (F.col("value") >= 50), "  done __TRAINING_COMPLETE__")
        .when(F.col("event_type") == "signup", metrics("__BASELINE_METRICS__:"))
        .when(F.col("event_type") == "click", metrics("__EVAL_METRICS__:"))
        .otherwise(F.concat(F.lit("plain text "), F.col("props")))
    )
    return events.select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), line.alias("line"))
