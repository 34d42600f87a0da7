"""Checks on instruction pairs: format issues, duplicates, length statistics, report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.functions.numbers import round_to
from gradeflow.functions.text import is_blank, pair_hash, word_count
from gradeflow.operators.ordering import top_per_group

# The fields every pair must have.
FIELDS = ("instruction", "output")


def union_splits(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    return train.withColumn("split", F.lit("train")).unionByName(
        evaluation.withColumn("split", F.lit("eval"))
    )


def missing_fields(required: Sequence[str] = FIELDS) -> Column:
    """Required field names without a value in this row."""
    present = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in required]))
    return F.array_except(F.array(*[F.lit(c) for c in required]), present)


def issues_of_row() -> Column:
    """Issue texts of one row; a missing instruction or output is reported as empty, too."""
    checks = [
        F.when(F.size(missing_fields()) > 0,
               F.concat(F.lit("missing fields: "), F.array_join(F.array_sort(missing_fields()), ","))),
        F.when(is_blank("instruction"), "empty instruction"),
        F.when(is_blank("output"), "empty output"),
    ]
    return F.array_compact(F.array(*checks))


def flag_issues(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Narrow rows: the ``keep`` columns and the row's ``issues``; texts are left behind."""
    return df.select(*keep, issues_of_row().alias("issues"))


def format_issues(df: DataFrame, index: str = "position", keep: Sequence[str] = ("split",)) -> DataFrame:
    """One row per violation, in the order of the checks. Rows may have their ``issues`` already."""
    issues = F.col("issues") if "issues" in df.columns else issues_of_row()
    return df.select(*keep, F.col(index).alias("idx"), F.posexplode(issues).alias("check", "issue"))


def issue_report(issues: DataFrame, k: int = 10) -> DataFrame:
    """First k issues per split and one line that counts the others."""
    shown = top_per_group(issues, ["split"], ["idx", "check"], k).select(
        "split", F.col("rank").cast("long").alias("line"),
        F.concat(F.lit("record "), F.col("idx").cast("string"), F.lit(": "), F.col("issue")).alias("message"),
    )
    counted = issues.groupBy("split").agg(F.count("*").alias("n")).where(F.col("n") > k)
    rest = counted.select(
        "split", F.lit(k + 1).cast("long").alias("line"),
        F.concat(F.lit("... and "), (F.col("n") - k).cast("string"), F.lit(" more issues")).alias("message"),
    )
    return shown.unionByName(rest)


def exact_duplicates(df: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """Rows, distinct pairs and repeats. Counts per hash first, so copies collapse before the shuffle."""
    per_pair = df.groupBy(*by, pair_hash("instruction", "output").alias("_pair")).agg(F.count("*").alias("_n"))
    return per_pair.groupBy(*by).agg(
        F.sum("_n").alias("n"), F.count("*").alias("n_unique"),
        (F.sum("_n") - F.count("*")).alias("n_duplicates"),
    )


def length_stats(df: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """Rows and average (rounded to 1), least and most words of instruction and output."""
    counted = df.select(*by, word_count("instruction").alias("i"), word_count("output").alias("o"))

    def stats(c: str, name: str) -> list[Column]:
        return [F.coalesce(round_to(F.avg(c), 1), F.lit(0.0)).alias(f"avg_{name}_words"),
                F.coalesce(F.min(c), F.lit(0)).alias(f"min_{name}_words"),
                F.coalesce(F.max(c), F.lit(0)).alias(f"max_{name}_words")]

    return counted.groupBy(*by).agg(F.count("*").alias("n"), *stats("i", "instruction"), *stats("o", "output"))


def validation_report(df: DataFrame, splits: Sequence[str] = ("train", "eval")) -> DataFrame:
    """One row per expected split. Only a split without a file makes the dataset invalid.

    ``df`` holds pairs with ``split``; duplicates and empty fields are counted, not fatal.
    """
    base = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in splits])).alias("split"))
    measured = df.select(
        "split", pair_hash("instruction", "output").alias("_pair"), F.size(issues_of_row()).alias("_issues"),
        word_count("instruction").alias("i"), word_count("output").alias("o"),
    )
    # one pass: everything is counted per distinct pair, then per split
    per_pair = measured.groupBy("split", "_pair").agg(
        F.count("*").alias("_n"), F.sum("_issues").alias("_issues"), F.sum("i").alias("_i"), F.sum("o").alias("_o"),
        F.max("i").alias("i"), F.max("o").alias("o"), F.min("i").alias("i0"), F.min("o").alias("o0"),
    )

    def words_of(total: str, least: str, most: str, name: str) -> list[Column]:
        return [round_to(F.sum(total) / F.sum("_n"), 1).alias(f"avg_{name}_words"),
                F.min(least).alias(f"min_{name}_words"), F.max(most).alias(f"max_{name}_words")]

    figures = per_pair.groupBy("split").agg(
        F.sum("_n").alias("n"), *words_of("_i", "i0", "i", "instruction"), *words_of("_o", "o0", "o", "output"),
        F.count("*").alias("n_unique"), (F.sum("_n") - F.count("*")).alias("n_duplicates"),
        F.sum("_issues").alias("n_issues"),
    )
    return base.join(figures, "split", "left").withColumn("valid", F.col("n").isNotNull())
