"""Grading a multiple-choice submission against hidden truth.

truth: id, answer_idx, meta_info.  submission: id, predicted_idx and an order column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gradeflow.functions.text import col, strip
from gradeflow.sources.readers import require_columns

# The valid answers.
CHOICES = ("A", "B", "C", "D")


def clean_prediction(c: Column | str) -> Column:
    """Trimmed upper-case text; a missing value becomes the (invalid) text NAN."""
    c = col(c).cast("string")
    return F.when(c.isNull(), "NAN").otherwise(F.upper(strip(c)))


def clean_submission(submission: DataFrame) -> DataFrame:
    """Required columns checked, ids made integer (a bad id fails), predictions cleaned."""
    require_columns(submission, ["id", "predicted_idx"], "submission")
    bad_id = F.raise_error(F.lit("submission ids must be integers")).cast("long")
    return submission.withColumn("id", F.coalesce(F.col("id").cast("long"), bad_id)).withColumn(
        "predicted_idx", clean_prediction("predicted_idx")
    )


def first_submission(submission: DataFrame, order: Sequence[str]) -> DataFrame:
    """First row per id in file order, with the number of repeats left out.

    An aggregate, not a window: each task keeps one row per id before the shuffle, so an id
    that fills a third of the file costs no more than any other.
    """
    place = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return submission.groupBy("id").agg(
        F.min_by("predicted_idx", place).alias("predicted_idx"), (F.count("*") - 1).alias("n_repeats")
    )


def score_submission(truth: DataFrame, submission: DataFrame, order: Sequence[str]) -> DataFrame:
    """Every truth row with its cleaned first prediction; invalid or missing is "" and wrong."""
    require_columns(truth, ["id", "answer_idx", "meta_info"], "truth")
    first = first_submission(clean_submission(submission), order).select("id", "predicted_idx")
    joined = truth.join(first, "id", "left")
    valid = F.coalesce(F.col("predicted_idx").isin(*CHOICES), F.lit(False))
    return joined.withColumn("predicted_idx", F.when(valid, F.col("predicted_idx")).otherwise("")).withColumn(
        "correct",
        F.coalesce(F.col("predicted_idx") == F.col("answer_idx"), F.lit(False)),
    )


def missing_predictions(truth: DataFrame, submission: DataFrame) -> DataFrame:
    return truth.join(submission.select(F.col("id").cast("long")), "id", "left_anti")


def extra_predictions(truth: DataFrame, submission: DataFrame) -> DataFrame:
    """Submitted ids that are not in the truth, one row per id with its number of rows."""
    ids = submission.groupBy(F.col("id").cast("long").alias("id")).agg(F.count("*").alias("n_rows"))
    return ids.join(truth, "id", "left_anti")


def extra_id_set(truth: DataFrame, submission: DataFrame) -> DataFrame:
    return submission.select(F.col("id").cast("long").alias("id")).subtract(truth.select("id"))


def invalid_predictions(graded: DataFrame) -> DataFrame:
    """Graded rows outside A-D, missing ones included."""
    return graded.where(F.col("predicted_idx") == "")


def _accuracy() -> list[Column]:
    hit = F.col("correct").cast("long")
    return [F.avg(hit).alias("accuracy"), F.count("*").alias("n_total"), F.sum(hit).alias("n_correct")]


def _with_total(per_slice: DataFrame, *columns: Column) -> DataFrame:
    """Grouping sets over counts per slice; the rows themselves are never expanded."""
    both = per_slice.groupingSets([[], ["meta_info"]], "meta_info").agg(
        F.grouping("meta_info").cast("boolean").alias("is_total"), *columns
    )
    return both.where(F.col("is_total") | F.col("meta_info").isNotNull())


def accuracy_overall(graded: DataFrame) -> DataFrame:
    return graded.agg(*_accuracy())


def accuracy_by_slice(graded: DataFrame, slice_: str = "meta_info") -> DataFrame:
    """Rows without a slice are left out here; the overall figure keeps them."""
    return graded.where(F.col(slice_).isNotNull()).groupBy(slice_).agg(*_accuracy())


def accuracy_rollup(graded: DataFrame) -> DataFrame:
    """Total and slices in one pass; ``is_total`` tells the total from a null slice."""
    counts = graded.groupBy("meta_info").agg(
        F.sum(F.col("correct").cast("long")).alias("hits"), F.count("*").alias("rows")
    )
    return _with_total(
        counts, (F.sum("hits") / F.sum("rows")).alias("accuracy"), F.sum("rows").alias("n_total"),
        F.sum("hits").alias("n_correct"),
    )


def accuracy_delta_by_slice(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """Two graded submissions of one truth, compared overall and per slice."""
    def tagged(df: DataFrame, which: int) -> DataFrame:
        return df.select("meta_info", F.col("correct").cast("long").alias("hit"), F.lit(which).alias("which"))

    def mean(which: int) -> Column:
        here = F.col("which") == which
        return F.sum(F.when(here, F.col("hits"))) / F.sum(F.when(here, F.col("rows")))

    counts = tagged(base, 0).unionByName(tagged(tuned, 1)).groupBy("meta_info", "which").agg(
        F.sum("hit").alias("hits"), F.count("*").alias("rows")
    )
    return _with_total(counts, mean(0).alias("base_accuracy"), mean(1).alias("tuned_accuracy")).withColumn(
        "delta", F.col("tuned_accuracy") - F.col("base_accuracy")
    )


def weakest_slices(graded: DataFrame, k: int = 3, min_rows: int = 30) -> DataFrame:
    return (
        accuracy_by_slice(graded).where(F.col("n_total") >= min_rows)
        .orderBy("accuracy", "meta_info").limit(k)
    )


def letter_macro_f1(graded: DataFrame) -> DataFrame:
    """Per letter tp, fp, fn and F1 (0 when undefined); the macro mean is on every row."""
    letters = F.explode(F.array(*[F.lit(c) for c in CHOICES])).alias("letter")
    counted = graded.groupBy("answer_idx", "predicted_idx").agg(F.count("*").alias("n"))
    per = counted.select("*", letters).groupBy("letter").agg(
        _count_if((F.col("answer_idx") == F.col("letter")) & (F.col("predicted_idx") == F.col("letter"))).alias("tp"),
        _count_if((F.col("answer_idx") != F.col("letter")) & (F.col("predicted_idx") == F.col("letter"))).alias("fp"),
        _count_if((F.col("answer_idx") == F.col("letter")) & (F.col("predicted_idx") != F.col("letter"))).alias("fn"),
    )
    denominator = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    scored = per.withColumn("f1", F.when(denominator > 0, 2.0 * F.col("tp") / denominator).otherwise(0.0))
    return scored.withColumn("macro_f1", F.avg("f1").over(W.partitionBy()))  # four rows


def _count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("n")).otherwise(0))


def score_confidence(graded: DataFrame, slice_: str = "meta_info", z: float = 1.96) -> DataFrame:
    """Accuracy per slice with the normal interval, clipped to [0, 1]."""
    half = z * F.sqrt(F.col("accuracy") * (1 - F.col("accuracy")) / F.col("n_total"))
    return accuracy_by_slice(graded, slice_).select(
        slice_, "accuracy", "n_total",
        F.greatest(F.lit(0.0), F.col("accuracy") - half).alias("low"),
        F.least(F.lit(1.0), F.col("accuracy") + half).alias("high"),
    )
