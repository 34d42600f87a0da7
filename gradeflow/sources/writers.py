"""Sinks. JSON sinks keep null fields and write UTF-8 unescaped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
    return path


def write_json_arrays(df: DataFrame, path: str, key: str, per_file: int) -> str:
    """JSON array files; each holds the rows of one range of ``per_file`` key values."""
    part = F.floor(F.col(key) / per_file).alias("part")
    rows = F.to_json(F.collect_list(F.struct(*df.columns)), {"ignoreNullFields": "false"}).alias("value")
    df.groupBy(part).agg(rows).write.partitionBy("part").text(path)
    return path


def write_split_dataset(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Train and eval parts as ``split=<name>`` folders below one version folder.

    Every task writes at most one file per split; no shuffle is needed.
    """
    df.write.mode(mode).partitionBy("split").option("ignoreNullFields", False).json(path)
    return path


#: A line of a file of a result; ``line_no`` grows within the file.
BUNDLE = "result string, file string, line_no long, line string"


def write_result_bundle(lines: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """The files of many results as rows of ``BUNDLE``, one file per task: their number does not grow with the results."""
    lines.select("result", "file", F.col("line_no").cast("long"), "line").write.mode(mode).parquet(path)
    return path


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> str:
    df.write.mode(mode).option("header", True).option("sep", sep).option("escape", '"').csv(path)
    return path


def write_graded_csv(graded: DataFrame, path: str) -> str:
    """Row-level audit of a graded submission."""
    return write_csv(graded.select("id", "answer_idx", "predicted_idx", "meta_info"), path)


def score_document(rollup: DataFrame) -> DataFrame:
    """One row: overall figures and a map slice -> (accuracy, n), from ``accuracy_rollup``.

    The map holds one entry per slice name, which is bounded by the slice vocabulary.
    """
    total = F.col("is_total")
    entry = F.when(~total, F.struct(F.col("meta_info"), F.struct("accuracy", F.col("n_total").alias("n"))))
    return rollup.agg(
        F.max(F.when(total, F.col("accuracy"))).alias("overall_accuracy"),
        F.max(F.when(total, F.col("n_total"))).alias("n_total"),
        F.max(F.when(total, F.col("n_correct"))).alias("n_correct"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("by_meta_info"),
    )


def write_score_json(rollup: DataFrame, path: str) -> str:
    return write_jsonl(score_document(rollup), path)


def write_eval_details(pairs: DataFrame, metrics: DataFrame, path: str) -> tuple[str, str]:
    """Pairs and the metric map side by side; returns both paths."""
    details = write_jsonl(pairs.select("prediction", "reference"), f"{path}/eval_details.jsonl")
    one_map = metrics.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics"))
    return details, write_jsonl(one_map, f"{path}/eval_metrics.json")
