"""File listings, manifests and catalog profiles."""

from __future__ import annotations

import csv
import json
from collections.abc import Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeflow.functions.text import is_blank, is_json, keyword_hits, text_of
from gradeflow.operators.ordering import beside, head_limit, top_per_group
from gradeflow.session import materialize, scratch_path
from gradeflow.sources.readers import CATALOG_SUFFIXES, count_jsonl
from gradeflow.sources.writers import BUNDLE

MB = 1024 * 1024


def artifact_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Recursive listing (path, dir, name, bytes); file contents are never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root).select(
        "path",
        F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"),
        F.regexp_extract("path", r"([^/]*)$", 1).alias("name"),
        F.col("length").alias("bytes"),
    )


def artifact_inventory(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """File count and total MB per folder."""
    return (
        artifact_files(spark, root, glob).groupBy("dir")
        .agg(F.count("*").alias("n_files"), F.round(F.sum("bytes") / MB, 2).alias("total_mb"))
    )


def dataset_manifest(
    spark: SparkSession, root: str, version: str, source: str, weakness: str = "general"
) -> DataFrame:
    """One manifest row for a version folder with ``split=<name>`` parts.

    Sizes are rounded per split; the total is the sum of the rounded sizes, rounded again.
    """
    split = F.regexp_extract("path", r"split=([^/]+)/", 1).alias("split")
    sizes = artifact_files(spark, root, "*.json").groupBy(split).agg(
        F.round(F.sum("bytes") / MB, 2).alias("size_mb")
    )
    counts = (
        count_jsonl(spark, f"{root}/split=*").groupBy(split).agg(F.sum("records").alias("records"))
    )
    files = F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("split", F.struct(F.concat(F.lit("split="), F.col("split")).alias("path"), "records", "size_mb"))
    )))
    return sizes.join(counts, "split").agg(
        files.alias("files"),
        F.sum("records").alias("total_records"),
        F.round(F.sum("size_mb"), 2).alias("total_size_mb"),
    ).select(
        F.lit(version).alias("version"), F.lit(source).alias("source"),
        F.lit(weakness).alias("weakness_target"), F.lit("alpaca").alias("format"),
        F.current_timestamp().alias("created_at"), "files", "total_records", "total_size_mb",
    )


def profile_table(
    df: DataFrame, name: str, suffix: str, order: Sequence[str], size_bytes: int | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Catalog entry of one file: count, columns and the first three records as JSON."""
    columns = list(columns or df.columns)
    samples = head_limit(df, order, 3).agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct(*order, F.to_json(F.struct(*columns)).alias("_json")))),
            lambda s: s["_json"]), "\n").alias("samples")
    )
    counted = df.agg(F.count("*").alias("record_count")).select(
        F.lit(name).alias("name"), F.lit(suffix).alias("extension"),
        F.lit(None if size_bytes is None else round(size_bytes / MB, 2)).cast("double").alias("size_mb"),
        "record_count", F.lit(",".join(columns)).alias("columns"),
        F.lit(None).cast("string").alias("error"),
    )
    return beside(counted, samples)


def failed_profile(spark: SparkSession, name: str, suffix: str, error: Exception) -> DataFrame:
    """Catalog entry of a file that cannot be read: the error text stands in for the figures."""
    return spark.range(1).select(
        F.lit(name).alias("name"), F.lit(suffix).alias("extension"),
        F.lit(None).cast("double").alias("size_mb"), F.lit(None).cast("long").alias("record_count"),
        F.lit(None).cast("string").alias("columns"), F.lit(str(error)).alias("error"),
        F.lit(None).cast("string").alias("samples"),
    )


PROFILE = T.StructType([T.StructField(n, T.StringType()) for n in ("columns", "samples", "error")])


@F.pandas_udf(PROFILE)
def _describe(suffix: pd.Series, lines: pd.Series) -> pd.DataFrame:
    """Columns and sample records (JSON, one per line) from the first four lines of a file at most."""
    rows = []
    for kind, text in zip(suffix, lines):
        try:
            rows.append((*_first_records(kind, [] if text is None else list(text)), None))
        except (ValueError, csv.Error) as e:
            rows.append((None, None, str(e)))
    return pd.DataFrame(rows, columns=["columns", "samples", "error"])


def _first_records(kind: str, lines: list[str]) -> tuple[str | None, str]:
    write = lambda records: "\n".join(json.dumps(r, ensure_ascii=False) for r in records)
    if kind == ".txt":
        return "text", write({"text": t.strip()} for t in lines[:3])
    if kind == ".jsonl":
        records = [json.loads(t) for t in lines[:3] if t.strip()]
        return ",".join(records[0]) if records and isinstance(records[0], dict) else None, write(records)
    reader = csv.DictReader(lines, delimiter="\t" if kind == ".tsv" else ",")
    return ",".join(reader.fieldnames or []), write(list(reader)[:3])


def _suffix(name: str) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))


def _line_profiles(spark: SparkSession, root: str) -> DataFrame:
    """Profiles of all line files in one pass: lines are counted, and four of each file travel."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jsonl,csv,tsv,txt}").text(root).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("seen"), text_of("value").alias("line"))
    kind = _suffix("path").alias("extension")
    counts = lines.groupBy("path").agg(F.count("*").alias("lines"), F.count_if(~is_blank("line")).alias("filled"))
    # blank lines are no records
    shown = lines.where((_suffix("path") != ".jsonl") | ~is_blank("line"))
    head = top_per_group(shown, ["path"], ["at", "seen"], 4).groupBy("path").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]).alias("head"))
    found = counts.join(head, "path", "left").select("path", kind, "lines", "filled", _describe(kind, "head").alias("p"))
    records = (
        F.when(F.col("p.error").isNotNull(), None).when(F.col("extension") == ".jsonl", F.col("filled"))
        .when(F.col("extension") == ".txt", F.col("lines")).otherwise(F.col("lines") - 1)
    )
    return found.select("path", records.alias("record_count"), "p.columns", "p.error", "p.samples")


def _document_profiles(spark: SparkSession, root: str) -> DataFrame:
    """Profiles of JSON documents: an array of records, or one object."""
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("wholetext", True).text(root)
    text = F.trim("value")
    records = F.json_array_length(text)
    first = F.coalesce(F.get_json_object(text, "$[0]"), F.when(F.substring(text, 1, 1) == "{", text))
    keys = F.json_object_keys(first)
    fine = is_json(text)
    samples = F.array_compact(F.array(*[F.get_json_object(text, f"$[{i}]") for i in range(3)]))
    return whole.select(
        F.col("_metadata.file_path").alias("path"), F.when(fine, records).cast("long").alias("record_count"),
        F.when(fine, F.array_join(keys, ",")).alias("columns"), F.when(~fine, "not readable as JSON").alias("error"),
        F.when(fine, F.array_join(samples, "\n")).alias("samples"))


def _table_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles of the parquet files of one folder, which share a schema."""
    try:
        df = spark.read.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(folder)
        rows = df.select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at"), F.to_json(F.struct("*")).alias("json"))
        counts = df.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("record_count"))
        head = rows.where("at < 3").groupBy("path").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "json"))), lambda x: x["json"]), "\n").alias("samples"))
        return counts.join(head, "path", "left").select(
            "path", "record_count", F.lit(",".join(df.columns)).alias("columns"), F.lit(None).cast("string").alias("error"), "samples")
    except AnalysisException as e:
        return spark.createDataFrame([(folder, None, None, str(e), None)], "path string, record_count long, columns string, error string, samples string")


def scan_catalog(spark: SparkSession, root: str, topic: str) -> DataFrame:
    """All data files below ``root``, most relevant to the topic first; hidden files and other suffixes are left out.

    Line files and JSON documents are profiled in one job each, parquet files in one per
    folder; profiles go to a table as they come, so the plan does not grow with the files.
    """
    files = artifact_files(spark, root).withColumn("extension", _suffix("name")).where(F.col("extension").isin(*CATALOG_SUFFIXES))
    files = materialize(files, "files")
    if files.isEmpty():
        raise ValueError(f"no data files below {root}")
    path = scratch_path(spark, "profiles")
    here = lambda *kinds: not files.where(F.col("extension").isin(*kinds)).isEmpty()
    store = lambda profiles: profiles.write.mode("append").parquet(path)
    if here(".jsonl", ".csv", ".tsv", ".txt"):
        store(_line_profiles(spark, root))
    if here(".json"):
        store(_document_profiles(spark, root))
    for row in files.where("extension = '.parquet'").select("dir").distinct().toLocalIterator():
        store(_table_profiles(spark, row["dir"]))
    kinds = "path string, record_count long, columns string, error string, samples string"
    # both listings name a file alike but for how they write the scheme
    place = lambda c: F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")
    found = spark.read.schema(kinds).parquet(path).withColumn("_place", place(F.col("path"))).drop("path")
    placed = files.withColumn("_place", place(F.col("path")))
    profiles = placed.join(found, "_place", "left").select(
        "dir", "name", "extension", F.round(F.col("bytes") / MB, 2).alias("size_mb"), F.coalesce("record_count", F.when(
            F.col("extension").isin(".jsonl", ".txt") & (F.col("bytes") == 0), 0)).alias("record_count"), "columns", "error", "samples")
    return rank_by_relevance(profile_relevance(profiles, topic))


def profile_relevance(profiles: DataFrame, topic: str) -> DataFrame:
    """Topic words found in name, columns and sample records of each catalog entry."""
    haystack = F.concat_ws(" ", "name", F.translate("columns", ",", " "), "samples")
    return profiles.withColumn("relevance", keyword_hits(haystack, topic))


def rank_by_relevance(profiles: DataFrame, *tie: Column | str) -> DataFrame:
    """Most relevant first, then the larger file; unknown counts last, name as final key."""
    return profiles.orderBy(
        F.col("relevance").desc(), F.col("record_count").desc_nulls_last(), *(tie or ("name",))
    )


def relevant_only(profiles: DataFrame) -> DataFrame:
    return profiles.where(F.col("relevance") > 0)


def dataset_line_counts(spark: SparkSession, root: str, glob: str = "split=train") -> DataFrame:
    """Train lines per dataset folder below ``root``."""
    lines = spark.read.text(f"{root}/*/{glob}")
    name = F.regexp_extract("_metadata.file_path", r"/([^/]+)/split=[^/]+/[^/]*$", 1)
    return lines.select(name.alias("dataset")).groupBy("dataset").agg(F.count("*").alias("train_lines"))


def result_status(spark: SparkSession, root: str, bundled: bool = False) -> DataFrame:
    """Per result folder: the first recommendation line of its report, else a metrics note.

    Folders with neither a report nor a metrics file give no row. Files may be plain files
    or folders a Spark job wrote, and folder names may carry a ``key=`` prefix. ``bundled``
    reads a folder of ``write_result_bundle`` instead, whose files hold many results each.
    """
    parts = _bundled_lines(spark, root) if bundled else _result_lines(spark, root)
    is_report = F.col("file") == "report.yaml"
    return (
        parts.where(F.col("file").isin("report.yaml", "eval_metrics.json")).groupBy("result").agg(
            F.min_by("word", F.when(is_report & F.col("word").isNotNull(), F.col("place"))).alias("word"),
            F.max(is_report).alias("has_report"),
        )
        .select("result", F.when(F.col("has_report"), F.coalesce("word", F.lit("")))
                .otherwise("metrics available (no report)").alias("status"))
    )


def _recommended(line: str) -> Column:
    return F.nullif(F.regexp_extract(line, r"recommendation:\s*(\S+)", 1), F.lit("")).alias("word")


def _bundled_lines(spark: SparkSession, root: str) -> DataFrame:
    """(result, file, word, place) of the lines of a bundle."""
    lines = spark.read.schema(BUNDLE).parquet(root).select("result", "file", text_of("line").alias("line"), "line_no")
    return lines.select("result", "file", _recommended("line"), F.struct("line_no").alias("place"))


def _result_lines(spark: SparkSession, root: str) -> DataFrame:
    """(result, file, word, place) of the lines of all files below ``root``."""
    lines = spark.read.option("recursiveFileLookup", True).text(root).select(
        F.split_part(F.col("_metadata.file_path"), F.lit(f"{root.rstrip('/')}/"), F.lit(-1)).alias("rel"),
        text_of("value").alias("line"),
        F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("seen"),
    )
    segment = lambda i: F.regexp_replace(F.split_part("rel", F.lit("/"), F.lit(i)), "^[^=]*=", "")
    return lines.select(segment(1).alias("result"), segment(2).alias("file"), _recommended("line"),
                        F.struct("rel", "at", "seen").alias("place"))
