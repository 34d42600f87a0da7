"""Readers for the file layouts of the loop: JSON, JSON lines, CSV, TSV, parquet, text."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from gradeflow.functions.text import is_blank, is_json

CORRUPT = "_corrupt_record"
# Suffixes a dataset load accepts, and those a catalog scan accepts.
DATASET_SUFFIXES = (".json", ".jsonl", ".csv", ".parquet")
CATALOG_SUFFIXES = (".jsonl", ".json", ".csv", ".parquet", ".txt", ".tsv")


def read_dataset(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None,
    suffix: str | None = None, accept: Sequence[str] = DATASET_SUFFIXES, multi_line: bool = False,
) -> DataFrame:
    """Read by file suffix; an unknown suffix or a missing path raises.

    ``suffix`` names the format of a folder. Give a schema to skip the inference pass.
    ``multi_line`` allows quoted line breaks in CSV and TSV files (see ``read_csv``).
    """
    kind = (suffix or PurePosixPath(path).suffix).lower()
    if kind not in accept:
        raise ValueError(f"unsupported file type {kind!r}, expected one of {list(accept)}")
    reader = spark.read
    if schema is not None and kind != ".txt":
        reader = reader.schema(schema)
    if kind == ".json":
        return reader.option("multiLine", True).json(path)
    if kind == ".jsonl":
        return reader.json(path)
    if kind == ".csv":
        return read_csv(spark, path, ",", schema, multi_line)
    if kind == ".tsv":
        return read_csv(spark, path, "\t", schema, multi_line)
    if kind == ".parquet":
        return reader.parquet(path)
    return read_lines(spark, path)


def read_csv(
    spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Header line and RFC quotes; without a schema all columns are strings.

    Files are split among tasks. ``multi_line`` allows quoted line breaks, at the price of
    one task per file.
    """
    reader = (
        spark.read.option("header", True).option("sep", sep).option("multiLine", multi_line)
        .option("escape", '"')
    )
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row ``text`` per line."""
    return spark.read.text(path).withColumnRenamed("value", "text")


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed lines). Blank lines are in neither."""
    lines = spark.read.text(path).where(~is_blank("value"))
    return split_json(lines, "value", schema)


def split_json(
    lines: DataFrame, value: str, schema: T.StructType, keep: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Parse a JSON text column; rows that fail to parse go to the second table unchanged."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = lines.withColumn(
        "_parsed", F.from_json(value, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    )
    bad = F.col(f"_parsed.{CORRUPT}").isNotNull() | F.col("_parsed").isNull() | ~is_json(value)
    good_rows = parsed.where(~bad).select(*keep, *[F.col(f"_parsed.{f.name}") for f in schema.fields])
    return good_rows, parsed.where(bad).select(*keep, F.col(value).alias("line"))


def read_jsonl_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Blank lines are skipped; a malformed line fails the job, also if only rows are counted."""
    refuse = F.raise_error(F.concat(F.lit("malformed JSON line: "), F.col("value"))).cast("boolean")
    lines = spark.read.text(path).where(~is_blank("value")).where(F.when(is_json("value"), True).otherwise(refuse))
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("_r")).select("_r.*")


def count_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines per file, valid JSON or not."""
    return (
        spark.read.text(path)
        .select(F.col("_metadata.file_path").alias("path"), (~is_blank("value")).cast("long").alias("one"))
        .groupBy("path").agg(F.sum("one").alias("records"))
    )


def indexed_scan(df: DataFrame, name: str = "id") -> DataFrame:
    """Add the 0-based position of each row in its file (csv, json or text scans).

    A file split is read in order by one task, so the position is the row's place in its
    split plus the rows of the earlier splits of the file. Only per-split counts travel.
    """
    placed = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_seen"),
    )
    splits = placed.groupBy("_file", "_split").agg(
        F.min("_seen").alias("_first"), F.count("*").alias("_rows")
    )
    earlier = W.partitionBy("_file").orderBy("_split").rowsBetween(W.unboundedPreceding, -1)
    starts = splits.select(
        "_file", "_split", "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start")
    )
    return (
        placed.join(starts, ["_file", "_split"])
        .withColumn(name, F.col("_start") + F.col("_seen") - F.col("_first"))
        .drop("_file", "_split", "_seen", "_first", "_start")
    )


def parquet_indexed_scan(spark: SparkSession, path: str, name: str = "id") -> DataFrame:
    """Parquet carries the row position itself."""
    return spark.read.parquet(path).select("*", F.col("_metadata.row_index").alias(name))


def require_columns(df: DataFrame, required: Sequence[str], what: str) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing columns {missing}; it has {df.columns}")
    return df


def merge_sources(**sources: DataFrame) -> DataFrame:
    """One candidate set from several sources; absent columns become null."""
    merged = None
    for name, df in sources.items():
        tagged = df.withColumn("origin", F.lit(name))
        merged = tagged if merged is None else merged.unionByName(tagged, allowMissingColumns=True)
    if merged is None:
        raise ValueError("no sources given")
    return merged
