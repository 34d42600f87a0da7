"""One total order of all rows, cut into ranges that tasks sort by themselves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradeflow.session import materialize

#: Bits of ``seq`` that number the rows of a range.
ROW_BITS = 33


def in_order(rows: DataFrame, order: Sequence[str], name: str, ranges: int | None = None, seq: str = "seq") -> DataFrame:
    """``rows``, stored, with ``seq``: a unique number that rises along ``order``, nulls first.

    Rows are dealt out by ranges of the whole order and, behind it, of their place in the
    input, so that neither a hot group nor equal rows meet in one task. The borders are sampled from the
    rows; without ``ranges`` their number is that of shuffle partitions.
    """
    placed = rows.withColumn("_place", F.monotonically_increasing_id())
    count = [ranges] if ranges else []
    ranges = placed.repartitionByRange(*count, *order, "_place").sortWithinPartitions(*order, "_place").drop("_place")
    # the number of the range, then that of the row in it
    return materialize(ranges.withColumn(seq, F.monotonically_increasing_id()), name)


def range_of(seq: str = "seq") -> Column:
    """The range that a row of ``in_order`` is in."""
    return F.shiftright(seq, ROW_BITS)


def with_positions(ordered: DataFrame, group: str | Sequence[str] | None, seq: str = "seq") -> DataFrame:
    """The rows of ``in_order`` (by ``group`` first, if any) with ``first``, ``pos`` and ``n``.

    ``first`` is the seq of the group's first row, a number for the group that rises with it; ``pos`` counts its
    rows from 0; ``n`` is their number. Ranges that a group spans are added up, never its rows.
    """
    keys = [group] if isinstance(group, str) else list(group or ())
    runs = ordered.groupBy(*keys, range_of(seq).alias("_range")).agg(F.min(seq).alias("_run"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        *[F.col(k).alias(f"_of_{k}") for k in keys], "_range", "_run", F.min("_run").over(whole).alias("first"),
        F.sum("_rows").over(whole).alias("n"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    same = range_of(seq) == F.col("_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return ordered.join(runs, same).select(*ordered.columns, "first", (F.col(seq) - F.col("_run") + F.col("_before")).alias("pos"), "n")
