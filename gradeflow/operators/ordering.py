"""Total order at scale: positions, samples, exact splits, quantiles and row frames.

None of these sorts an unbounded group in one task. A count decides: groups of ordinary
size use a plain window; beyond that, rows are cut into ranges of the order column (or
prefixes of a hash), the ranges are counted, and only rows of one range meet in a task.
There are as many ranges as hold a set number of rows each.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gradeflow.functions.text import seed_hash
from gradeflow.operators.ranges import in_order, range_of, with_positions
from gradeflow.session import materialize

HOT_ROWS = 1_000_000  # rows of one group that one task may order
PREFIX = 4  # hex digits: at most 65,536 prefixes


def _check_order(df: DataFrame, c: str) -> None:
    """The same refusal at every size."""
    kind = dict(df.dtypes)[c]
    if not kind.startswith(("timestamp", "decimal")) and kind not in (
            "date", "string", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double"):
        raise ValueError(f"cannot order by {c}: {kind}")


def group_sizes(df: DataFrame, by: Sequence[str]) -> tuple[int, int]:
    """(rows of the largest group, all rows); only the keys are read and counted."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("total")).first()
    return sizes["most"] or 0, sizes["total"] or 0


def _ranged(df: DataFrame, keys: Sequence[str], total: int, ranges: int | None, hot_rows: int) -> DataFrame:
    """``df`` in the order of ``keys``, in ranges of about ``hot_rows`` rows, however many there are."""
    return in_order(df, keys, "ordered", ranges or max(1, -(-total // max(hot_rows, 1))), "_seq")


def with_position(
    df: DataFrame,
    order: Sequence[str],
    by: Sequence[str] = (),
    name: str = "position",
    ranges: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """0-based position by ``order`` (a unique key led by a number, time, date or text) within ``by``.

    If a count shows that no group exceeds ``hot_rows``, a window per group does it. Else
    the rows are cut into ranges of their order (``ranges`` of them, or as many as hold ``hot_rows`` each),
    with borders sampled from them, so a hot group is no hot task. Both ways take
    the same columns and give the same result, nulls first. Rows should be narrow.
    """
    by = list(by)
    _check_order(df, order[0])
    most, total = group_sizes(df, by)
    if most <= hot_rows:
        return df.withColumn(name, (F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1).cast("long"))
    placed = with_positions(_ranged(df, [*by, *order], total, ranges, hot_rows), by, "_seq")
    return placed.select(*df.columns, F.col("pos").alias(name))


def _join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner equi-join that lets null group keys meet."""
    renamed = right.select(
        *[F.col(k).alias(f"_right_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(renamed, condition).drop(*[f"_right_{k}" for k in keys])


def with_next(
    df: DataFrame, order: Sequence[str], columns: Sequence[str], by: Sequence[str] = (), ranges: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``next_<column>`` of the following row along ``order`` within ``by``.

    With a group over ``hot_rows``, looks ahead inside each range, and the last row of a
    range takes the head of the next range. Orders are those of ``with_position``.
    """
    by = list(by)
    _check_order(df, order[0])
    most, total = group_sizes(df, by)
    if most <= hot_rows:
        whole = W.partitionBy(*by).orderBy(*order)
        return df.select("*", *[F.lead(c).over(whole).alias(f"next_{c}") for c in columns])
    ranged = _ranged(df, [*by, *order], total, ranges, hot_rows).withColumn("_range", range_of("_seq"))
    heads = ranged.groupBy(*by, "_range").agg(F.min_by(F.struct(*columns), "_seq").alias("_head"))
    following = heads.select(
        *by, "_range", F.lead("_head").over(W.partitionBy(*by).orderBy("_range")).alias("_following")
    )
    inside = W.partitionBy(*by, "_range").orderBy("_seq")
    ahead = (
        _join_keys(ranged, following, [*by, "_range"])
        .withColumn("_next", F.coalesce(F.lead(F.struct(*columns)).over(inside), F.col("_following")))
    )
    return ahead.select(*df.columns, *[F.col(f"_next.{c}").alias(f"next_{c}") for c in columns])


def join_groups(rows: DataFrame, figures: DataFrame, by: Sequence[str], salts: int = 32) -> DataFrame:
    """Add the figures of its group (one row per group) to every row.

    Rows carry a salt made of their values and each group's figures are there once per
    salt, so the rows of a hot group spread over as many tasks, and what follows cannot
    reuse a partitioning that holds a whole group.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    copies = figures.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return _join_keys(salted, copies, [*by, "_salt"]).drop("_salt")


def hash_cutoff(
    df: DataFrame, key: str, n: Column | int, seed: int = 42
) -> tuple[int, tuple[str, str] | None]:
    """Total rows and the (hash, key text) of the n-th row in seeded hash order; keys are unique.

    Counts rows per hash prefix (bounded), finds the prefix that holds row n, and ranks
    only inside it. ``n`` may be a function of the total.
    """
    hashed = df.select(seed_hash(key, seed).alias("_hash"), F.col(key).cast("string").alias("_key"))
    prefix = F.substring("_hash", 1, PREFIX)
    counts = sorted(
        (r["p"], r["n"]) for r in hashed.groupBy(prefix.alias("p")).agg(F.count("*").alias("n")).collect()
    )
    total = sum(c for _, c in counts)
    wanted = min(n(total) if callable(n) else n, total)
    if wanted <= 0:
        return total, None
    before = 0
    for p, c in counts:
        if before + c >= wanted:
            break
        before += c
    last = (
        hashed.where(prefix == p).orderBy("_hash", "_key").limit(wanted - before)
        .agg(F.max(F.struct("_hash", "_key")).alias("m")).first()["m"]
    )
    return total, (last["_hash"], last["_key"])


def _up_to(key: str, seed: int, cutoff: tuple[str, str] | None) -> Column:
    if cutoff is None:
        return F.lit(False)
    h = seed_hash(key, seed)
    return (h < cutoff[0]) | ((h == cutoff[0]) & (F.col(key).cast("string") <= cutoff[1]))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (all, if there are fewer), the same ones on every engine and run.

    The data itself is only filtered, never shuffled or sorted.
    """
    _, cutoff = hash_cutoff(df, key, n, seed)
    return df.where(_up_to(key, seed, cutoff))


def exact_split(df: DataFrame, key: str, ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """Add ``split``: the first max(1, int(n * ratio)) rows in seeded order are eval."""
    _, cutoff = hash_cutoff(df, key, lambda n: max(1, int(n * ratio)), seed)
    return df.withColumn("split", F.when(_up_to(key, seed, cutoff), "eval").otherwise("train"))


def ratio_split(df: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """Trainer-side split: ceil(n * ratio) eval rows; ratio 0 leaves everything in train."""
    if ratio == 0:
        return df.withColumn("split", F.lit("train"))
    _, cutoff = hash_cutoff(df, key, lambda n: math.ceil(n * ratio), seed)
    return df.withColumn("split", F.when(_up_to(key, seed, cutoff), "eval").otherwise("train"))


def head_limit(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """First n rows in the stated order (plans as TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """First k rows per group. The rank filter lets Spark cut each group before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per distinct value (by..., value, n), stored once for the passes that follow."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("value")).agg(
        F.count("*").alias("n")
    )
    return materialize(counted, "value-counts")


def exact_quantiles(
    counts: DataFrame, probs: Sequence[float], by: Sequence[str] = (), ranges: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Interpolated quantiles, long form (by..., prob, value), from ``value_counts``.

    Equal values cost one row. With more than ``hot_rows`` distinct values in a group, the values are ranked
    within ranges of about so many, so a group never meets in a single task.
    """
    by = list(by)
    most, total = group_sizes(counts, by)
    if most <= hot_rows:
        ranged = counts.withColumn("_range", F.lit(0))
    else:
        ranged = _ranged(counts, [*by, "value"], total, ranges, hot_rows).withColumn("_range", range_of("_seq"))
    totals = ranged.groupBy(*by, "_range").agg(F.sum("n").alias("_rows"))
    whole = W.partitionBy(*by)
    starts = totals.select(
        *by, "_range",
        F.coalesce(
            F.sum("_rows").over(whole.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_start"),
        F.sum("_rows").over(whole).alias("_total"),
    )
    inside = W.partitionBy(*by, "_range").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    ranked = (
        _join_keys(ranged, starts, [*by, "_range"])
        .withColumn("_end", F.col("_start") + F.sum("n").over(inside))
        .withColumn("_begin", F.col("_end") - F.col("n"))
    )
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")
    places = ranked.select(*by, "value", "_begin", "_end", "_total", wanted).withColumn(
        "_place", F.col("prob") * (F.col("_total") - 1)
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_begin")) & (rank < F.col("_end")), F.col("value")))

    return (
        places.groupBy(*by, "prob")
        .agg(at(F.floor("_place")).alias("_low"), at(F.ceil("_place")).alias("_high"), F.first("_place").alias("_place"))
        .select(
            *by, "prob",
            (F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_place") - F.floor("_place")))
            .alias("value"),
        )
    )


#: Accuracy of the sketches that bracket a quantile, and the share of rows around it that a bracket takes.
SKETCH_K, MARGIN = 4096, 0.005


def bracketed_quantiles(df: DataFrame, value: str, probs: Sequence[float], hot_rows: int = HOT_ROWS, margin: float = MARGIN) -> DataFrame:
    """(prob, value): exact interpolated quantiles of a stored column, without shuffling its values.

    One pass makes a mergeable sketch of a few kilobytes, which gives a bracket of values around each rank. The next
    counts what is below each bracket and the different values in it. A bracket that misses its rank is
    widened, and one that holds more than ``hot_rows`` rows is sketched again, so that no task ranks more, however
    many rows there are. Nulls are left out; not-a-number is the largest value. No rows give no quantiles.
    """
    spark = df.sparkSession
    rows = df.select(F.col(value).cast("double").alias("v")).where("v is not null")
    usual = rows.where("not isnan(v)")
    n, odd = rows.agg(F.count("*"), F.count(F.when(F.isnan("v"), 1))).first()
    places = {float(p): float(p) * (n - 1) for p in probs}
    # ranks that fall among the numbers: rank -> value
    wanted = sorted({r for place in places.values() for r in (math.floor(place), math.ceil(place)) if 0 <= r < n - odd})
    known: dict[int, float] = {}
    ends = {r: (-math.inf, math.inf, 0, n - odd) for r in wanted}  # bracket, rows below it, rows in it
    share = dict.fromkeys(wanted, margin)
    v = F.col("v")
    while ends:
        if hot := [r for r, e in ends.items() if e[3] > hot_rows and share[r] <= 1]:
            around = []
            for r in hot:
                low, high, below, inside = ends[r]
                sketch = F.kll_sketch_agg_double(F.when(v.between(low, high), v), F.lit(SKETCH_K))  # equal ones are made once
                around += [F.kll_sketch_get_quantile_double(sketch, F.lit(min(1.0, max(0.0, (r - below) / inside + d)))) for d in (-share[r], share[r])]
            edges = list(usual.agg(*around).first())
            tight = {r: (edges[2 * i], edges[2 * i + 1]) for i, r in enumerate(hot)}
            counts = usual.agg(*[F.count(F.when(c, 1)) for a, z in tight.values() for c in (v < a, v.between(a, z))]).first()
            for i, (r, edge) in enumerate(tight.items()):
                below, inside = counts[2 * i], counts[2 * i + 1]
                if below <= r < below + inside and edge != ends[r][:2]:
                    ends[r] = (*edge, below, inside)
                else:
                    share[r] *= 4  # the rank lies outside, or the bracket got no narrower
        for r in [r for r, e in ends.items() if e[3] <= hot_rows or share[r] > 1 or e[0] == e[1]]:
            low, high, below, _ = ends.pop(r)
            if low == high:
                known[r] = low
                continue
            counted = usual.where(v.between(low, high)).groupBy("v").agg(F.count("*").alias("c"))
            upto = F.sum("c").over(W.orderBy("v").rowsBetween(W.unboundedPreceding, 0)) + below  # at most hot_rows values
            known[r] = counted.withColumn("upto", upto).where((F.col("upto") > r) & (F.col("upto") - F.col("c") <= r)).first()["v"]
    values = []
    for p, place in places.items():
        if n:
            a, z = (known.get(r, math.nan) for r in (math.floor(place), math.ceil(place)))
            values.append((p, a if a == z else a + (z - a) * (place - math.floor(place))))
    return spark.createDataFrame(values, "prob double, value double")


def beside(*rows: DataFrame) -> DataFrame:
    """One-row tables with different columns as one row."""
    merged = rows[0]
    for row in rows[1:]:
        merged = merged.unionByName(row, allowMissingColumns=True)
    return merged.agg(*[F.max(c).alias(c) for c in merged.columns])


def with_halo(df: DataFrame, position: str, before: int, block: int = 100_000) -> DataFrame:
    """Cut a positioned group into blocks that overlap by ``before`` rows.

    Adds ``_block`` and ``_halo``: frames of up to ``before`` preceding rows can then run per
    block; rows with ``_halo`` only serve as neighbours and are dropped afterwards.
    """
    if before > block:
        raise ValueError("the overlap must fit in one block")
    own = F.floor(F.col(position) / block).cast("long")
    copies = F.when(
        F.col(position) % block >= block - before,
        F.array(F.struct(own.alias("b"), F.lit(False).alias("h")),
                F.struct((own + 1).alias("b"), F.lit(True).alias("h"))),
    ).otherwise(F.array(F.struct(own.alias("b"), F.lit(False).alias("h"))))
    return (
        df.withColumn("_copy", F.explode(copies))
        .withColumn("_block", F.col("_copy.b")).withColumn("_halo", F.col("_copy.h")).drop("_copy")
    )


def carry_forward(
    df: DataFrame, by: Sequence[str], position: str, value: str, name: str, block: int = 100_000
) -> DataFrame:
    """Last non-null ``value`` up to each row along ``position`` within ``by``.

    Fills inside blocks first, then hands the last value of each block to the next ones.
    """
    by = list(by)
    blocked = df.withColumn("_block", F.floor(F.col(position) / block).cast("long"))
    ends = blocked.groupBy(*by, "_block").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(position))).alias("_end")
    )
    earlier = W.partitionBy(*by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(*by, "_block", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    inside = W.partitionBy(*by, "_block").orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    return (
        _join_keys(blocked, carried, [*by, "_block"])
        .withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_carried")))
        .drop("_block", "_carried")
    )
