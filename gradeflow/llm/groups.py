"""Work on all members of a group without a group ever meeting in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.session import materialize

#: Members of a tile; two tiles meet in a task.
TILE = 512


#: Rows of one or two numbers that are sent to every task.
BROADCAST_ROWS = 4_000_000


def small(stored: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of narrow rows with a broadcast hint if a count proves it small; else as it is."""
    return F.broadcast(stored) if stored.count() <= most else stored


def distinct_groups(members: DataFrame, key: str, member: str) -> DataFrame:
    """The rows of one of all groups that have the same members; groups of one row are left out.

    Groups are told apart by their size and two 64-bit hashes of their members. ``members`` must be a
    stored table of distinct rows.
    """
    first, second = F.xxhash64(member), F.xxhash64(F.lit(1), F.col(member))
    shape = members.groupBy(key).agg(
        F.count("*").alias("group_size"), F.bit_xor(first).alias("_a"), F.bit_xor(second).alias("_z")).where("group_size > 1")
    chosen = shape.groupBy("group_size", "_a", "_z").agg(F.min(key).alias(key)).select(key)
    return members.join(materialize(chosen, "chosen"), key, "left_semi")


def tiles(members: DataFrame, key: str, member: str, size: int = TILE) -> DataFrame:
    """Rows (key, member, tile, low, high): pairs of tiles of each group.

    A group of n rows is cut into ceil(n / size) tiles by a hash of ``member``; any two
    members meet in some pair of tiles. Groups of one row are left out. ``members`` must be
    a stored table of distinct rows.
    """
    sizes = members.groupBy(key).agg(F.count("*").alias("group_size")).where("group_size > 1")
    rows = members.select(key, member).join(materialize(sizes, "sizes"), key)
    count = F.ceil(F.col("group_size") / size).cast("int")
    rows = rows.withColumn("tile", F.pmod(F.xxhash64(member), count).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    return rows.select(key, member, "tile", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))


def together(rows: DataFrame, key: str, member: str) -> DataFrame:
    """Rows of ``tiles`` with each pair of tiles in one task, one pair after the other."""
    return rows.repartition(key, "low", "high").sortWithinPartitions(key, "low", "high", "tile", member)


def runs(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of a sorted stream, with the offsets of their groups."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        cuts = _starts(table, by)
        if len(cuts) > 1:
            yield table.slice(0, cuts[-1]).combine_chunks(), cuts
        rest = table.slice(cuts[-1]) if len(cuts) else table
    if rest is not None and len(rest):
        yield rest.combine_chunks(), np.append(_starts(rest, by), len(rest))


def _starts(table: pa.Table, by: tuple[str, ...]) -> np.ndarray:
    n = len(table)
    new = np.zeros(n, dtype=bool)
    if n:
        new[0] = True
        for name in by:
            c = table[name].to_numpy()
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of a graph given by its boolean adjacency matrix."""
    n = len(near)
    seen = np.zeros(n, dtype=bool)
    a, b = [], []
    for root in np.flatnonzero(near.any(axis=1)):
        if seen[root]:
            continue
        seen[root] = True
        stack = [root]
        while stack:
            v = stack.pop()
            new = np.flatnonzero(near[v] & ~seen)
            seen[new] = True
            a += [v] * len(new)
            b += new.tolist()
            stack += new.tolist()
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
