"""Near-duplicate embeddings by a pivot-permutation index.

A vector is described by its nearest reference points (pivots). Vectors that are close have
most of these in common: the inverted lists of the index hold, for each set of ``SHARED``
pivots, the vectors that have all of them among their nearest, so two vectors meet in a
list exactly if they share that many pivots. Candidates are verified by their cosine in
double precision.

The pivots come from a bounded sample, all vectors are indexed. Equal vectors are one entry
with a weight. Long lists are cut into tiles and any two tiles meet, so no list is capped.
A pair is counted in the list of its lowest shared pivots alone.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.catalog import register
from gradeflow.llm.components import components
from gradeflow.llm.groups import forest, runs, tiles, together
from gradeflow.session import materialize

#: Least cosine of a link.
COSINE = 0.9
#: Nearest pivots that describe a vector, one more for each doubling of ``PIVOTS``, and how many of them a candidate must share.
NEAREST = 7
SHARED = 3
#: Pivots for 10,000 vectors; their number grows with the cube root of the vectors'.
PIVOTS = 64
#: Vectors from which the pivots are chosen, and the largest cosine between two pivots.
SAMPLE = 4096
APART = 0.6


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors in double precision."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def choose_pivots(sample: np.ndarray, n: int, apart: float = APART) -> np.ndarray:
    """Up to n unit vectors of the sample in order, each not too close to those before.

    Pivots that are near copies would order their neighbours by chance, so a sample without
    enough distant vectors gives fewer pivots, hence longer lists.
    """
    chosen: list[np.ndarray] = []
    for v in sample:
        if len(chosen) == n:
            break
        if not chosen or max(float(c @ v) for c in chosen) < apart:
            chosen.append(v)
    return np.array(chosen)


def _index(pivots: np.ndarray, nearest: int, shared: int):
    def run(batches):
        k = min(nearest, len(pivots))
        picks = np.array(list(combinations(range(k), min(shared, k))))
        for b in batches:
            if not len(b):
                continue
            score = _matrix(b.column(1)) @ pivots.T
            # ties go to the pivot with the lower number
            top = np.sort(np.argsort(-score, axis=1, kind="stable")[:, :k], axis=1)
            lists = np.zeros((len(b), len(picks)), dtype=np.int64)
            for i in range(picks.shape[1]):
                lists = lists * len(pivots) + top[:, picks[:, i]]
            offsets = lambda n: pa.array(np.arange(len(b) + 1) * n, pa.int32())
            yield pa.record_batch([
                b.column(0), pa.ListArray.from_arrays(offsets(len(picks)), pa.array(lists.ravel())),
                pa.ListArray.from_arrays(offsets(k), pa.array(top.astype(np.int32).ravel())),
            ], names=["vertex", "lists", "nearest"])

    return run


def _links(n_pivots: int, shared: int, cosine: float):
    """Rows (a, b, n): n links counted for a if b is null, else an edge of a spanning forest of links."""

    def run(batches):
        for table, cuts in runs(batches, ("list", "low", "high")):
            vertex, weight, tile, low, high, key = (table[c].to_numpy() for c in ("vertex", "weight", "tile", "low", "high", "list"))
            unit = _matrix(table["vec"].combine_chunks())
            top = table["nearest"].combine_chunks()
            top = top.flatten().to_numpy().reshape(len(top), -1)
            a, b, n = [], [], []
            for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if end - start < 2:
                    continue
                own = slice(start, end)
                last = int(key[start]) % n_pivots  # the highest pivot of the list
                held = np.zeros((end - start, n_pivots), dtype=np.float32)
                held[np.arange(end - start)[:, None], top[own]] = 1
                held = held[:, : last + 1]
                near = (unit[own] @ unit[own].T >= cosine) & (held @ held.T == shared)
                np.fill_diagonal(near, False)
                if low[start] != high[start]:
                    near &= tile[own, None] != tile[None, own]
                if not near.any():
                    continue
                count = near @ weight[own]
                some = np.flatnonzero(count)
                one, two = forest(near)
                a += [vertex[own][some], vertex[own][one]]
                b += [np.zeros(len(some), dtype=np.int64), vertex[own][two]]
                n += [count[some], np.zeros(len(one), dtype=np.int64)]
            if a:
                count = np.concatenate(n)
                yield pa.record_batch([
                    pa.array(np.concatenate(a)), pa.array(np.concatenate(b), mask=count > 0), pa.array(count, pa.int64()),
                ], names=["a", "b", "n"])

    return run


def embedding_dedup(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE,
                    pivots: int | None = None, nearest: int | None = None, shared: int = SHARED) -> DataFrame:
    """One row per row of ``vectors``: key, n_links, component_id, kept.

    n_links is the number of other rows linked directly, copies included; component_id the
    smallest id reachable by links; kept tells whether that is the row's own. Vectors that
    are null, empty or zero, or hold null or non-finite components, link with nothing, and
    neither do vectors of another length than most. Rows without an id take part; a class of
    such rows has a null component, and they are not kept unless alone. Repeated rows are
    copies of each other. Other columns are not read.
    """
    raw = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    sizes = raw.where(fine).groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").first()
    usual = sizes["size"] if sizes else 0
    rows = raw.withColumn("vertex", F.when(fine & (F.size("vec") == usual), F.xxhash64("vec")))
    classes = rows.where("vertex is not null").groupBy("vertex").agg(
        F.min("id").alias("id"), F.count("*").alias("weight"), F.first("vec").alias("vec"))
    classes = materialize(classes, "classes")
    n = classes.count()
    links = _all_links(classes, n, cosine, pivots, nearest, shared)
    counts = links.where("b is null").groupBy(F.col("a").alias("vertex")).agg(F.sum("n").alias("near"))
    roots = components(links.where("b is not null").select("a", "b")).withColumnRenamed("v", "vertex")
    placed = classes.select("vertex", "id", "weight").join(roots, "vertex", "left").join(counts, "vertex", "left")
    placed = materialize(placed.withColumn("root", F.coalesce("root", "vertex")), "placed")
    least = materialize(placed.groupBy("root").agg(F.min("id").alias("component_id"), F.sum("weight").alias("rows")), "least")
    named = placed.join(least, "root").select(
        "vertex", "component_id", "rows", (F.coalesce("near", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    named = materialize(named, "named")
    alone = rows.where("vertex is null").select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    linked = rows.where("vertex is not null").select("id", "vertex").join(named, "vertex").select(
        "id", "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.col("rows") == 1).alias("kept"))
    return linked.unionByName(alone).withColumnRenamed("id", key)


def _all_links(classes: DataFrame, n: int, cosine: float, pivots: int | None, nearest: int | None, shared: int) -> DataFrame:
    wanted = pivots or max(shared, round(PIVOTS * (max(n, 1) / 10_000) ** (1 / 3)))
    # a bounded sample in the order of the vertices, which are hashes
    sample = classes.select("vertex", "vec").orderBy("vertex").limit(SAMPLE).toArrow()
    if not len(sample):
        return classes.sparkSession.createDataFrame([], "a long, b long, n long")
    chosen = choose_pivots(_matrix(sample["vec"].combine_chunks()), wanted)
    share = min(shared, len(chosen))
    if nearest is None:
        # with more pivots two close vectors have fewer of their nearest in common
        nearest = NEAREST + max(0, int(np.ceil(np.log2(len(chosen) / PIVOTS))))
    index = classes.select("vertex", "vec").mapInArrow(
        _index(chosen, nearest, share), "vertex long, lists array<long>, nearest array<int>")
    index = materialize(index, "index")
    members = materialize(index.select("vertex", F.explode("lists").alias("list")), "lists")
    about = classes.select("vertex", "weight", "vec").join(index.select("vertex", "nearest"), "vertex")
    met = together(tiles(members, "list", "vertex").join(materialize(about, "about"), "vertex"), "list", "vertex")
    return materialize(met.mapInArrow(_links(len(chosen), share, cosine), "a long, b long, n long"), "links")


SQL = """
    with recursive u as (select vec_id, embedding::double[] v, sqrt(list_sum([x * x for x in embedding::double[]])) n from embeddings
        where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
    l as (select a.vec_id a, b.vec_id b from u a join u b on a.vec_id <> b.vec_id
          where a.n > 0 and b.n > 0 and list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.9),
    reach as (select vec_id v, vec_id u from embeddings union select v, l.b from reach join l on l.a = u),
    c as (select v, min(u) component_id from reach group by v),
    k as (select a, count(*) n from l group by a)
    select vec_id, coalesce(n, 0)::bigint n_links, component_id, vec_id = component_id kept
    from embeddings join c on v = vec_id left join k on a = vec_id"""


@register("op6_embedding_dedup", SQL)
def op6(spark, folder: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{folder}/embeddings.parquet"))
