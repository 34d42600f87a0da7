"""Exact and near duplicate removal; the row with the lowest id stays."""

from __future__ import annotations

import hashlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.functions.text import text_of
from gradeflow.functions.wordhash import GRAM_BASE, U, mix
from gradeflow.operators.groups import TILE, distinct_groups, runs, tiles, together
from gradeflow.session import materialize

SHINGLE = 5
HASHES = 64
ROWS = 4  # hashes per band, so 16 bands
LEADER_ROUNDS = 3  # rounds that fold groups of copies before links are listed
PRIME = 2**31 - 1
SKETCH_BITS = 1024
AT_ONCE = 4096  # rows or shingles worked on at once in a task


def first_ids(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lowest id per distinct text. Copies collapse before the shuffle."""
    return df.groupBy(F.md5(text_of(text)).alias("_hash")).agg(F.min(key).alias(key)).select(key)


def exact_dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows whose id is the lowest of their text; the join runs on the unique id, never on the text."""
    return df.join(first_ids(df, key, text), key, "left_semi")


def cross_dataset_dedup(candidates: DataFrame, earlier: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Candidates whose text is in no earlier set; ``key`` is unique among them.

    Distinct hashes of both sides meet, then ids; no text is shuffled by its hash.
    """
    own = materialize(candidates.select(key, F.md5(text_of(text)).alias("_hash")), "candidate-hashes")
    seen = earlier.select(F.md5(text_of(text)).alias("_hash")).distinct()
    known = own.select("_hash").distinct().join(seen, "_hash", "left_semi")
    repeated = own.join(materialize(known, "known-hashes"), "_hash", "left_semi").select(key)
    return candidates.join(repeated, key, "left_anti")


def _shingles(text: str | None, n: int) -> np.ndarray:
    """Distinct word n-grams as 60-bit hashes in order; shorter texts give one shingle of all words."""
    line = " ".join((text or "").split()).encode()
    ends = list(accumulate(map(len, line.split(b" ")), lambda end, size: end + 1 + size))
    starts = [0, *[end + 1 for end in ends]]
    grams = {line[start:end] for start, end in zip(starts, ends[n - 1 :])} or {line}
    md5 = hashlib.md5
    digests = b"".join([md5(g).digest()[:8] for g in grams])
    return np.unique((np.frombuffer(digests, dtype=">u8") >> 4).astype(np.int64))


def shingle_sets(df: DataFrame, key: str, text: str, n: int = SHINGLE) -> DataFrame:
    """(id, shingles) per row."""

    def run(batches):
        for b in batches:
            for low in range(0, len(b), AT_ONCE):
                part = b.slice(low, AT_ONCE)
                sets = [_shingles(t, n) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, sets)])
                lists = pa.LargeListArray.from_arrays(ends, np.concatenate(sets)).cast(pa.list_(pa.int64()))
                yield pa.record_batch([part.column(0), lists], names=["id", "shingles"])

    return df.select(F.col(key).cast("long"), text_of(text)).mapInArrow(run, "id long, shingles array<long>")


def hash_family(hashes: int, seed: int) -> list[tuple[int, int]]:
    """Multiplier and offset of each hash (a * x + b) modulo ``PRIME``; any engine can compute them."""
    digits = [hashlib.md5(f"{seed}:{i}".encode()).hexdigest() for i in range(hashes)]
    return [(int(d[:7], 16) + 1, int(d[7:14], 16)) for d in digits]


def _modulo_prime(values: np.ndarray) -> np.ndarray:
    """Values below 2**61 modulo ``PRIME``, which is 2**31 - 1, by adding their high bits to the low ones."""
    for _ in range(2):
        high = values >> 31
        values &= PRIME
        values += high
    values[values == PRIME] = 0
    return values


def band_keys(shingles: np.ndarray, family: list[tuple[int, int]], rows: int) -> np.ndarray:
    """A 64-bit key per band of ``rows`` values of the minhash signature."""
    factor, offset = (np.array(x, dtype=np.int64) for x in zip(*family))
    signature = np.full(len(factor), PRIME, dtype=np.int64)
    for low in range(0, len(shingles), AT_ONCE):  # bounded memory for long texts
        x = shingles[low : low + AT_ONCE] % PRIME
        signature = np.minimum(signature, _modulo_prime(x[:, None] * factor + offset).min(axis=0))
    keys = np.arange(len(factor) // rows, dtype=U)
    for column in signature.reshape(-1, rows).T:
        keys = mix(keys * GRAM_BASE + column.astype(U))
    return keys.view(np.int64)


def sketch_of(shingles: np.ndarray) -> bytes:
    """Parity of the shingles per bit: two sketches differ in no more bits than the sets differ in shingles."""
    odd = np.bincount(shingles & (SKETCH_BITS - 1), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def minhash_dedup(
    df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8,
    hashes: int = HASHES, rows: int = ROWS, seed: int = 42, leader_rounds: int = LEADER_ROUNDS, tile: int = TILE,
) -> DataFrame:
    """Near duplicates by MinHash bands, each verified by its exact Jaccard similarity.

    Rows are taken in the order of their ids; a row is dropped if an earlier kept row shares
    a band bucket with it and reaches the threshold. Returns every id with ``kept`` and the
    lowest such row (``duplicate_of``), or the first row with the same words.

    Rows with equal shingles are folded first. Then, in a few rounds, a row that is the lowest open
    one in all its buckets is compared with the open rows there, which takes groups of
    copies out with one comparison per row. Of the rest, tasks that hold two tiles of a bucket each list
    the pairs that may match by the sizes and sketches of their sets; each pair is listed once and
    fetches its two sets. The links are decided in as many rounds as their longest chain. At last each
    dropped row takes the lowest kept row it matches, found in the same way. ``leader_rounds`` and ``tile``
    change the plan, not the result.
    """
    signed = materialize(_signatures(df, key, text, hashes, rows, seed), "signatures")
    firsts = materialize(signed.groupBy("_set").agg(F.min("id").alias("id")), "firsts")
    spread = signed.select("id", F.explode("bands").alias("bucket")).join(firsts, "id", "left_semi")
    buckets = materialize(_crowded(spread), "buckets")
    crowded = materialize(buckets.select("id").distinct(), "crowded")
    # only rows that share a bucket need their sets, so only their texts are read again
    texts = df.withColumn("id", F.col(key).cast("long")).join(crowded, "id", "left_semi")
    sets = materialize(shingle_sets(texts, "id", text), "shingles")
    narrow = signed.select("id", "size", "sketch").join(crowded, "id", "left_semi")
    open_rows, dropped = buckets, []
    for _ in range(leader_rounds):
        matched, leaders = _one_round(open_rows, sets, threshold)
        dropped.append(matched.select("id"))
        closed = matched.select("id").unionByName(leaders.select(F.col("leader").alias("id")))
        open_rows = materialize(_crowded(open_rows.join(closed, "id", "left_anti")), "buckets")
    links = _near(_candidates(open_rows, narrow.withColumn("kept", F.lit(False)), threshold, tile, False), sets, threshold)
    dropped += _decide(materialize(links, "links"))
    gone = df.sparkSession.createDataFrame([], "id long")
    for part in dropped:
        gone = gone.unionByName(part)
    gone = materialize(gone.withColumn("gone", F.lit(True)), "gone")
    state = materialize(narrow.join(gone, "id", "left").select("id", "size", "sketch", F.col("gone").isNull().alias("kept")), "state")
    # a dropped row takes the lowest of the kept rows that it matches
    found = _near(_candidates(buckets, state, threshold, tile, True), sets, threshold).groupBy("id").agg(F.min("other").alias("duplicate_of"))
    # copies share the fate of the first row with their shingles
    fate = firsts.join(found, "id", "left").select("_set", F.col("id").alias("first_id"), "duplicate_of")
    copies = signed.select("id", "_set").join(materialize(fate, "fate"), "_set")
    target = F.coalesce(F.col("duplicate_of"), F.when(F.col("id") != F.col("first_id"), F.col("first_id")))
    return copies.select(F.col("id").alias(key), target.isNull().alias("kept"), target.alias("duplicate_of"))


def _signatures(df: DataFrame, key: str, text: str, hashes: int, rows: int, seed: int) -> DataFrame:
    """id, digest of the shingles, number of shingles, sketch, and one 64-bit bucket per band, in one pass over the texts."""
    family = hash_family(hashes, seed)

    def run(batches):
        for b in batches:
            out = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = _shingles(text, SHINGLE)
                out.append((i, hashlib.md5(x.tobytes()).hexdigest(), len(x), sketch_of(x), band_keys(x, family, rows).tolist()))
            names = ["id", "_set", "size", "sketch", "bands"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 5, kinds)], names=names)

    texts = df.select(F.col(key).cast("long"), text_of(text))
    return texts.mapInArrow(run, "id long, _set string, size long, sketch binary, bands array<long>")


def _crowded(rows: DataFrame) -> DataFrame:
    """Rows (id, bucket) of buckets with two rows or more."""
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    return rows.join(sizes, "bucket", "left_semi").select("id", "bucket")


def _one_round(open_rows: DataFrame, sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(rows matched to a leader, all leaders) of one round."""
    lowest = open_rows.groupBy("bucket").agg(F.min("id").alias("leader"))
    placed = open_rows.join(materialize(lowest, "lowest"), "bucket")
    leaders = (
        placed.groupBy("id").agg(F.min(F.col("leader") == F.col("id")).alias("leads"))
        .where("leads").select(F.col("id").alias("leader"))
    )
    leaders = materialize(leaders, "leaders")
    pairs = placed.where(F.col("leader") < F.col("id")).select("id", "leader").distinct().join(
        leaders, "leader", "left_semi"
    )
    matched = _near(pairs.withColumnRenamed("leader", "other"), sets, threshold).select("id").distinct()
    return materialize(matched, "matched"), leaders


def _near(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (id, other) that reach the threshold; each fetches its two sets once."""
    left = sets.select("id", F.col("shingles").alias("a"))
    right = sets.select(F.col("id").alias("other"), F.col("shingles").alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    union = F.size("a") + F.size("b") - common
    return pairs.join(left, "id").join(right, "other").where(common >= F.lit(threshold) * union).select("id", "other")


def _tile_task(threshold: float, lowest: bool):
    """Pairs (id, other), other earlier, of a pair of tiles that may match; with ``lowest``, dropped rows and kept ones."""
    apart = (1 - threshold) / (1 + threshold)  # sets that match differ in no more than this share of their sizes

    def run(batches):
        for table, cuts in runs(batches, ("bucket", "low", "high")):
            ids, sizes = table["id"].to_numpy(), table["size"].to_numpy()
            kept = table["kept"].to_numpy(zero_copy_only=False)
            bits = np.frombuffer(b"".join(table["sketch"].to_pylist()), dtype=np.uint64).reshape(len(ids), -1)
            a, b = [], []
            for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                order = start + np.argsort(ids[start:end], kind="stable")
                for k, i in enumerate(order):
                    others = order[:k]
                    if lowest:
                        others = others[kept[others]] if not kept[i] else others[:0]
                    most = apart * (sizes[others] + sizes[i]) + 1e-6
                    near = np.abs(sizes[others] - sizes[i]) <= most
                    others, most = others[near], most[near]
                    others = others[np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1) <= most]
                    a.append(np.full(len(others), ids[i]))
                    b.append(ids[others])
            empty = [np.zeros(0, dtype=np.int64)]
            yield pa.record_batch([np.concatenate(a or empty), np.concatenate(b or empty)], names=["id", "other"])

    return run


def _candidates(rows: DataFrame, narrow: DataFrame, threshold: float, tile: int, lowest: bool) -> DataFrame:
    """Distinct pairs of rows that share a bucket and may match, by sizes and sketches; nothing that matches is lost."""
    rows = materialize(distinct_groups(rows, "bucket", "id"), "different_buckets")
    met = tiles(rows, "bucket", "id", tile).join(narrow, "id")
    return together(met, "bucket", "id").mapInArrow(_tile_task(threshold, lowest), "id long, other long").distinct()


def _decide(links: DataFrame) -> list[DataFrame]:
    """Rows to drop: those linked to an earlier row that stays. One round per step of the longest chain."""
    out = []
    while not links.isEmpty():
        later = links.select("id").distinct()
        # earlier ends that have no open earlier partner themselves stay
        stay = links.select(F.col("other").alias("id")).distinct().join(later, "id", "left_anti")
        gone = links.join(stay.withColumnRenamed("id", "other"), "other", "left_semi").select("id").distinct()
        gone = materialize(gone, "dropped")
        out.append(gone)
        # links of dropped rows say nothing any more, and a row without links stays
        links = links.join(gone, "id", "left_anti").join(gone.withColumnRenamed("id", "other"), "other", "left_anti")
        links = materialize(links.select("id", "other"), "links")
    return out
