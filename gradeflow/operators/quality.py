"""Quality scores, diversity, safety and curation reports."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from gradeflow.functions.text import WS, is_blank, keyword_hits, strip, text_of, word_count
from gradeflow.functions.wordhash import PLAIN, SPAN_BASE, Words, chunks, grams, spaced, windows
from gradeflow.operators.groups import runs
from gradeflow.operators.ordering import beside, bracketed_quantiles
from gradeflow.session import materialize

# Default weights and threshold of the composite score.
WEIGHTS = {"correctness": 0.4, "relevance": 0.3, "complexity": 0.15, "clarity": 0.15}
THRESHOLD = 0.6
# Characters that may end a complete text, and the replacement character.
TERMINALS = '.?!…"»'
#: Bytes of text whose n-grams are sorted together.
COMBINE_BYTES = 8 << 20
#: Different n-grams of a group are counted in 2**BUCKET_BITS parts.
BUCKET_BITS = 12
DIGEST_BYTES = 12
REPLACEMENT = "�"


def quality_components(docs: DataFrame, labels: DataFrame, topic: str) -> DataFrame:
    """correctness, relevance, complexity and clarity in [0, 1] per document."""
    text = text_of("text")
    letters = F.length(F.regexp_replace(text, rf"[^\p{{L}}{WS[1:-1]}]", ""))
    return docs.join(labels.select("doc_id", "quality"), "doc_id", "left").select(
        *docs.columns,
        F.coalesce(F.col("quality").cast("double"), F.lit(0.5)).alias("correctness"),
        F.least(F.lit(1.0), keyword_hits("text", topic) / 3.0).alias("relevance"),
        F.least(F.lit(1.0), word_count("text") / 500.0).alias("complexity"),
        F.when(F.length(text) > 0, letters / F.length(text)).otherwise(1.0).alias("clarity"),
    )


def quality_score(components: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    total = F.lit(0.0)
    for name, weight in (weights or WEIGHTS).items():
        total = total + F.lit(weight) * F.col(name)
    return components.withColumn("quality_score", total)


def quality_threshold(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scored.where(F.col("quality_score") >= threshold)


def format_compliance(df: DataFrame, text: str = "text") -> DataFrame:
    """Flags per row: empty, unbalanced code fence, truncated, malformed, and compliant."""
    body = strip(text)
    fences = F.length(text_of(text)) - F.length(F.replace(text_of(text), F.lit("```"), F.lit("")))
    ends_well = F.lit(False)
    for mark in TERMINALS:
        ends_well = ends_well | body.endswith(mark)
    flagged = df.select(
        "*",
        is_blank(text).alias("is_empty"),
        ((fences / 3).cast("int") % 2 == 1).alias("open_fence"),
        (~is_blank(text) & ~ends_well).alias("truncated"),
        F.contains(text_of(text), F.lit(REPLACEMENT)).alias("malformed"),
    )
    bad = F.col("is_empty") | F.col("open_fence") | F.col("truncated") | F.col("malformed")
    return flagged.withColumn("compliant", ~bad)


def _spread_figures(values: DataFrame, probs: Sequence[tuple[float, str]]) -> DataFrame:
    """One row: n, mean and the named exact quantiles of a stored column ``value``."""
    tails = bracketed_quantiles(values, "value", [p for p, _ in probs]).agg(*[
        F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name) for p, name in probs
    ])
    basic = values.where("value is not null").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return beside(basic, tails)


def quality_distribution(scored: DataFrame, score: str = "quality_score") -> DataFrame:
    """One row: n, mean and exact quartiles; the scores are computed once."""
    values = materialize(scored.select(F.col(score).cast("double").alias("value")), "scores")
    return _spread_figures(values, [(0.25, "p25"), (0.5, "p50"), (0.75, "p75")])


def source_breakdown(df: DataFrame, source: str = "source") -> DataFrame:
    return df.groupBy(source).agg(F.count("*").alias("n")).orderBy(F.desc("n"), source)


def safety_rates(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return (
        labels.join(docs.select("doc_id", "source", "lang"), "doc_id").groupBy("source", "lang")
        .agg(F.count("*").alias("n"), F.avg("toxic").alias("toxic_rate"))
    )


def _packed(a: np.ndarray, z: np.ndarray) -> bytes:
    """48 bits of each of two numbers; the bucket has the first bits of ``a``."""
    a = a << np.uint64(BUCKET_BITS) >> np.uint64(16)
    return np.hstack([x.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :6] for x in (a, z)]).tobytes()


def _unpacked(data) -> np.ndarray:
    """Rows of the two numbers that ``_packed`` keeps."""
    short = np.frombuffer(data, dtype=np.uint8).reshape(-1, 2, 6)
    out = np.zeros((len(short), 2, 8), dtype=np.uint8)
    out[:, :, :6] = short
    return out.view("<u8")[:, :, 0]


def _gram_digests(orders: Sequence[int], kind: pa.DataType):
    """(group, n, bucket, number of n-grams, packed digests of the different ones) of each stretch of texts."""

    def run(batches):
        for b in batches:
            group = b.column(0).dictionary_encode()
            codes, values = group.indices.fill_null(-1).to_numpy(), group.dictionary
            for low, high, data, offsets in chunks(b.column(1), COMBINE_BYTES):
                words = Words(spaced(data), offsets, PLAIN, lower=False)
                first, second = words.hashes(), words.hashes(SPAN_BASE)
                for n in orders:
                    starts = windows(words.counts, words.first, n)
                    if not len(starts):
                        continue
                    a, z = (grams(h, n)[starts] for h in (first, second))
                    code = np.repeat(codes[low:high], np.maximum(words.counts - n + 1, 0))
                    order = np.lexsort((a, code))
                    a, z, code = a[order], z[order], code[order]
                    new = np.concatenate(([True], (a[1:] != a[:-1]) | (z[1:] != z[:-1]) | (code[1:] != code[:-1])))
                    own = np.flatnonzero(new)
                    bucket = (a[own] >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
                    cut = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (code[own][1:] != code[own][:-1]))))
                    ends = pa.array(np.append(cut, len(own)) * DIGEST_BYTES, pa.int32())
                    digests = pa.py_buffer(_packed(a[own], z[own]))
                    names = code[own][cut]
                    yield pa.record_batch([
                        values.take(pa.array(names, mask=names < 0)).cast(kind), pa.array(np.full(len(cut), n), pa.int32()), pa.array(bucket[cut]),
                        pa.array(np.diff(np.append(own[cut], len(a)))), pa.BinaryArray.from_buffers(pa.binary(), len(cut), [None, ends.buffers()[1], digests]),
                    ], names=["by", "n", "bucket", "c", "digests"])

    return run


def _different(digests: np.ndarray) -> int:
    """Number of different rows of two numbers."""
    a, z = digests[:, 0], digests[:, 1]
    order = np.argsort(a)
    again = a[order][1:] == a[order][:-1]
    if (z[order][1:] != z[order][:-1])[again].any():  # two n-grams that share a first number
        order = np.lexsort((z, a))
        again = (a[order][1:] == a[order][:-1]) & (z[order][1:] == z[order][:-1])
    return len(a) - int(again.sum())


def _distinct_digests(batches):
    """(group, n, different digests, number of n-grams) of each bucket of a sorted stream."""
    for table, cuts in runs(batches, ("by", "n", "bucket")):
        digests = table["digests"].combine_chunks().cast(pa.large_binary())
        digests = digests if isinstance(digests, pa.Array) else digests.chunk(0)
        ends = np.frombuffer(digests.buffers()[1], dtype=np.int64)[digests.offset : digests.offset + len(digests) + 1]
        data = memoryview(digests.buffers()[2])
        found = [_different(_unpacked(data[ends[low] : ends[high]])) for low, high in zip(cuts[:-1], cuts[1:])]
        heads = table.take(pa.array(cuts[:-1])).combine_chunks()
        yield pa.record_batch([heads["by"].chunk(0), heads["n"].chunk(0), pa.array(found, pa.int64()),
                               pa.array(np.add.reduceat(table["c"].to_numpy(), cuts[:-1]))], names=["by", "n", "d", "c"])


def ngram_diversity(df: DataFrame, by: str, text: str = "text", orders: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Distinct share of n-grams per group, by 108-bit hashes of the n-grams.

    Tasks sort the hashes of a few megabytes of text at a time. What is different there leaves as a few long values, one for each
    bucket of first bits, so a shuffled n-gram is 12 bytes and a bucket is counted on its own.
    """
    kind = df.schema[by].dataType
    arrow, name = to_arrow_type(kind), kind.simpleString()
    rows = df.select(by, text_of(text).alias("_text")).mapInArrow(
        _gram_digests(tuple(orders), arrow), f"by {name}, n int, bucket int, c long, digests binary")
    buckets = rows.repartition("by", "n", "bucket").sortWithinPartitions("by", "n", "bucket")
    counted = buckets.mapInArrow(_distinct_digests, f"by {name}, n int, d long, c long")
    return counted.groupBy(F.col("by").alias(by), "n").agg(
        F.sum("d").alias("distinct_grams"), F.sum("c").alias("all_grams")
    ).withColumn("diversity", F.col("distinct_grams") / F.col("all_grams"))


def topic_distribution(df: DataFrame, first: str = "lang", second: str = "source") -> DataFrame:
    """Counts and shares of every combination, of each side alone, and of all rows (cube)."""
    counted = df.groupBy(first, second).agg(F.count("*").alias("c"))  # the cube expands counts, not rows
    cubed = counted.cube(first, second).agg(F.grouping_id().cast("int").alias("level"), F.sum("c").alias("n"))
    everything = W.partitionBy()  # the cube is bounded by the two vocabularies
    total = F.max(F.when(F.col("level") == 3, F.col("n"))).over(everything)
    return cubed.withColumn("share", F.col("n") / total)


def structure_variety(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows per (length bucket, question, list) shape with share and the entropy of the spread."""
    n = word_count(text)
    shaped = df.select(
        F.when(n < 50, "<50").when(n < 200, "<200").when(n < 1000, "<1000").otherwise(">=1000").alias("length"),
        F.contains(text_of(text), F.lit("?")).alias("has_question"),
        text_of(text).rlike(r"(^|\n)[ \t]*([-*]|[0-9]+\.)[ \t]").alias("has_list"),
    )
    counted = shaped.groupBy("length", "has_question", "has_list").agg(F.count("*").alias("n"))
    everything = W.partitionBy()  # at most 16 shapes
    share = counted.withColumn("share", F.col("n") / F.sum("n").over(everything))
    return share.withColumn("entropy", -F.sum(F.col("share") * F.ln("share")).over(everything))


def curation_funnel(flags: DataFrame, chosen: Column | None = None) -> DataFrame:
    """One pass over the flag columns is_first, contaminated and passes."""
    kept = F.col("is_first") & F.col("passes")
    final = kept & ~F.col("contaminated")
    return flags.agg(
        F.count("*").alias("total_candidates"),
        F.count(F.when(F.col("is_first"), 1)).alias("after_dedup"),
        F.count(F.when(kept, 1)).alias("after_quality_filter"),
        F.count(F.when(kept & F.col("contaminated"), 1)).alias("contamination_removed"),
        F.count(F.when(final if chosen is None else final & chosen, 1)).alias("final_selected"),
    )


def run_consistency(df: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Variance over repeated runs; a single run has none."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.var_samp(value).alias("variance"))


def latency_profile(df: DataFrame, value: str, ts_micros: str) -> DataFrame:
    """One row: n, mean, exact p50, p95, p99 and rows per second over the time span."""
    values = materialize(df.select(F.col(value).cast("double").alias("value")), "values")
    figures = _spread_figures(values, [(0.5, "p50"), (0.95, "p95"), (0.99, "p99")])
    seconds = (F.max(ts_micros) - F.min(ts_micros)) / 1e6
    return beside(figures, df.agg((F.count("*") / seconds).alias("throughput")))
