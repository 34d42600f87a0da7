"""Exact histogram of encoded lengths, and what it says for every context limit.

Documents are reduced to (length, number) by partial aggregates, so the shuffle carries a
row per task and length. Suffix sums over the lengths give, for any limit, how many
documents are longer, the share that fits, and the tokens left after truncation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

import numpy as np
import pyarrow as pa

from gradeflow.llm.catalog import register
from gradeflow.llm.tokens import BYTE_BPE, WordBPE, byte_encoding
from gradeflow.llm.words import chunks
from gradeflow.session import materialize

#: Lengths are summed within blocks of this width first, so that no task sorts all of them.
BLOCK = 4096


def _lengths(tokenizer: str):
    def run(batches):
        words = WordBPE(tokenizer) if tokenizer.endswith(".json") else None
        pairs = None if words else byte_encoding(tokenizer)
        for b in batches:
            for _, _, data, offsets in chunks(b.column(0)):
                if words:
                    n = np.diff(words.encode(data, offsets)[1])
                else:
                    texts = (data[a:z].tobytes().decode() for a, z in zip(offsets[:-1], offsets[1:]))
                    n = np.array([len(pairs.encode_ordinary(t)) for t in texts], dtype=np.int64)
                yield pa.record_batch([pa.array(n, pa.int64())], names=["n_tokens"])

    return run


def length_histogram(docs: DataFrame, text: str = "text", tokenizer: str = BYTE_BPE) -> DataFrame:
    """(n_tokens, n_docs) of all rows; null and empty texts have length 0. An empty table has no rows."""
    texts = docs.select(F.col(text).cast("string").alias("text"))
    return texts.mapInArrow(_lengths(tokenizer), "n_tokens long").groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def length_report(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per length L that occurs, for the context limit L:

    n_docs of this length, docs_within (at most L), docs_beyond, tokens_within, tokens_total,
    tokens_truncated (every document cut to L) and share_within. Between two lengths the
    row of the lower one holds, with ``docs_beyond`` tokens more for each step of the limit.
    """
    rows = histogram.withColumn("block", F.floor(F.col("n_tokens") / block))
    tokens = F.col("n_tokens") * F.col("n_docs")
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum(tokens).alias("block_tokens"))
    up, all_blocks = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    # one row per block of lengths
    blocks = blocks.select(
        "block", F.coalesce(F.sum("block_docs").over(up), zero).alias("docs_below"),
        F.coalesce(F.sum("block_tokens").over(up), zero).alias("tokens_below"),
        F.sum("block_docs").over(all_blocks.orderBy("block")).alias("docs_total"),
        F.sum("block_tokens").over(all_blocks.orderBy("block")).alias("tokens_total"))
    here = Window.partitionBy("block").orderBy("n_tokens")
    out = rows.join(blocks, "block").select(
        "n_tokens", "n_docs", (F.col("docs_below") + F.sum("n_docs").over(here)).alias("docs_within"),
        (F.col("tokens_below") + F.sum(tokens).over(here)).alias("tokens_within"), "docs_total", "tokens_total")
    beyond = F.col("docs_total") - F.col("docs_within")
    return out.select(
        "n_tokens", "n_docs", "docs_within", beyond.alias("docs_beyond"), "tokens_within", "tokens_total",
        (F.col("tokens_within") + F.col("n_tokens") * beyond).alias("tokens_truncated"),
        (F.col("docs_within") / F.col("docs_total")).alias("share_within"))


def truncated_total(report: DataFrame, limit: int) -> int:
    """Tokens left if every document is cut to ``limit``."""
    row = report.where(F.col("n_tokens") <= limit).orderBy(F.desc("n_tokens")).first()
    if row is None:  # all documents are longer, or there are none
        docs = report.agg(F.max("docs_within")).first()[0]
        return (docs or 0) * limit
    return row["tokens_truncated"] + (limit - row["n_tokens"]) * row["docs_beyond"]


def length_quantile(report: DataFrame, q: float) -> int | None:
    """Smallest length that a share ``q`` of the documents does not exceed; null for no documents."""
    return report.where(F.col("share_within") >= q).agg(F.min("n_tokens")).first()[0]


@register("op7_token_counts")
def op7(spark, folder: str) -> DataFrame:
    # the report reads the histogram twice, the texts are encoded once
    return length_report(materialize(length_histogram(spark.read.parquet(f"{folder}/documents.parquet")), "histogram"))
