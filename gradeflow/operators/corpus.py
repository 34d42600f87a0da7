"""Turning raw pages and long texts into rows, and the whole curation run."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeflow.functions.text import WS, text_of, word_count, words
from gradeflow.operators.contamination import flagged_documents
from gradeflow.operators.quality import THRESHOLD, quality_components, quality_score
from gradeflow.operators.validate import issues_of_row
from gradeflow.session import materialize

CHUNK_WORDS = 200
CHUNK_STRIDE = 150
# The frequent character references; the ampersand comes last.
ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
]


#: Any other reference, named or numeric.
OTHER_REFERENCE = r"&(?!(?:nbsp|lt|gt|quot|#39|copy|middot|amp);)(?:[A-Za-z]|#[0-9xX])"


@F.pandas_udf(T.StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def decode_entities(c: Column) -> Column:
    """Character references decoded once. The frequent ones stay in the JVM; only texts that hold others go to Python."""
    plain = c
    for name, char in ENTITIES:
        plain = F.replace(plain, F.lit(name), F.lit(char))
    return F.coalesce(_unescape(F.when(c.rlike(OTHER_REFERENCE), c)), plain)


def _tidy(c: Column) -> Column:
    return F.trim(F.regexp_replace(decode_entities(c), f"{WS}+", " "))


def page_title(page: Column | str) -> Column:
    return _tidy(F.regexp_extract(text_of(page), r"(?is)<title[^>]*>(.*?)</title>", 1))


def page_text(page: Column | str) -> Column:
    """Visible text: script, style, nav, head, comments and tags removed, entities decoded."""
    body = F.regexp_replace(text_of(page), r"(?s)<!--.*?-->", " ")
    for tag in ("head", "script", "style", "nav"):
        body = F.regexp_replace(body, rf"(?is)<{tag}(\s[^>]*)?>.*?</{tag}\s*>", " ")
    return _tidy(F.regexp_replace(body, r"(?s)<[^>]*>", " "))


def extract_page_text(pages: DataFrame, key: str = "page_id") -> DataFrame:
    return pages.select(key, "url", page_title("html").alias("title"), page_text("html").alias("text"))


def chunk_text(df: DataFrame, key: str, text: str = "text", size: int = CHUNK_WORDS,
               stride: int = CHUNK_STRIDE) -> DataFrame:
    """Overlapping word windows that cover the whole text; the last one may be short."""
    tokens = df.select(key, words(text).alias("_words")).where(F.size("_words") > 0)
    last = F.greatest(F.ceil((F.size("_words") - size) / stride), F.lit(0))
    starts = F.sequence(F.lit(0), last.cast("int"))
    return tokens.select(key, "_words", F.explode(starts).alias("chunk")).select(
        key, "chunk", F.array_join(F.slice("_words", F.col("chunk") * stride + 1, F.lit(size)), " ").alias("text")
    )


def curation_flags(docs: DataFrame, labels: DataFrame, items: DataFrame, topic: str,
                   threshold: float = THRESHOLD) -> DataFrame:
    """Id, source, score, words, issues and the flags is_first, contaminated and passes of every document.

    One scan scores the texts and stores narrow rows, another finds the item n-grams. All
    joins run on the unique document id and move narrow rows only, never texts.
    """
    pairs = quality_score(quality_components(docs, labels, topic)).withColumns(
        {"instruction": F.concat(F.lit("Write in "), "lang"), "output": F.col("text")})
    scored = materialize(pairs.select(
        "doc_id", "source", "quality_score", (text_of("text") != "").alias("has_text"), F.md5(text_of("text")).alias("text_hash"),
        word_count("text").alias("n_words"), F.size(issues_of_row()).alias("n_issues"),
    ), "scored")
    firsts = scored.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id")).select("doc_id").withColumn("is_first", F.lit(True))
    flagged = flagged_documents(docs, items).withColumn("contaminated", F.lit(True))
    return (
        scored.join(firsts, "doc_id", "left").join(flagged, "doc_id", "left")
        .withColumn("is_first", F.coalesce("is_first", F.lit(False)))
        .withColumn("contaminated", F.coalesce("contaminated", F.lit(False)))
        .withColumn("passes", F.col("quality_score") >= threshold)
    )


def choose(flags: DataFrame) -> DataFrame:
    """Documents that stay: first of their text, good enough, clean, not empty."""
    return flags.where(F.col("is_first") & F.col("passes") & ~F.col("contaminated") & F.col("has_text"))
