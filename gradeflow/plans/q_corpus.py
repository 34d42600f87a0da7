"""Corpus building queries and the flagship curation run."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gradeflow.operators import corpus as co
from gradeflow.operators.ordering import exact_split
from gradeflow.plans.catalog import register, six
from gradeflow.plans.views import TOPIC, Tables
from gradeflow.plans.views_sql import FIRSTS, FLAGGED, QUALITY, r6, split, strip, with_views, words, TENTH
from gradeflow.functions.text import WS
from gradeflow.session import materialize


def _decode(x: str) -> str:
    for name, char in co.ENTITIES:
        char = char.replace("'", "''")
        x = f"replace({x}, '{name}', '{char}')"
    return x


def _page_text() -> str:
    x = "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in ("head", "script", "style", "nav"):
        x = f"regexp_replace({x}, '(?is)<{tag}(\\s[^>]*)?>.*?</{tag}\\s*>', ' ', 'g')"
    x = f"regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g')"
    return f"trim(regexp_replace({_decode(x)}, '{WS}+', ' ', 'g'))"


_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"


@register("extract_page_text", f"""
    select page_id, url, trim(regexp_replace({_decode(_TITLE)}, '{WS}+', ' ', 'g')) title, {_page_text()} as text from pages""")
def extract_page_text(t: Tables):
    return co.extract_page_text(t.pages)


@register("chunk_text", f"""
    select doc_id, i::int chunk, array_to_string(list_slice(w, i * 150 + 1, i * 150 + 200), ' ') as text from (
      select doc_id, w, unnest(range(0, greatest(cast(ceil((len(w) - 200) / 150) as bigint), 0) + 1)) i
      from (select doc_id, {words('text')} w from documents) where len(w) > 0)""")
def chunk_text(t: Tables):
    return co.chunk_text(t.texts(), "doc_id")


@register("curate_dataset", with_views(QUALITY, FIRSTS, *FLAGGED, """chosen as (select * from quality where quality_score >= 0.6
      and doc_id in (select doc_id from firsts) and doc_id not in (select doc_id from flagged) and coalesce(text, '') <> '')""",
    split("chosen", "doc_id", TENTH), then=f"""
    select split, source, count(*) records, {r6('avg(quality_score)')} mean_score, sum(len({words('text')}))::bigint n_words,
      count(distinct md5(text)) n_unique, sum((lang is null)::int * 2 + ({strip('text')} = '')::int)::bigint n_issues,
      any_value(total) total_records
    from (select *, count(*) over () total from splits) group by split, source"""))
def curate_dataset(t: Tables):
    """Load, score, drop copies, contaminated and weak rows, validate, split, and report every record that stays."""
    chosen = co.choose(co.curation_flags(t.texts(), t.labels, t.benchmark, TOPIC))
    splits = exact_split(materialize(chosen, "chosen"), "doc_id")
    # copies collapse before the shuffle; the report has a row per split and source
    per_text = splits.groupBy("split", "source", "text_hash").agg(
        F.count("*").alias("n"), F.sum("quality_score").alias("score"), F.sum("n_words").alias("n_words"), F.sum("n_issues").alias("n_issues"))
    report = per_text.groupBy("split", "source").agg(
        F.sum("n").alias("records"), (F.sum("score") / F.sum("n")).alias("mean_score"), F.sum("n_words").alias("n_words"),
        F.count("*").alias("n_unique"), F.sum("n_issues").alias("n_issues"))
    return six(report.withColumn("total_records", F.sum("records").over(Window.partitionBy())), "mean_score")
