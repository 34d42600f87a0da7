"""Line removal by site-relative frequency, in DataFrame functions only.

Lines that stand on more than a given share of a site's pages are boilerplate. A site has
at most (lines per page / share) such lines, so its list is short however many pages it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.catalog import register
from gradeflow.session import materialize

#: A line on more than this share of a site's pages goes ...
RATIO = 0.1
#: ... if it is on so many of them at least.
MIN_PAGES = 3
#: Texts with no more than this share of own characters are near copies, if copies count once.
OWN = 0.2


# Digests are texts: Spark's array functions look texts up in a hash set, bytes and structs one by one.
def _line_key(line: Column) -> Column:
    return F.md5(F.trim(line))


def _text_key(text: Column) -> Column:
    return F.md5(text)


def _once(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row; in the body of a filter the optimizer would compute it per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pages(docs: DataFrame, site: str, text: str) -> DataFrame:
    """(_site, _lines): the lines of each row, as (key, length) of each different one that is not blank."""
    rows = docs.select(F.col(site).alias("_site"), F.col(text).cast("string").alias("_text"))
    lines = F.array_distinct(F.transform(F.split("_text", "\n"), lambda x: F.trim(x)))
    return rows.withColumn("_lines", F.transform(
        F.filter(lines, lambda x: x != ""), lambda x: F.struct(_line_key(x).alias("key"), F.length(x).alias("n"))))


def _often(votes: DataFrame, totals: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """(_site, _found, _first) of the rows (_site, _line, _page), one for each vote: the lines, and the lowest page of each."""
    counts = votes.groupBy("_site", "_line").agg(F.count("*").alias("_pages"), F.min("_page").alias("_page")).where(F.col("_pages") >= min_pages)
    often = counts.join(totals, F.expr("_site <=> _all")).where(F.col("_pages") > F.lit(ratio) * F.col("_total"))
    return often.groupBy("_site").agg(F.collect_list(F.struct("_line", "_page")).alias("_both")).select(
        "_site", F.col("_both._line").alias("_found"), F.col("_both._page").alias("_first"))


def boilerplate(docs: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES,
                copies: bool = True) -> DataFrame:
    """(_site, _lines, _first): the digests of each site's boilerplate lines; sites without any are left out.

    With ``copies`` each row is a page. Without, the pages are a site's distinct texts, and
    texts that are the same often repeated lines but for ``OWN`` of their characters have one
    vote on these together, as copies of a passage are no evidence that its lines are
    boilerplate; ``_first`` has the digest of the text that keeps the line.
    """
    pages = _pages(docs, site, text).withColumn("_page", F.lit(None).cast("string"))
    if not copies:
        # the texts stay where they are: digests and lengths travel
        pages = pages.where("_text is not null").withColumn("_page", _text_key(F.col("_text"))).groupBy("_site", "_page").agg(F.first("_lines").alias("_lines"))
        pages = materialize(pages, "pages")
    totals = materialize(pages.groupBy(F.col("_site").alias("_all")).agg(F.count("*").alias("_total")), "site_totals")
    found = _often(pages.select("_site", "_page", F.explode("_lines.key").alias("_line")), totals, ratio, min_pages)
    if not copies:
        found = materialize(found.select(F.col("_site").alias("_of"), "_found"), "often")
        chars = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + x["n"])
        both = F.array_intersect("_lines.key", "_found")
        held = pages.join(found, F.expr("_site <=> _of")).withColumn("_held", _once(
            both, lambda some: F.filter("_lines", lambda x: F.array_contains(some, x["key"]))))
        same = F.md5(F.array_join(F.array_sort(F.col("_held.key")), ""))
        voter = F.when(chars(F.col("_held")) >= (1 - OWN) * chars(F.col("_lines")), same).otherwise(F.col("_page"))
        votes = held.select("_site", "_page", voter.alias("_voter"), F.explode("_held.key").alias("_line"))
        votes = votes.groupBy("_site", "_voter", "_line").agg(F.min("_page").alias("_page"))
        found = _often(votes, totals, ratio, min_pages)
    return found.withColumnRenamed("_found", "_lines")


def line_dedup(docs: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES,
               copies: bool = True) -> DataFrame:
    """``docs`` with the lines that stay as ``text``, and n_lines and n_dropped.

    Lines are compared without blanks around them; blank lines count and go nowhere. A line
    counts once per page however often it is there, and all its copies go. Rows without a
    site are one site. Null texts stay null, with no lines; a text can become empty.
    Repeated rows are pages of their own. Other columns pass
    through, but for any that is called n_lines or n_dropped.

    Without ``copies``, exact and near copies count as ``boilerplate`` says. A line that goes
    stays on one text of its site, so that no passage is lost, and a text of which nothing but
    blank lines would be left stays whole.
    """
    lists = materialize(boilerplate(docs, site, text, ratio, min_pages, copies), "boilerplate")
    # the row travels as one column, so that no name of it can clash
    rows = docs.select(F.struct("*").alias("_row"), F.col(site).alias("_of"))
    joined = rows.join(lists, F.expr("_of <=> _site"), "left")
    lines = F.split(F.col("_row")[text], "\n")
    # of the site's list, what this text holds, by hash; its lines are then looked up among these few
    joined = joined.withColumn("_gone", F.array_intersect("_lines", F.transform(lines, _line_key)))
    if not copies:
        # the lines that this text is to keep do not count
        keeper = lambda x: F.element_at("_first", F.array_position("_lines", x).cast("int"))
        own = _text_key(F.col("_row")[text].cast("string"))
        joined = joined.withColumn("_gone", _once(own, lambda key: F.filter("_gone", lambda x: keeper(x) != key)))
    kept = _once(F.col("_gone"), lambda some: F.filter(lines, lambda x: ~F.array_contains(some, _line_key(x))))
    joined = joined.withColumn("_kept", F.when(F.size("_gone") > 0, kept).otherwise(lines))
    if not copies:
        joined = joined.withColumn("_kept", F.when(F.exists("_kept", lambda x: F.trim(x) != ""), F.col("_kept")).otherwise(lines))
    n, left = (F.coalesce(F.when(c.isNotNull(), F.size(c)), F.lit(0)).cast("long") for c in (lines, F.col("_kept")))
    passed = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(
        *[(F.array_join("_kept", "\n") if c == text else F.col("_row")[c]).alias(c) for c in passed],
        n.alias("n_lines"), (n - left).alias("n_dropped"))


SQL = rf"""
    with d as (select doc_id, source, text, string_split(text, chr(10)) l from documents),
    e as (select source, unnest(list_distinct([trim(x) for x in l if trim(x) <> ''])) x from d),
    t as (select source, count(*) n from documents group by source),
    b as (select e.source, x from e join t on e.source is not distinct from t.source group by e.source, x, n
          having count(*) >= {MIN_PAGES} and count(*) > {RATIO}::double * n),
    r as (select doc_id, text, unnest(l) x, unnest(range(len(l))) i, source from d),
    k as (select doc_id, text, count(*) n, string_agg(x, chr(10) order by i) t, count(x) m from (
            select r.doc_id, r.text, i, case when b.x is null then r.x end x from r
            left join b on r.source is not distinct from b.source and trim(r.x) = b.x) group by doc_id, text)
    select d.doc_id, coalesce(n, 0)::bigint n_lines, coalesce(n - m, 0)::bigint n_dropped,
      case when d.text is not null then sha256(coalesce(t, '')) end kept_sha256
    from d left join k on k.doc_id = d.doc_id and k.text = d.text"""


@register("op5_line_dedup", SQL)
def op5(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return line_dedup(docs.select("doc_id", "source", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
