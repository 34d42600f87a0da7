"""Quality, diversity, safety and contamination queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeflow.functions.clock import epoch_micros
from gradeflow.operators import contamination as c
from gradeflow.operators import dedup as d
from gradeflow.operators import quality as q
from gradeflow.operators.corpus import curation_flags
from gradeflow.plans.catalog import register, six
from gradeflow.plans.views import TOPIC, Tables
from gradeflow.plans.views_sql import FIRSTS, FLAGGED, QUALITY, contained, grams, near, norm, r6, strip, with_views, words


def _scored(t: Tables):
    return q.quality_score(q.quality_components(t.documents, t.labels, TOPIC))


@register("quality_score", with_views(QUALITY, then=f"""
    select doc_id, correctness, {r6('relevance')} relevance, {r6('complexity')} complexity, {r6('clarity')} clarity,
      {r6('quality_score')} quality_score from quality"""))
def quality_score(t: Tables):
    parts = ["relevance", "complexity", "clarity", "quality_score"]
    return six(_scored(t).select("doc_id", "correctness", *parts), *parts)


@register("quality_threshold", with_views(QUALITY, then="select doc_id from quality where quality_score >= 0.6"))
def quality_threshold(t: Tables):
    return q.quality_threshold(_scored(t)).select("doc_id")


@register("quality_distribution", with_views(QUALITY, then=f"""
    select count(*) n, {r6('avg(quality_score)')} mean, {r6('quantile_cont(quality_score, 0.25)')} p25,
      {r6('quantile_cont(quality_score, 0.5)')} p50, {r6('quantile_cont(quality_score, 0.75)')} p75 from quality"""))
def quality_distribution(t: Tables):
    return six(q.quality_distribution(_scored(t)), "mean", "p25", "p50", "p75")


@register("format_compliance", f"""
    select doc_id, is_empty, open_fence, truncated, malformed, not (is_empty or open_fence or truncated or malformed) compliant
    from (select doc_id, body = '' is_empty, (len(string_split(text, '```')) - 1) % 2 = 1 open_fence,
      body <> '' and not regexp_matches(body, '[.?!…"»]$') truncated, contains(text, '�') malformed
      from (select doc_id, text, {strip('text')} body from documents))""")
def format_compliance(t: Tables):
    return q.format_compliance(t.documents.select("doc_id", "text")).drop("text")


@register("source_breakdown", "select source, count(*) n from documents group by source order by n desc, source")
def source_breakdown(t: Tables):
    return q.source_breakdown(t.documents)


@register("safety_rates", f"""
    select source, lang, count(*) n, {r6('avg(toxic)')} toxic_rate from labels join documents using (doc_id) group by source, lang""")
def safety_rates(t: Tables):
    return six(q.safety_rates(t.documents, t.labels), "toxic_rate")


@register("ngram_diversity", with_views(f"tok as (select lang, {words('text')} w from documents)", "g as (" + " union all ".join(
    f"select lang, {n} n, unnest({grams('w', n)}) gram from tok where len(w) >= {n}" for n in (1, 2, 3)) + ")", then=f"""
    select lang, n, count(distinct gram) distinct_grams, count(*) all_grams, {r6('count(distinct gram) / count(*)')} diversity
    from g group by lang, n"""))
def ngram_diversity(t: Tables):
    return six(q.ngram_diversity(t.texts(), "lang"), "diversity")


@register("topic_distribution", f"""
    select lang, source, grouping(lang, source)::int as level, count(*) n, {r6('count(*) / (select count(*) from documents)')} share
    from documents group by cube (lang, source)""")
def topic_distribution(t: Tables):
    return six(q.topic_distribution(t.documents), "share")


@register("structure_variety", with_views(f"""shaped as (select case when n < 50 then '<50' when n < 200 then '<200'
      when n < 1000 then '<1000' else '>=1000' end as length, contains(text, '?') has_question,
      regexp_matches(text, '(^|\n)[ \t]*([-*]|[0-9]+\\.)[ \t]') has_list from (select text, len({words('text')}) n from documents))""",
    "counted as (select length, has_question, has_list, count(*) n from shaped group by all)",
    "shared as (select *, n / sum(n) over () share from counted)", then=f"""
    select length, has_question, has_list, n, {r6('share')} share, {r6('-sum(share * ln(share)) over ()')} entropy from shared"""))
def structure_variety(t: Tables):
    return six(q.structure_variety(t.documents), "share", "entropy")


@register("curation_funnel", with_views(QUALITY, FIRSTS, *FLAGGED, """flags as (select q.*, q.doc_id in (select doc_id from firsts) is_first,
    q.doc_id in (select doc_id from flagged) contaminated, quality_score >= 0.6 passes from quality q)""", then="""
    select count(*) total_candidates, count(*) filter (is_first) after_dedup, count(*) filter (is_first and passes) after_quality_filter,
      count(*) filter (is_first and passes and contaminated) contamination_removed,
      count(*) filter (is_first and passes and not contaminated) final_selected from flags"""))
def curation_funnel(t: Tables):
    return q.curation_funnel(curation_flags(t.texts(), t.labels, t.benchmark, TOPIC))


# duplicates

@register("exact_dedup", with_views(FIRSTS, then="select doc_id, lang, source, n_chars from documents where doc_id in (select doc_id from firsts)"))
def exact_dedup(t: Tables):
    return d.exact_dedup(t.documents).select("doc_id", "lang", "source", "n_chars")


EARLIER = "cast(substr(source, 4) as int) % 2 = 0"


@register("cross_dataset_dedup", f"""
    select doc_id, source from documents where not ({EARLIER}) and text not in (select text from documents where {EARLIER})""")
def cross_dataset_dedup(t: Tables):
    """Sources with an even number are the earlier sets, the others the candidates."""
    earlier = F.substring("source", 4, 10).cast("int") % 2 == 0
    return d.cross_dataset_dedup(t.documents.where(~earlier), t.documents.where(earlier)).select("doc_id", "source")


def _minhash() -> str:
    """The rule of the operator: hashes of md5 digits, verified links, then the rows in the order of their ids."""
    family = d.hash_family(d.HASHES, 42)
    a, b = (f"[{', '.join(str(x[k]) for x in family)}]" for k in (0, 1))
    return f"""with recursive mw as (select doc_id, {words('text')} w from documents),
    mg as (select doc_id, unnest(case when len(w) >= 5 then {grams('w', 5)} else [array_to_string(w, ' ')] end) g from mw),
    sh as (select distinct doc_id, ('0x' || substr(md5(g), 1, 15))::bigint x from mg),
    sizes as (select doc_id, count(*) n from sh group by doc_id),
    fam as (select unnest(range(0, {d.HASHES})) k, unnest({a}) a, unnest({b}) b),
    sig as (select doc_id, k, min((a * (x % {d.PRIME}) + b) % {d.PRIME}) m from sh cross join fam group by doc_id, k),
    bands as (select doc_id, k // {d.ROWS} band, string_agg(m::varchar, ',' order by k) v from sig group by doc_id, k // {d.ROWS}),
    cand as (select distinct r.doc_id id, l.doc_id other from bands l join bands r using (band, v) where l.doc_id < r.doc_id),
    common as (select id, other, count(*) c from cand join sh s on s.doc_id = id join sh o on o.doc_id = other and o.x = s.x group by id, other),
    links as (select id, other from common join sizes s on s.doc_id = id join sizes o on o.doc_id = other where c >= 0.8::double * (s.n + o.n - c)),
    ends as (select id, list(other) others, row_number() over (order by id) k from links group by id),
    walk as (select 0::bigint k, []::bigint[] gone union all
      select e.k, case when len(list_filter(e.others, lambda o: not list_contains(w.gone, o))) > 0 then list_append(w.gone, e.id) else w.gone end
      from walk w join ends e on e.k = w.k + 1),
    dropped as (select unnest(gone) id from (select gone from walk order by k desc limit 1))
    select doc_id, duplicate_of is null kept, duplicate_of from documents left join (
      select id, min(other) duplicate_of from links where id in (select id from dropped) and other not in (select id from dropped) group by id)
    on id = doc_id"""


@register("minhash_dedup", _minhash())
def minhash_dedup(t: Tables):
    return d.minhash_dedup(t.texts())


# contamination

@register("contamination_exact", f"""
    select doc_id from documents where source <> 'src0' and md5({norm('text')}) in (
      select md5({norm('text')}) from benchmark union all select md5({norm('text')}) from documents where source = 'src0')""")
def contamination_exact(t: Tables):
    """One source is held out together with the items; documents of the others are checked."""
    held_out = t.documents.where("source = 'src0'").select(F.col("doc_id").alias("item_id"), "text")
    others = t.documents.where("source <> 'src0'").select("doc_id", "text")
    return c.contamination_exact(others, t.benchmark.unionByName(held_out)).select("doc_id")


@register("contamination_contained", with_views(contained(), then="select doc_id, item_id from contained"))
def contamination_contained(t: Tables):
    return c.contained_items(t.texts(), t.benchmark)


@register("contamination_near", with_views(near(), then=f"select doc_id, item_id, {r6('share')} share from near"))
def contamination_near(t: Tables):
    return six(c.near_items(t.texts(), t.benchmark), "share")


@register("contamination_rate", with_views(*FLAGGED, then=f"""
    select count(*) total, count(f.doc_id) flagged, {r6('count(f.doc_id) / count(*)')} rate
    from documents d left join flagged f on d.doc_id = f.doc_id"""))
def contamination_rate(t: Tables):
    return six(c.contamination_rate(t.texts(), t.benchmark), "rate")


@register("contamination_filter", with_views(*FLAGGED, then="""
    select doc_id, source from documents where doc_id not in (select doc_id from flagged)"""))
def contamination_filter(t: Tables):
    return c.contamination_filter(t.texts(), t.benchmark).select("doc_id", "source")


# variance and latency

@register("run_consistency", f"select user_id, event_type, count(*) n, {r6('var_samp(value)')} variance from events group by user_id, event_type")
def run_consistency(t: Tables):
    return six(q.run_consistency(t.events, ["user_id", "event_type"]), "variance")


@register("latency_profile", f"""
    select count(*) n, {r6('avg(value)')} mean, {r6('quantile_cont(value, 0.5)')} p50, {r6('quantile_cont(value, 0.95)')} p95,
      {r6('quantile_cont(value, 0.99)')} p99, {r6('count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6)')} throughput from events""")
def latency_profile(t: Tables):
    timed = t.events.withColumn("micros", epoch_micros(t.events, "ts"))
    return six(q.latency_profile(timed, "value", "micros"), "mean", "p50", "p95", "p99", "throughput")
