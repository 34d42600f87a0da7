"""Grading queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeflow.operators import grading as g
from gradeflow.operators import offers as o
from gradeflow.plans.catalog import register, six
from gradeflow.plans.views import SUBMISSION_ORDER, Tables
from gradeflow.plans.views_sql import GRADED, TRUTH, graded, r6, submission, with_views


def _graded(t: Tables, letter: str = "l_partkey"):
    return g.score_submission(t.truth(), t.submission(letter), SUBMISSION_ORDER)


@register("clean_prediction", with_views(submission(), then="""
    select id, coalesce(upper(trim(predicted_idx)), 'NAN') predicted_idx, count(*) n from submission group by all"""))
def clean_prediction(t: Tables):
    return g.clean_submission(t.submission()).groupBy("id", "predicted_idx").agg(F.count("*").alias("n"))


@register("first_submission", with_views(submission(), then="""
    select id, predicted_idx, n - 1 n_repeats from (select id, predicted_idx, count(*) over (partition by id) n,
      row_number() over (partition by id order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) rn
      from submission) where rn = 1"""))
def first_submission(t: Tables):
    return g.first_submission(t.submission(), SUBMISSION_ORDER)


@register("score_submission", with_views(*GRADED, then="select id, answer_idx, meta_info, predicted_idx, correct from graded"))
def score_submission(t: Tables):
    return _graded(t)


@register("missing_predictions", with_views(TRUTH, submission(), then="""
    select id, answer_idx, meta_info from truth where id not in (select id from submission)"""))
def missing_predictions(t: Tables):
    return g.missing_predictions(t.truth(), t.submission())


@register("extra_predictions", with_views(TRUTH, submission(), then="""
    select id, count(*) n_rows from submission where id not in (select id from truth) group by id"""))
def extra_predictions(t: Tables):
    return g.extra_predictions(t.truth(), t.submission())


@register("extra_id_set", with_views(TRUTH, submission(), then="select id from submission except select id from truth"))
def extra_id_set(t: Tables):
    return g.extra_id_set(t.truth(), t.submission())


@register("invalid_predictions", with_views(*GRADED, then="""
    select id, answer_idx, meta_info from graded where predicted_idx = ''"""))
def invalid_predictions(t: Tables):
    return g.invalid_predictions(_graded(t)).select("id", "answer_idx", "meta_info")


@register("accuracy_overall", with_views(*GRADED, then=f"""
    select {r6('avg(correct::int)')} accuracy, count(*) n_total, sum(correct::int)::bigint n_correct from graded"""))
def accuracy_overall(t: Tables):
    return six(g.accuracy_overall(_graded(t)), "accuracy")


@register("accuracy_by_slice", with_views(*GRADED, then=f"""
    select meta_info, {r6('avg(correct::int)')} accuracy, count(*) n_total, sum(correct::int)::bigint n_correct
    from graded where meta_info is not null group by meta_info"""))
def accuracy_by_slice(t: Tables):
    return six(g.accuracy_by_slice(_graded(t)), "accuracy")


@register("accuracy_rollup", with_views(*GRADED, then=f"""
    select * from (select meta_info, grouping(meta_info) = 1 is_total, {r6('avg(correct::int)')} accuracy, count(*) n_total,
      sum(correct::int)::bigint n_correct from graded group by grouping sets ((), (meta_info)))
    where is_total or meta_info is not null"""))
def accuracy_rollup(t: Tables):
    return six(g.accuracy_rollup(_graded(t)), "accuracy")


TWO = [TRUTH, submission(), submission("l_suppkey", "submission2"), graded(), graded("submission2", "graded2")]


@register("accuracy_delta_by_slice", with_views(*TWO, then=f"""
    select * from (select meta_info, grouping(meta_info) = 1 is_total, {r6('avg(a)')} base_accuracy, {r6('avg(b)')} tuned_accuracy,
      {r6('avg(b) - avg(a)')} delta from (select g.meta_info, g.correct::int a, h.correct::int b
      from graded g join graded2 h on g.id = h.id) group by grouping sets ((), (meta_info)))
    where is_total or meta_info is not null"""))
def accuracy_delta_by_slice(t: Tables):
    delta = g.accuracy_delta_by_slice(_graded(t), _graded(t, "l_suppkey"))
    return six(delta, "base_accuracy", "tuned_accuracy", "delta")


@register("weakest_slices", with_views(*GRADED, then=f"""
    select meta_info, {r6('avg(correct::int)')} accuracy, count(*) n_total, sum(correct::int)::bigint n_correct
    from graded where meta_info is not null group by meta_info having count(*) >= 30
    order by avg(correct::int), meta_info limit 3"""))
def weakest_slices(t: Tables):
    return six(g.weakest_slices(_graded(t)), "accuracy")


@register("letter_macro_f1", with_views(*GRADED, then=f"""
    select letter, tp, fp, fn, {r6('f1')} f1, {r6('avg(f1) over ()')} macro_f1 from (
      select letter, tp, fp, fn, case when 2 * tp + fp + fn > 0 then 2.0::double * tp / (2 * tp + fp + fn) else 0 end f1 from (
      select letter, count(*) filter (answer_idx = letter and predicted_idx = letter) tp,
        count(*) filter (answer_idx <> letter and predicted_idx = letter) fp,
        count(*) filter (answer_idx = letter and predicted_idx <> letter) fn
      from graded cross join (select unnest(['A', 'B', 'C', 'D']) letter) group by letter))"""))
def letter_macro_f1(t: Tables):
    return six(g.letter_macro_f1(_graded(t)), "f1", "macro_f1")


@register("score_confidence", with_views(*GRADED, then=f"""
    select meta_info, {r6('p')} accuracy, n n_total, {r6('greatest(0, p - 1.96::double * sqrt(p * (1 - p) / n))')} low,
      {r6('least(1, p + 1.96::double * sqrt(p * (1 - p) / n))')} high
    from (select meta_info, avg(correct::int) p, count(*) n from graded where meta_info is not null group by meta_info)"""))
def score_confidence(t: Tables):
    return six(g.score_confidence(_graded(t)), "accuracy", "low", "high")


# specification lookups and offers

@register("enrich_with_specs", """
    select s_name id, case when s_acctbal > 5000 then concat('node ', s_suppkey) else s_name end as name,
      case when s_acctbal > 0 then 'running' else 'unknown' end status, concat('type-', s_nationkey) instance_type,
      coalesce(n_name, 'Unknown') gpu_type, coalesce(n_regionkey, 0) gpu_count, coalesce(n_regionkey * 16, 0) gpu_ram_gb
    from supplier left join nation on s_nationkey = n_nationkey and n_regionkey <> 0""")
def enrich_with_specs(t: Tables):
    return o.enrich_with_specs(t.reservations(), t.specs())


@register("best_offer", """
    select kind, region, offer_id, price, reliability from (select p_type kind, p_brand region, p_partkey offer_id,
      p_retailprice price, (p_partkey % 20) / 20 reliability, row_number() over (partition by p_type, p_brand
        order by ((p_partkey % 20) / 20 < 0.9), p_retailprice, p_partkey) rn from part where p_size >= 4) where rn = 1""")
def best_offer(t: Tables):
    return o.best_offer(t.offers(), ["kind", "region"], min_ram=4)


@register("vram_mb_to_gb", """
    select p_partkey offer_id, case when p_retailprice > 1000 then round(p_retailprice / 1024.0::double * 10) / 10
      else p_retailprice end gpu_ram_gb from (select p_partkey, case when p_retailprice * 1 > 100 and p_size > 25
      then p_retailprice + 1000 else p_size end p_retailprice from part)""")
def vram_mb_to_gb(t: Tables):
    ram = F.when((F.col("p_retailprice") > 100) & (F.col("p_size") > 25), F.col("p_retailprice") + 1000).otherwise(
        F.col("p_size").cast("double"))
    return t.part.select(F.col("p_partkey").alias("offer_id"), o.vram_mb_to_gb(ram).alias("gpu_ram_gb"))
