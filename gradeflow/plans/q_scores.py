"""Prediction/reference score queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeflow.operators import scores as s
from gradeflow.plans.catalog import register, six
from gradeflow.plans.stems_sql import stem_lists
from gradeflow.plans.views import Tables
from gradeflow.plans.views_sql import TEXT_PAIRS, ascii_words, grams, norm, norm_words, r6, strip, with_views, words


def overlap(tokens, orders, name: str = "overlap", stem: bool = False) -> str:
    """Clipped n-gram matches per pair and n, by exploding both sides."""
    plain = f"toks_{name} as (select id, {tokens('prediction')} p, {tokens('reference')} r from text_pairs)"
    if stem:
        plain = plain.replace(f"toks_{name}", f"words_{name}", 1) + ",\n" + stem_lists(f"words_{name}", ["p", "r"], f"toks_{name}")
    parts = []
    for n in orders:
        for side, c in (("p", "prediction"), ("r", "reference")):
            toks = f"toks_{name}"
            parts.append(f"select id, {n} n, unnest({grams(side, n)}) gram, {int(side == 'p')} p, {int(side == 'r')} r "
                         f"from {toks} where len({side}) >= {n}")
    return f"""{plain},
grams_{name} as ({' union all '.join(parts)}),
{name} as (select t.id, n.n, coalesce(matches, 0)::bigint matches, coalesce(np, 0)::bigint n_prediction,
  coalesce(nr, 0)::bigint n_reference from toks_{name} t cross join (select unnest({list(orders)}) n) n
  left join (select id, n, sum(least(p, r)) matches, sum(p) np, sum(r) nr from (
    select id, n, gram, sum(p) p, sum(r) r from grams_{name} group by id, n, gram) group by id, n) o
  on o.id = t.id and o.n = n.n)"""


def f1(m: str, np: str, nr: str, both: float = 0.0) -> str:
    return (f"case when {np} = 0 and {nr} = 0 then {both}::double when {m} = 0 then 0::double else "
            f"2 * (({m} / {np}) * ({m} / {nr})) / (({m} / {np}) + ({m} / {nr})) end")


TOKEN_F1 = overlap(norm_words, (1,), "norm_overlap") + f""",
token_f1 as (select id, {f1('matches', 'n_prediction', 'n_reference', 1.0)} f1 from norm_overlap)"""
ROUGE_VIEW = f"""rouge as (select id, max(case when n = 1 then f end) rouge1, max(case when n = 2 then f end) rouge2 from (
  select id, n, {f1('matches', 'n_prediction', 'n_reference')} f from rouge_overlap) group by id)"""
ROUGE = overlap(ascii_words, (1, 2), "rouge_overlap") + ",\n" + ROUGE_VIEW
ROUGE_STEMS = overlap(ascii_words, (1, 2), "rouge_overlap", stem=True) + ",\n" + ROUGE_VIEW
BLEU = overlap(words, (1, 2, 3, 4), "bleu_overlap")


def _bleu() -> str:
    sums = ", ".join(f"sum(matches) filter (n = {n})::double m{n}, sum(greatest(n_prediction, 1)) filter (n = {n})::double p{n}" for n in (1, 2, 3, 4))
    logs = " + ".join(f"0.25 * ln(case when m{n} = 0 then 0.1 else m{n} end / greatest(p{n}, 1))" for n in (1, 2, 3, 4))
    return f"""bleu_sums as (select {sums}, sum(n_prediction) filter (n = 1)::double c1, sum(n_reference) filter (n = 1)::double r1 from bleu_overlap),
bleu as (select case when m1 = 0 then 0 else (case when c1 > r1 then 1 else exp(1 - r1 / c1) end) * exp({logs}) end bleu from bleu_sums)"""


# longest common subsequence: equal words are points (i, j); each recursion step drops the points
# without another one to their lower left, so the number of steps is the length
LCS_VIEW = f"""lcs_p as (select id, i, p[i] t from (select id, p, unnest(range(1, len(p) + 1)) i from lcs_toks)),
lcs_r as (select id, j, r[j] t from (select id, r, unnest(range(1, len(r) + 1)) j from lcs_toks)),
lcs_rows as (select id, i, j, 1::bigint k from lcs_p join lcs_r using (id, t)
  union all
  select id, i, j, k + 1 from (select *, min(j) over (partition by id order by i
    range between unbounded preceding and 1 preceding) low from lcs_rows) where low < j),
rouge_l as (select id, {f1('m', 'len(p)', 'len(r)')} f from (select t.id, p, r, coalesce(max(k), 0) m
  from lcs_toks t left join lcs_rows l on t.id = l.id group by t.id, p, r))"""
LCS = f"lcs_toks as (select id, {ascii_words('prediction')} p, {ascii_words('reference')} r from text_pairs),\n" + LCS_VIEW
# the stems are those of the n-gram scores
LCS_STEMS = "lcs_toks as (select * from toks_rouge_overlap),\n" + LCS_VIEW
VECTORS = """v as (select vec_id // 16 id, vec_id % 16 < 8 p, vec_id, embedding::double[] e from embeddings),
c as (select a.id, a.vec_id x, b.vec_id y, list_cosine_similarity(a.e, b.e) c from v a join v b on a.id = b.id and a.p and not b.p),
m as (select i.id, coalesce((select avg(m) from (select max(c) m from c where c.id = i.id group by x)), 0) p,
  coalesce((select avg(m) from (select max(c) m from c where c.id = i.id group by y)), 0) r from (select distinct id from v) i),
vectors as (select id, p, r, case when p + r = 0 then 0 else 2 * p * r / (p + r) end f from m)"""
EM = f"cast({norm('prediction')} = {norm('reference')} as int)"


@register("token_f1", with_views(TEXT_PAIRS, TOKEN_F1, then=f"select id, {r6('f1')} f1 from token_f1"))
def token_f1(t: Tables):
    return six(s.token_f1(t.text_pairs()), "f1")


@register("token_set_f1", with_views(TEXT_PAIRS, f"""sets as (select id, list_distinct({words('lower(prediction)')}) p,
    list_distinct({words('lower(reference)')}) r from text_pairs)""",
    then=f"select id, {r6(f1('len(list_intersect(p, r))', 'len(p)', 'len(r)'))} f1 from sets"))
def token_set_f1(t: Tables):
    return six(t.text_pairs().select("id", s.token_set_f1("prediction", "reference").alias("f1")), "f1")


@register("exact_match_norm", with_views(TEXT_PAIRS, then=f"select id, {EM}::double exact_match from text_pairs"))
def exact_match_norm(t: Tables):
    return t.text_pairs().select("id", s.exact_match_norm("prediction", "reference").alias("exact_match"))


@register("exact_match_plain", with_views(TEXT_PAIRS, then=f"""
    select id, same compared, case when p = '' or r = '' then 0 else same end zeroed from (
      select id, p, r, cast(p = r as double) same from (select id, lower({strip('prediction')}) p, lower({strip('reference')}) r from text_pairs))"""))
def exact_match_plain(t: Tables):
    return t.text_pairs().select(
        "id", s.exact_match_plain("prediction", "reference").alias("compared"),
        s.exact_match_plain("prediction", "reference", "zero").alias("zeroed"))


@register("pair_by_position", with_views(TEXT_PAIRS, then="""
    select l.doc_id id, md5(l.text) p, md5(r.reference) r from documents l join text_pairs r on l.doc_id = r.id"""))
def pair_by_position(t: Tables):
    left = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("prediction"))
    pairs = s.pair_by_position(left, t.text_pairs().select("id", "reference"))
    return pairs.select("id", F.md5("prediction").alias("p"), F.md5("reference").alias("r"))


@register("common_tokens", with_views(TEXT_PAIRS, then=f"""
    select id, array_to_string(list_sort(list_distinct(list_intersect({norm_words('prediction')}, {norm_words('reference')}))), ' ') common
    from text_pairs"""))
def common_tokens(t: Tables):
    return t.text_pairs().select(
        "id", F.array_join(F.array_sort(s.common_tokens("prediction", "reference")), " ").alias("common"))


@register("rouge_n", with_views(TEXT_PAIRS, ROUGE, then=f"select id, {r6('rouge1')} rouge1, {r6('rouge2')} rouge2 from rouge"))
def rouge_n(t: Tables):
    return six(s.rouge_n(t.text_pairs()), "rouge1", "rouge2")


@register("rouge_l", with_views(TEXT_PAIRS, LCS, then=f"select id, {r6('f')} \"rougeL\" from rouge_l").replace("with", "with recursive", 1))
def rouge_l(t: Tables):
    return six(s.rouge_l(t.text_pairs()), "rougeL")


@register("bleu_counts", with_views(TEXT_PAIRS, BLEU, then="select * from bleu_overlap"))
def bleu_counts(t: Tables):
    return s.bleu_counts(t.text_pairs())


@register("corpus_bleu", with_views(TEXT_PAIRS, BLEU, _bleu(), then=f"select {r6('bleu')} bleu from bleu"))
def corpus_bleu(t: Tables):
    return six(s.corpus_bleu(s.bleu_counts(t.text_pairs())), "bleu")


@register("qa_f1_em_mean", with_views(TEXT_PAIRS, TOKEN_F1, then=f"""
    select {r6('avg(f1)')} f1, {r6(f'(select avg({EM}) from text_pairs)')} exact_match from token_f1"""))
def qa_f1_em_mean(t: Tables):
    return six(s.qa_f1_em_mean(t.text_pairs()), "f1", "exact_match")


ROUGE_MEANS = f"""
    select {r6('avg(rouge1)')} rouge1, {r6('avg(rouge2)')} rouge2, {r6('(select avg(f) from rouge_l)')} "rougeL" from rouge"""


@register("rouge_mean", with_views(TEXT_PAIRS, ROUGE_STEMS, LCS_STEMS, then=ROUGE_MEANS).replace("with", "with recursive", 1))
def rouge_mean(t: Tables):
    return six(s.rouge_mean(t.text_pairs()), "rouge1", "rouge2", "rougeL")


@register("rouge_plain", with_views(TEXT_PAIRS, ROUGE, LCS, then=ROUGE_MEANS).replace("with", "with recursive", 1))
def rouge_plain(t: Tables):
    return six(s.rouge_mean(t.text_pairs(), stem=False), "rouge1", "rouge2", "rougeL")


@register("rouge_stemmed", with_views(TEXT_PAIRS, ROUGE_STEMS, LCS_STEMS, then=f"""
    select id, {r6('rouge1')} rouge1, {r6('rouge2')} rouge2, {r6('f')} "rougeL" from rouge join rouge_l using (id)""").replace("with", "with recursive", 1))
def rouge_stemmed(t: Tables):
    """The scores of each pair, on word stems."""
    pairs = t.text_pairs()
    stems = s.pair_stems(pairs)
    return six(s.rouge_n(pairs, stem=True, stems=stems).join(s.rouge_l(pairs, stem=True, stems=stems), "id"), "rouge1", "rouge2", "rougeL")


@register("all_qa_metrics", with_views(TEXT_PAIRS, TOKEN_F1, ROUGE_STEMS, LCS_STEMS, BLEU, _bleu(), VECTORS, then=f"""
    select 'f1' metric, {r6('avg(f1)')} as value from token_f1
    union all select 'exact_match', {r6(f'avg({EM})')} from text_pairs
    union all select 'rouge1', {r6('avg(rouge1)')} from rouge
    union all select 'rouge2', {r6('avg(rouge2)')} from rouge
    union all select 'rougeL', {r6('avg(f)')} from rouge_l
    union all select 'bleu', {r6('bleu')} from bleu
    union all select 'bertscore_precision', {r6('avg(p)')} from vectors
    union all select 'bertscore_recall', {r6('avg(r)')} from vectors
    union all select 'bertscore_f1', {r6('avg(f)')} from vectors""").replace("with", "with recursive", 1))
def all_qa_metrics(t: Tables):
    return six(s.all_qa_metrics(t.text_pairs(), vectors=t.vector_pairs()), "value")


@register("metric_hook", with_views(TEXT_PAIRS, TOKEN_F1, BLEU, _bleu(), then=f"""
    select 'f1' metric, {r6('avg(f1)')} as value from token_f1
    union all select 'exact_match', {r6(f'avg({EM})')} from text_pairs
    union all select 'bleu', {r6('bleu')} from bleu
    union all select 'length_gap', {r6('avg(length(prediction) - length(reference))')} from text_pairs"""))
def metric_hook(t: Tables):
    gap = lambda pairs: pairs.agg(F.avg(F.length("prediction") - F.length("reference")).alias("length_gap"))
    return six(s.metric_hook(t.text_pairs(), "f1", "exact_match", "bleu", "length_gap", extra={"length_gap": gap}), "value")


@register("greedy_vector_match", with_views(VECTORS, then=f"""
    select id, {r6('p')} as "precision", {r6('r')} recall, {r6('f')} f1 from vectors"""))
def greedy_vector_match(t: Tables):
    return six(s.greedy_vector_match(t.vector_pairs(), keep=["id"]), "precision", "recall", "f1")
