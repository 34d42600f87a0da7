"""Layout, prompt, filter, sampling and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeflow.functions import prompts
from gradeflow.functions import text as x
from gradeflow.functions import udfs
from gradeflow.functions.pyhelpers import parse_options as parse_options_text
from gradeflow.operators import layout as lay
from gradeflow.operators import ordering as od
from gradeflow.operators import scores as sc
from gradeflow.operators import validate as v
from gradeflow.plans.catalog import register, six
from gradeflow.plans.views import Tables
from gradeflow.session import materialize
from gradeflow.plans.views_sql import (
    PAIRS, PREFERENCES, SPLITS, TEXT_PAIRS, TENTH, norm, split, strip, with_views, words,
)

MAX_LENGTH = 512


def _nested(t: Tables):
    return lay.nest_turns(t.conversations)


def _split_pairs(t: Tables):
    return od.exact_split(t.pairs(), "pair_id")


def _shapes(t: Tables):
    """Named tables of every layout."""
    return {
        "pairs": t.pairs(),
        "prompts": t.text_pairs().select(F.col("reference").alias("prompt"), F.col("prediction").alias("completion")),
        "talks": _nested(t),
        "answers": t.part.select(F.col("p_name").alias("question"), F.col("p_type").alias("answer")),
        "responses": t.part.select(F.col("p_name").alias("question"), F.col("p_brand").alias("response")),
        "documents": t.documents,
    }


ALPACA_PAIRS = "coalesce(instruction, '') <> '' and coalesce(output, '') <> ''"


@register("detect_layout", with_views(PAIRS, TEXT_PAIRS, then=f"""
    select 'pairs' as name, 'alpaca' layout, count(*) n_pairs from pairs where {ALPACA_PAIRS}
    union all select 'prompts', 'openai', count(*) from text_pairs where prediction <> '' and reference <> ''
    union all select 'talks', 'chat', count(*) from text_pairs where prediction <> '' and reference <> ''
    union all select 'answers', 'gsm8k', count(*) from part
    union all select 'responses', 'qa', count(*) from part
    union all select 'documents', 'unknown', 0"""))
def detect_layout(t: Tables):
    result = None
    for name, df in _shapes(t).items():
        row = lay.to_alpaca(df).agg(F.count("*").alias("n_pairs")).select(
            F.lit(name).alias("name"), F.lit(lay.detect_layout(df.columns)).alias("layout"), "n_pairs")
        result = row if result is None else result.unionByName(row)
    return result


@register("to_alpaca", with_views(PAIRS, then=f"""
    select pair_id, md5(instruction) i, input, md5(output) o from pairs where {ALPACA_PAIRS}"""))
def to_alpaca(t: Tables):
    pairs = lay.to_alpaca(t.pairs(), keep=["pair_id"])
    return pairs.select("pair_id", F.md5("instruction").alias("i"), "input", F.md5("output").alias("o"))


@register("drop_empty_pairs", with_views(PAIRS, then=f"select pair_id from pairs where {ALPACA_PAIRS}"))
def drop_empty_pairs(t: Tables):
    return lay.drop_empty_pairs(t.pairs()).select("pair_id")


@register("chat_to_alpaca", with_views(TEXT_PAIRS, then="""
    select id conv_id, reference instruction, '' input, prediction output from text_pairs
    where prediction <> '' and reference <> ''"""))
def chat_to_alpaca(t: Tables):
    return lay.chat_to_alpaca(t.conversations)


@register("render_prompt", with_views(PAIRS, then="""
    select pair_id, concat('### Instruction:\n', instruction, '\n\n### Input:\n', input, '\n\n### Response:\n', output) as text
    from pairs""".replace("\\n", "\n")))
def render_prompt(t: Tables):
    return lay.render_prompt(t.pairs(), keep=["pair_id"])


@register("render_chat_sections", """
    select conv_id, coalesce(string_agg(case role when 'system' then '### System:
' when 'user' then '### User:
' else '### Assistant:
' end || coalesce(text, ''), '

' order by turn), '') as text from conversations group by conv_id""")
def render_chat_sections(t: Tables):
    return lay.render_chat_sections(t.conversations)


@register("format_training_text", with_views(PAIRS, then="""
    select 'pairs' kind, pair_id id, concat('<|im_start|>user\n', instruction,
      case when input <> '' then concat('\n\nContext: ', input) else '' end,
      '<|im_end|>\n<|im_start|>assistant\n', output, '<|im_end|>\n') as text from pairs
    union all select 'chat', conv_id, string_agg(concat('<|im_start|>', role, '\n', text, '<|im_end|>\n'), '' order by turn)
      from conversations group by conv_id
    union all select 'qa', p_partkey, concat('<|im_start|>user\n', p_name, '<|im_end|>\n<|im_start|>assistant\n', p_type, '<|im_end|>\n') from part
    union all select 'text', doc_id, text from documents
    union all select 'rest', c_custkey, concat_ws(' ', c_name, c_mktsegment) from customer""".replace("\\n", "\n")))
def format_training_text(t: Tables):
    parts = {
        "pairs": t.pairs().withColumnRenamed("pair_id", "id"),
        "chat": _nested(t).withColumnRenamed("conv_id", "id"),
        "qa": t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("question"), F.col("p_type").alias("answer")),
        "text": t.documents.select(F.col("doc_id").alias("id"), "text"),
        "rest": t.customer.withColumnRenamed("c_custkey", "id"),
    }
    result = None
    for kind, df in parts.items():
        one = lay.format_training_text(df, keep=["id"]).select(F.lit(kind).alias("kind"), "id", "text")
        result = one if result is None else result.unionByName(one)
    return result


FAMILIES = ["Qwen2.5-", "Meta-LLaMA-3-", "TinyLlama-", "Phi-3-", "Mistral-7B-", "gemma-2-", "DeepSeek-", "Yi-", "other-"]


@register("chat_template_for", f"""
    select p_partkey, case when contains(n, 'qwen') then 'chatml' when contains(n, 'llama') then 'llama-3'
      when contains(n, 'phi') then 'phi-3' when contains(n, 'mistral') then 'mistral' when contains(n, 'gemma') then 'gemma'
      else 'chatml' end template from (select p_partkey,
      lower(concat(list_extract({FAMILIES}, 1 + p_size % {len(FAMILIES)}), p_name)) n from part)""")
def chat_template_for(t: Tables):
    families = F.array(*[F.lit(f) for f in FAMILIES])
    name = F.concat(F.element_at(families, (F.col("p_size") % len(FAMILIES) + 1).cast("int")), F.col("p_name"))
    return t.part.select("p_partkey", prompts.chat_template_for(name).alias("template"))


@register("qa_prompt", with_views(PAIRS, then="""
    select pair_id, concat(case when input <> '' then concat('Context: ', input, '\n\n') else '' end,
      'Question: ', instruction, '\n\nAnswer:') prompt from pairs""".replace("\\n", "\n")))
def qa_prompt(t: Tables):
    return t.pairs().select("pair_id", prompts.qa_prompt("instruction", "input").alias("prompt"))


@register("mc_prompt", """
    select p_partkey id, concat('You are a medical expert answering a USMLE-style question. Read the clinical vignette and choose the single best answer.

Question: ', p_name, '

Options:
', case when p_size = 13 then '' else concat('A. ', p_name, '''s
B. ', p_size, '
C. ', p_brand, '
D. ', p_type) end, '

Answer with only the letter (A, B, C, or D). Answer:') prompt from part""")
def mc_prompt(t: Tables):
    parsed = t.items().withColumn("options", parse_options_text("options"))
    return parsed.select("id", prompts.choice_prompt("question", "options").alias("prompt"))


@register("parse_options", """
    select p_partkey id, case when p_size = 13 then 0 else 4 end n_options,
      case when p_size <> 13 then concat(p_name, '''s') end a, case when p_size <> 13 then cast(p_size as varchar) end b
    from part""")
def parse_options(t: Tables):
    parsed = t.items().select("id", parse_options_text("options").alias("o"))
    return parsed.select("id", F.size("o").alias("n_options"), F.try_element_at("o", F.lit("A")).alias("a"),
                         F.try_element_at("o", F.lit("B")).alias("b"))


@register("extract_choice", r"""
    select doc_id, coalesce(nullif(regexp_extract(u, '(^|[^\p{L}\p{N}\p{M}_])([A-D])($|[^\p{L}\p{N}\p{M}_])', 2), ''),
      nullif(regexp_extract(u, '([A-D])', 1), ''), 'A') letter from (select doc_id, upper(text) u from documents)""")
def extract_choice(t: Tables):
    return t.documents.select("doc_id", prompts.extract_choice("text").alias("letter"))


@register("tokenize_pad", with_views(PAIRS, f"""ids as (select pair_id, list_transform(list_slice({words('text')}, 1, {MAX_LENGTH}),
    lambda w: cast(cast(concat('0x', substr(md5(w), 1, 8)) as bigint) % 50000 + 1 as int)) ids
    from (select pair_id, concat('### Instruction:\n', instruction, '\n\n### Input:\n', input, '\n\n### Response:\n', output) as text
      from (select pair_id, coalesce(instruction, '') instruction, input, coalesce(output, '') output from pairs)))""".replace("\\n", "\n"),
    then=f"""select pair_id, len(ids)::int n_tokens, {MAX_LENGTH} n_ids, list_sum(ids)::bigint id_sum,
      (list_sum(ids) - 100 * ({MAX_LENGTH} - len(ids)))::bigint label_sum, array_to_string(list_slice(ids, 1, 5), ',') head from ids"""))
def tokenize_pad(t: Tables):
    texts = lay.render_prompt(t.pairs(), keep=["pair_id"])
    padded = lay.tokenize_pad(texts, "text", MAX_LENGTH, keep=["pair_id"])
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, e: a + e)
    return padded.select(
        "pair_id", total("attention_mask").cast("int").alias("n_tokens"), F.size("input_ids").alias("n_ids"),
        total("input_ids").alias("id_sum"), total("labels").alias("label_sum"),
        F.array_join(F.slice("input_ids", 1, 5), ",").alias("head"),
    )


@register("tokenize_subwords")
def tokenize_subwords(t: Tables):
    """Ids of a trained tokenizer, cut after encoding; no SQL form, the tests hold them against the tokenizer's."""
    padded = lay.tokenize_pad(t.texts(), "text", MAX_LENGTH, keep=["doc_id"], tokenizer="byte_bpe_50k.json")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, e: a + e)
    return padded.select("doc_id", total("attention_mask").cast("int").alias("n_tokens"), total("input_ids").alias("id_sum"),
                         F.md5(F.array_join("input_ids", ",")).alias("ids_md5"))


@register("preference_pairs", with_views(PREFERENCES, then="select conv_id, prompt, chosen, rejected from preferences"))
def preference_pairs(t: Tables):
    return lay.preference_pairs(t.preferences(), keep=["conv_id"])


@register("rl_queries", "select doc_id, md5(text) query_hash from documents")
def rl_queries(t: Tables):
    return lay.rl_queries(t.documents, keep=["doc_id"]).select("doc_id", F.md5("query").alias("query_hash"))


@register("version_tags", """
    select p_partkey, concat('v0.1.0-', replace(w, '_', '-')) version_tag, concat('ds-v0.1.0-', replace(w, '_', '-')) dataset_tag
    from (select p_partkey, concat(lower(p_type), '_', replace(p_name, ' ', '_')) w from part)""")
def version_tags(t: Tables):
    weakness = F.concat(F.lower("p_type"), F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("_")))
    return t.part.select("p_partkey", prompts.version_tag(weakness).alias("version_tag"),
                         prompts.dataset_tag(weakness).alias("dataset_tag"))


@register("prompt_template", """
    select p_partkey id, concat('[INST] ', p_name, ' / ', p_type, ' [/INST] ', p_brand) as text from part""")
def prompt_template(t: Tables):
    shaped = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("instruction"),
                           F.col("p_type").alias("input"), F.col("p_brand").alias("output"))
    return lay.render_prompt(shaped, keep=["id"], template="[INST] {instruction} / {input} [/INST] {output}")


# user functions

def _load_rules(path: str) -> dict:
    return {"ECONOMY": "D", "LARGE": "b"}


def _predict_by_rule(model: dict, question: str, options: dict, meta_info: str, phrases: str) -> str:
    if not options:
        raise ValueError("no options")
    return model.get(options["D"], "?")


@register("batch_predict", """
    select p_partkey id, case when p_size = 13 then 'A' when p_type = 'ECONOMY' then 'D' when p_type = 'LARGE' then 'B' else 'A' end predicted_idx,
      p_size = 13 or p_type not in ('ECONOMY', 'LARGE') fallback from part""")
def batch_predict(t: Tables):
    return udfs.batch_predict(t.items(), _load_rules, _predict_by_rule)


@register("answer_with", with_views(PAIRS, then="""
    select pair_id, md5(concat(coalesce(instruction, ''), '|', input)) p, md5(coalesce(output, '')) r from pairs"""))
def answer_with(t: Tables):
    answers = udfs.answer_with(t.pairs(), lambda i, c: f"{i}|{c}", key="pair_id")
    return answers.select("pair_id", F.md5("prediction").alias("p"), F.md5("reference").alias("r"))


@register("reward_with", "select doc_id, length(text) % 7 / 2.0::double reward from documents")
def reward_with(t: Tables):
    reward = udfs.reward_with("text", lambda texts: [len(s) % 7 / 2.0 for s in texts])
    return t.documents.select("doc_id", reward.alias("reward"))


@register("map_rows", "select c_custkey, concat(c_name, '!') as name, length(c_mktsegment) n from customer")
def map_rows(t: Tables):
    def change(row: dict) -> dict:
        return {"c_custkey": row["c_custkey"], "name": row["c_name"] + "!", "n": len(row["c_mktsegment"])}

    return udfs.map_rows(t.customer.select("c_custkey", "c_name", "c_mktsegment"), change, "c_custkey long, name string, n long")


# sampling and splits

@register("head_limit", "select doc_id, lang from documents order by doc_id limit 50")
def head_limit(t: Tables):
    return od.head_limit(t.documents.select("doc_id", "lang"), ["doc_id"], 50)


@register("seeded_sample", """
    select doc_id, lang from documents order by md5(concat('42:', doc_id)), cast(doc_id as varchar) limit 500""")
def seeded_sample(t: Tables):
    return od.seeded_sample(t.documents.select("doc_id", "lang"), "doc_id", 500)


@register("exact_split", with_views(split("documents", "doc_id", TENTH), then="select doc_id, split from splits"))
def exact_split(t: Tables):
    return od.exact_split(t.documents, "doc_id").select("doc_id", "split")


@register("ratio_split", with_views(split("documents", "doc_id", "cast(ceil(total * 0.15::double) as bigint)"), then="select doc_id, split from splits"))
def ratio_split(t: Tables):
    return od.ratio_split(t.documents, "doc_id", 0.15).select("doc_id", "split")


# validation

ISSUES = f"""positioned as (select *, row_number() over (partition by split order by pair_id) - 1 idx from splits),
issues as (select split, idx, 0 as "check", concat('missing fields: ', concat_ws(',',
    case when instruction is null then 'instruction' end, case when output is null then 'output' end)) issue
  from positioned where instruction is null or output is null
  union all select split, idx, 1, 'empty instruction' from positioned where {strip('instruction')} = ''
  union all select split, idx, 2, 'empty output' from positioned where {strip('output')} = ''),
ordered as (select split, idx, issue, "check", row_number() over (partition by split order by idx, "check") rn,
  count(*) over (partition by split) n from issues)"""


def _issues(t: Tables):
    # the texts are read once; what is positioned has ids and issue names only
    flagged = materialize(v.flag_issues(_split_pairs(t), ["split", "pair_id"]), "issues")
    return v.format_issues(od.with_position(flagged, ["pair_id"], by=["split"]))


@register("format_issues", with_views(*SPLITS, ISSUES, then="select split, idx, issue from issues"))
def format_issues(t: Tables):
    return _issues(t).select("split", "idx", "issue")


@register("issue_report_top10", with_views(*SPLITS, ISSUES, then="""
    select split, rn line, concat('record ', idx, ': ', issue) message from ordered where rn <= 10
    union all select split, 11, concat('... and ', max(n) - 10, ' more issues') from ordered group by split having max(n) > 10"""))
def issue_report_top10(t: Tables):
    return v.issue_report(_issues(t))


@register("missing_fields", with_views(PAIRS, then="""
    select pair_id, concat_ws(',', case when instruction is null then 'instruction' end,
      case when output is null then 'output' end) missing from pairs"""))
def missing_fields(t: Tables):
    return t.pairs().select("pair_id", F.array_join(v.missing_fields(), ",").alias("missing"))


DUPES = """dupes as (select split, count(*) n, count(distinct md5(concat(instruction, '|||', output))) n_unique from splits group by split)"""


@register("exact_duplicates", with_views(*SPLITS, DUPES, then="select split, n, n_unique, n - n_unique n_duplicates from dupes"))
def exact_duplicates(t: Tables):
    return v.exact_duplicates(_split_pairs(t))


def _stats(name: str, c: str) -> str:
    return f"round(avg({c}) * 10) / 10 avg_{name}_words, min({c})::int min_{name}_words, max({c})::int max_{name}_words"


STATS = f"""stats as (select split, count(*) n, {_stats('instruction', 'i')}, {_stats('output', 'o')} from (
  select split, len({words('instruction')}) i, len({words('output')}) o from splits) group by split)"""


@register("length_stats", with_views(*SPLITS, STATS, then="select * from stats"))
def length_stats(t: Tables):
    return v.length_stats(_split_pairs(t))


@register("validation_report", with_views(*SPLITS, STATS, DUPES, ISSUES, then="""
    select e.split, s.* exclude (split), d.n_unique, d.n - d.n_unique n_duplicates, i.n_issues, s.n is not null valid
    from (select unnest(['train', 'eval', 'test']) split) e left join stats s on e.split = s.split
    left join dupes d on e.split = d.split left join (select p.split, count("check") n_issues
      from (select distinct split from positioned) p left join issues using (split) group by p.split) i on e.split = i.split"""))
def validation_report(t: Tables):
    return v.validation_report(_split_pairs(t), ("train", "eval", "test"))


@register("union_splits", """
    select split, count(*) n, count(distinct user_id) users from (select 'train' split, user_id from events where event_type <> 'error'
    union all select 'eval', user_id from events where event_type = 'error') group by split""")
def union_splits(t: Tables):
    both = v.union_splits(t.events.where("event_type <> 'error'"), t.events.where("event_type = 'error'"))
    per_user = both.groupBy("split", "user_id").agg(F.count("*").alias("c"))
    return per_user.groupBy("split").agg(F.sum("c").alias("n"), F.count("*").alias("users"))


# row functions

@register("normalize_answer", f"select doc_id, md5({norm('text')}) h from documents")
def normalize_answer(t: Tables):
    return t.documents.select("doc_id", F.md5(x.normalize_answer("text")).alias("h"))


@register("word_count", f"select doc_id, len({words('text')})::int n from documents")
def word_count(t: Tables):
    return t.documents.select("doc_id", x.word_count("text").alias("n"))


@register("length_reward", "select doc_id, least(length(text) / 100.0::double, 1.0::double) reward from documents")
def length_reward(t: Tables):
    return t.documents.select("doc_id", sc.length_reward("text").alias("reward"))


@register("reward_mean", with_views(PREFERENCES, then="""
    select conv_id // 16 batch, round(avg(least(length(chosen) / 100.0::double, 1.0::double)) * 1e6) / 1e6 reward_mean
    from preferences group by batch"""))
def reward_mean(t: Tables):
    rewards = t.preferences().select(F.floor(F.col("conv_id") / 16).cast("long").alias("batch"),
                                     F.when(F.col("chosen").isNotNull(), sc.length_reward("chosen")).alias("reward"))
    return six(sc.reward_mean(rewards), "reward_mean")
