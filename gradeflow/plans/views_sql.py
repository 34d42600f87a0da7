"""SQL fragments: expressions and the derived views as common table expressions."""

from __future__ import annotations

from gradeflow.functions.text import PUNCTUATION, WS
from gradeflow.plans.views import CUT_DAY


def with_views(*views: str, then: str) -> str:
    return "with " + ",\n".join(views) + "\n" + then


# expressions

def words(x: str) -> str:
    return f"list_filter(string_split_regex(coalesce({x}, ''), '{WS}+'), lambda w: w <> '')"


def strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^{WS}+|{WS}+$', '', 'g')"


def norm(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '{PUNCTUATION}', '', 'g'), "
            f"'{WS}+', ' ', 'g'))")


def norm_words(x: str) -> str:
    return f"list_filter(string_split({norm(x)}, ' '), lambda w: w <> '')"


def ascii_words(x: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({x}, '')), '[^a-z0-9]+'), lambda w: w <> '')"


def grams(tokens: str, n: int) -> str:
    return (f"list_transform(range(1, greatest(len({tokens}) - {n - 1} + 1, 1)), "
            f"lambda i: array_to_string(list_slice({tokens}, i, i + {n - 1}), ' '))")


def r6(x: str) -> str:
    return f"round(({x}) * 1e6) / 1e6"


def hits(x: str, topic: str) -> str:
    return "(" + " + ".join(f"cast(contains(lower(coalesce({x}, '')), '{w}') as int)" for w in topic.split()) + ")"


# views

TRUTH = """truth as (select o_orderkey id, substr('ABCD', 1 + (o_custkey % 4), 1) answer_idx,
  nullif(o_orderpriority, '4-NOT SPECIFIED') meta_info from orders)"""


def submission(letter_from: str = "l_partkey", name: str = "submission") -> str:
    return f"""{name} as (select case when l_quantity = 50 then -1 - l_orderkey else l_orderkey end id,
  case when l_tax = 0 and l_discount = 0 then null else substr(' aBCDE', 1 + ({letter_from} % 6), 1) end predicted_idx,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice from lineitem)"""


def graded(sub: str = "submission", name: str = "graded") -> str:
    return f"""first_{name} as (select id, p from (select id, coalesce(upper(trim(predicted_idx)), 'NAN') p,
    row_number() over (partition by id order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) rn
    from {sub}) where rn = 1),
{name} as (select *, predicted_idx = answer_idx correct from (select t.id, t.answer_idx, t.meta_info,
  case when f.p in ('A', 'B', 'C', 'D') then f.p else '' end predicted_idx
  from truth t left join first_{name} f on t.id = f.id))"""


GRADED = [TRUTH, submission(), graded()]

PAIRS = """pairs as (
  select conv_id * 2 pair_id, arg_max(text, turn) filter (role = 'user') instruction,
    coalesce(arg_max(text, turn) filter (role = 'system'), '') input,
    arg_max(text, turn) filter (role = 'assistant') output from conversations group by conv_id
  union all
  select doc_id * 2 + 1, case when n_chars > 8000 then null else concat('Write in ', lang, ' for ', source) end, '',
    case when n_chars < 100 then ' ' else text end from documents)"""


def split(source: str, key: str, rows: str, name: str = "splits") -> str:
    return f"""{name} as (select * exclude (rn, total), case when rn <= {rows} then 'eval' else 'train' end split from (
  select *, row_number() over (order by md5(concat('42:', {key})), cast({key} as varchar)) rn,
    count(*) over () total from {source}))"""


TENTH = "greatest(1, cast(floor(total * 0.1) as bigint))"
SPLITS = [PAIRS, split("pairs", "pair_id", TENTH)]

TEXT_PAIRS = """text_pairs as (select * from (select conv_id id, arg_max(text, turn) filter (role = 'assistant') prediction,
  arg_max(text, turn) filter (role = 'user') reference from conversations group by conv_id)
  where prediction is not null and reference is not null)"""

PREFERENCES = """preferences as (select conv_id,
  max(text) filter (role = 'user' and up = 1) prompt,
  max(text) filter (role = 'assistant' and longest = 1) chosen,
  max(text) filter (role = 'assistant' and shortest = 1) rejected
  from (select *, row_number() over (partition by conv_id, role order by turn) up,
    row_number() over (partition by conv_id, role order by length(text) desc, turn) longest,
    row_number() over (partition by conv_id, role order by length(text), turn) shortest from conversations)
  group by conv_id)"""

SERIES = """series as (select user_id run, event_type metric, value, epoch_us(ts) ts, event_id seq from events)"""
STEPS = """steps as (select *, row_number() over (partition by run order by ts, seq) step,
  (ts - min(ts) over (partition by run)) / 1e6 elapsed_seconds from series)"""

STAGE_EVENTS = """stage_events as (select user_id as version, case event_type when 'signup' then 'registered'
  when 'view' then 'evaluated' when 'click' then 'staged' when 'purchase' then 'production'
  when 'error' then 'retired' end stage, epoch_us(ts) ts, event_id seq from events)"""

STATE = [STAGE_EVENTS, """chain as (select version, ts, seq, lead(version) over w next_version, lead(ts) over w next_ts,
  lead(seq) over w next_seq from stage_events where stage = 'production' window w as (order by ts, seq)),
implied as (select version, 'retired' stage, next_ts ts, next_seq seq from chain where next_version <> version),
effective as (select version, stage, ts, seq from stage_events union all select * from implied),
current as (select arg_max(version, (ts, seq)) version from stage_events where stage = 'production'),
state as (select e.version, e.stage, e.ts changed_at, e.version = (select version from current) is_current from (
  select *, row_number() over (partition by version order by ts desc, seq desc) rn from effective) e where rn = 1)"""]

ENTRIES = """entries as (select * exclude (rn) from (select user_id as version,
  concat('ds-v0.1.0-area-', user_id % 10) dataset, concat('area_', user_id % 10) weakness_targeted,
  case when value < 10 then '{}' else props end training_metrics, epoch_us(ts) ts, event_id seq,
  row_number() over (partition by user_id order by ts desc, event_id desc) rn
  from events where event_type = 'signup') where rn = 1)"""

METRICS = f"""baseline as (select user_id as version, event_type metric,
  sum(cast(round(value * 100) as bigint)) / count(*) / 100 as value from events where ts < timestamp '{CUT_DAY}' group by all),
candidate as (select user_id as version, event_type metric,
  sum(cast(round(value * 100) as bigint)) / count(*) / 100 as value from events where ts >= timestamp '{CUT_DAY}' group by all),
joined as (select version, metric, coalesce(b.value, 0) baseline, coalesce(c.value, 0) candidate,
  case when b.value is null then 'baseline' when c.value is null then 'candidate' end missing_side
  from baseline b full join candidate c using (version, metric)),
compared as (select *, case when delta_pct > 0.005 then 'improved' when delta_pct < -0.005 then 'regressed'
  else 'neutral' end status from (select *, case when baseline = 0 then candidate else candidate - baseline end delta,
  case when baseline <> 0 then round((candidate - baseline) / abs(baseline) * 10000) / 10000 end delta_pct from joined))"""


def tenth_label(fraction: str) -> str:
    points = f"abs(cast(round({fraction} * 10000) as bigint))"
    return f"concat(cast(({points} + 5) // 10 // 10 as varchar), '.', cast(({points} + 5) // 10 % 10 as varchar), '%')"


def percent(fraction: str) -> str:
    return f"concat(case when round({fraction} * 10000) < 0 then '-' else '' end, {tenth_label(fraction)})"


def verdict(target: str = "view") -> str:
    return f"""verdict as (select version, case when hard > 0 then 'REJECT' when soft > 0 or short then 'NEEDS_REVIEW'
  else 'APPROVE' end recommendation,
  case when hard = 0 and soft = 0 and not short then 'All metrics within acceptable range' else
    concat_ws(' | ', case when hard > 0 then hard_text else soft_text end, case when short then
      concat('Target weakness ''{target}'' improvement (', {percent('best')}, ') below minimum (3%)') end) end reasons
  from (select *, coalesce(best < 0.03, false) short from (select version,
    count(*) filter (delta_pct < -0.02) hard, count(*) filter (delta_pct >= -0.02 and delta_pct < -0.005) soft,
    max(coalesce(delta_pct, 0)) filter (contains(lower(metric), '{target}')) best,
    string_agg(concat('Hard regression on ', metric, ': ', {percent('delta_pct')}), ' | ' order by metric)
      filter (delta_pct < -0.02) hard_text,
    string_agg(concat('Soft regression on ', metric, ': ', {percent('delta_pct')}), ' | ' order by metric)
      filter (delta_pct >= -0.02 and delta_pct < -0.005) soft_text
    from compared group by version)))"""


LOG_LINES = """log_lines as (select user_id run, event_id seq, case
  when event_id % 13 = 0 then '   '
  when event_type = 'view' then concat('__PROGRESS__:{"step": ', event_id, ', "epoch": ', value, ', "',
    case when event_id % 5 = 0 then 'train_loss' else 'loss' end, '": ', value, ', "elapsed_seconds": ', value, fin,
    case when event_id % 17 = 0 then ' __PROGRESS__:{"step": 1}' else '' end)
  when event_type = 'purchase' then concat('__FINAL_METRICS__:{"f1": ', value, fin)
  when event_type = 'signup' and value >= 50 then '  done __TRAINING_COMPLETE__'
  when event_type = 'signup' then concat('__BASELINE_METRICS__:{"f1": ', value, fin)
  when event_type = 'click' then concat('__EVAL_METRICS__:{"f1": ', value, fin)
  else concat('plain text ', props) end line
  from (select *, case when event_id % 11 = 0 then '' else '}' end fin from events)),
marked as (select run, seq, trim(line) line, case when contains(line, '__PROGRESS__:') then 'progress'
  when contains(line, '__FINAL_METRICS__:') then 'final_metrics' when contains(line, '__TRAINING_COMPLETE__') then 'complete'
  when contains(line, '__BASELINE_METRICS__:') then 'baseline' else 'log' end marker from log_lines where trim(line) <> ''),
parsed as (select * from (select *, case marker when 'progress' then split_part(line, '__PROGRESS__:', 2)
  when 'final_metrics' then split_part(line, '__FINAL_METRICS__:', 2)
  when 'baseline' then split_part(line, '__BASELINE_METRICS__:', 2) end payload from marked)
  where marker in ('log', 'complete') or json_valid(payload))"""

QUALITY = f"""quality as (select *, 0.4 * correctness + 0.3 * relevance + 0.15 * complexity + 0.15 * clarity quality_score
  from (select d.*, coalesce(cast(l.quality as double), 0.5) correctness,
    least(1.0::double, {hits("d.text", "the ration tion de")} / 3.0::double) relevance,
    least(1.0::double, len({words("d.text")}) / 500.0::double) complexity,
    case when length(d.text) > 0 then length(regexp_replace(d.text, '[^\\p{{L}}{WS[1:-1]}]', '', 'g')) / length(d.text)
      else 1.0::double end clarity from documents d left join labels l on d.doc_id = l.doc_id))"""

FIRSTS = "firsts as (select min(doc_id) doc_id from documents group by text)"


def contained() -> str:
    return f"""doc_norm as (select doc_id, concat(' ', {norm('text')}, ' ') t from documents),
item_norm as (select item_id, concat(' ', {norm('text')}, ' ') t from benchmark),
contained as (select doc_id, item_id from doc_norm d join item_norm i on contains(d.t, i.t) where trim(i.t) <> '')"""


def near() -> str:
    return f"""doc_words as (select doc_id, {norm_words('text')} ws from documents),
item_words as (select item_id, {norm_words('text')} ws from benchmark),
item_grams as (select item_id, len(gs) n_grams, unnest(gs) gram from (select item_id, list_distinct({grams('ws', 8)}) gs
  from item_words where len(ws) >= 8)),
doc_grams as (select distinct doc_id, unnest({grams('ws', 8)}) gram from doc_words where len(ws) >= 8),
near as (select doc_id, item_id, count(*) / max(n_grams) share from doc_grams join item_grams using (gram)
  group by doc_id, item_id having count(*) / max(n_grams) >= 0.5)"""


FLAGGED = [contained(), near(), "flagged as (select distinct doc_id from (select doc_id from contained union all select doc_id from near))"]
