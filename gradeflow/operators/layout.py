"""Layout detection and conversion to instruction pairs and training text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.functions import prompts
from gradeflow.functions.subwords import subword_ids
from gradeflow.functions.text import col, text_of, words

# Layouts in order of priority, with the columns that identify them.
LAYOUTS = [
    ("alpaca", ("instruction", "output")),
    ("openai", ("prompt", "completion")),
    ("chat", ("messages",)),
    ("gsm8k", ("question", "answer")),
    ("qa", ("question", "response")),
]
PAIR = ("instruction", "input", "output")


def detect_layout(columns: Sequence[str]) -> str:
    """Decided from column names alone; "unknown" converts to nothing."""
    for name, needed in LAYOUTS:
        if set(needed) <= set(columns):
            return name
    return "unknown"


def drop_empty_pairs(df: DataFrame) -> DataFrame:
    """Keep pairs with an instruction and an output; white space counts as content."""
    return df.where((text_of("instruction") != "") & (text_of("output") != ""))


def to_alpaca(df: DataFrame, keep: Sequence[str] = (), layout: str | None = None) -> DataFrame:
    """Instruction pairs from any known layout, which may be forced by name."""
    layout = layout or detect_layout(df.columns)
    if layout == "chat":
        pair = chat_pair("messages")
        shaped = df.select(*keep, pair["user"].alias("instruction"), F.lit("").alias("input"),
                           pair["assistant"].alias("output"))
    elif layout == "unknown":
        shaped = df.select(*keep, *[F.lit("").alias(c) for c in PAIR]).where(F.lit(False))
    else:
        source, target = dict(LAYOUTS)[layout]
        extra = text_of("input") if layout == "alpaca" and "input" in df.columns else F.lit("")
        shaped = df.select(*keep, text_of(source).alias("instruction"), extra.alias("input"),
                           text_of(target).alias("output"))
    return drop_empty_pairs(shaped)


def chat_pair(messages: Column | str) -> dict[str, Column]:
    """Last user and last assistant content of a nested conversation, whatever their order."""
    def last(role: str) -> Column:
        said = F.filter(col(messages), lambda m: m["role"] == role)
        return text_of(F.try_element_at(said, F.lit(-1))["content"])

    return {"user": last("user"), "assistant": last("assistant")}


def nest_turns(turns: DataFrame) -> DataFrame:
    """Long form (conv_id, turn, role, text) -> one row with ``messages`` in turn order."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy("conv_id").agg(
        F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
        .alias("messages")
    )


def last_by_role(turns: DataFrame, *roles: str) -> DataFrame:
    """Last text per role and conversation, straight from the long form.

    Partial aggregates keep one text per role, so a conversation of any length is never
    assembled in memory.
    """
    return turns.groupBy("conv_id").agg(*[
        F.max_by("text", F.when(F.col("role") == r, F.col("turn"))).alias(r) for r in roles
    ])


def chat_to_alpaca(turns: DataFrame) -> DataFrame:
    last = last_by_role(turns, "user", "assistant")
    return drop_empty_pairs(last.select(
        "conv_id", text_of("user").alias("instruction"), F.lit("").alias("input"),
        text_of("assistant").alias("output"),
    ))


def render_prompt(df: DataFrame, keep: Sequence[str] = (),
                  template: str = prompts.INSTRUCTION_TEMPLATE) -> DataFrame:
    """One ``text`` per row. The layout priority here differs from ``detect_layout``."""
    have = set(df.columns)
    if "instruction" in have:
        slots = [c if c in have else F.lit("") for c in PAIR]
        text = prompts.instruction_prompt(*slots, template=template)
    elif "text" in have:
        text = text_of("text")
    elif {"prompt", "completion"} <= have:
        text = F.concat(text_of("prompt"), text_of("completion"))
    elif "messages" in have:
        text = prompts.chat_sections("messages")
    else:
        raise ValueError(f"no known layout in columns {df.columns}")
    return df.select(*keep, text.alias("text"))


def render_chat_sections(turns: DataFrame) -> DataFrame:
    return nest_turns(turns).select("conv_id", prompts.chat_sections("messages").alias("text"))


def format_training_text(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Rows -> chat markup by layout; unknown layouts join all string columns with a blank."""
    have = set(df.columns)
    if {"instruction", "output"} <= have:
        user = prompts.user_message("instruction", "input" if "input" in have else F.lit(""))
        text = _exchange(user, "output")
    elif "messages" in have:
        text = prompts.chatml("messages")
    elif {"prompt", "completion"} <= have:
        text = _exchange("prompt", "completion")
    elif {"question", "answer"} <= have:
        text = _exchange("question", "answer")
    elif "text" in have:
        text = text_of("text")
    else:
        strings = [c for c, kind in df.dtypes if kind == "string" and c not in keep]
        text = F.concat_ws(" ", *strings)
    return df.select(*keep, text.alias("text"))


def _exchange(user: Column | str, assistant: Column | str) -> Column:
    return F.concat(prompts.chatml_turn(F.lit("user"), user), prompts.chatml_turn(F.lit("assistant"), assistant))


def preference_pairs(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    needed = ["prompt", "chosen", "rejected"]
    if not set(needed) <= set(df.columns):
        raise ValueError(f"preference data needs columns {needed}, found {df.columns}")
    return df.select(*keep, *needed)


def rl_queries(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Column ``query``, taken from query, else prompt, else text."""
    for source in ("query", "prompt", "text"):
        if source in df.columns:
            return df.select(*keep, F.col(source).alias("query"))
    raise ValueError(f"need one of query, prompt, text; found {df.columns}")


def tokenize_pad(df: DataFrame, text: str, max_length: int, keep: Sequence[str] = (),
                 vocabulary: int = 50_000, pad_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """Ids cut and right-padded to ``max_length``, with mask and labels.

    ``tokenizer`` is a file of the tokenizers library (a path, or the name of an installed public one), whose ids are
    cut after encoding. Without it, the ids are hashes of the first ``max_length`` words. Labels are the ids with
    every pad id set to -100, also where a real token has that id.
    """
    if tokenizer:
        ids = F.slice(subword_ids(tokenizer)(text_of(text)), 1, max_length)
    else:
        ids = F.transform(
            F.slice(words(text), 1, max_length),
            lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % vocabulary + 1).cast("int"),
        )
    return pad_ids(df.select(*keep, ids.alias("_ids")), "_ids", max_length, pad_id, keep)


def pad_ids(df: DataFrame, ids: str, max_length: int, pad_id: int, keep: Sequence[str] = ()) -> DataFrame:
    n = F.size(ids)
    padded = df.select(
        *keep,
        F.concat(F.col(ids), F.array_repeat(F.lit(pad_id), F.lit(max_length) - n)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_length) - n)).alias("attention_mask"),
    )
    return padded.withColumn(
        "labels", F.transform("input_ids", lambda t: F.when(t == pad_id, F.lit(-100)).otherwise(t))
    )
