"""Prompt layouts and naming rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeflow.functions.text import col, text_of

# The three-slot instruction layout.
INSTRUCTION_TEMPLATE = (
    "### Instruction:\n{instruction}\n\n### Input:\n{input}\n\n### Response:\n{output}"
)

# Section headings per chat role; other roles are dropped.
CHAT_HEADINGS = {"system": "### System:\n", "user": "### User:\n", "assistant": "### Assistant:\n"}

# Model family substring -> chat markup, first hit wins. "tinyllama" can
# never be reached because "llama" is listed before it.
CHAT_TEMPLATES = [
    ("qwen", "chatml"),
    ("llama", "llama-3"),
    ("phi", "phi-3"),
    ("mistral", "mistral"),
    ("tinyllama", "chatml"),
    ("gemma", "gemma"),
    ("deepseek", "chatml"),
    ("yi", "chatml"),
]

# Wording of the multiple-choice prompt.
CHOICE_PROMPT = (
    "You are a medical expert answering a USMLE-style question. "
    "Read the clinical vignette and choose the single best answer.\n\n"
    "Question: {question}\n\n"
    "Options:\n{options}\n\n"
    "Answer with only the letter (A, B, C, or D). Answer:"
)


def fill_template(template: str, **slots: Column) -> Column:
    """Literal template with ``{name}`` slots. Values are never scanned for slots."""
    parts: list[Column] = []
    rest = template
    while rest:
        hits = sorted((rest.find("{%s}" % s), s) for s in slots if "{%s}" % s in rest)
        if not hits:
            parts.append(F.lit(rest))
            break
        at, slot = hits[0]
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(slots[slot])
        rest = rest[at + len(slot) + 2 :]
    return F.concat(*parts)


def instruction_prompt(
    instruction: Column | str, input_: Column | str, output: Column | str,
    template: str = INSTRUCTION_TEMPLATE,
) -> Column:
    return fill_template(
        template, instruction=text_of(instruction), input=text_of(input_), output=text_of(output)
    )


def chat_sections(messages: Column | str) -> Column:
    """``messages`` array<struct<role, content>> -> headed sections joined by a blank line."""
    sections = F.transform(
        col(messages),
        lambda m: F.concat(_heading(F.coalesce(m["role"], F.lit("user"))), text_of(m["content"])),
    )
    return F.array_join(F.filter(sections, lambda s: s.isNotNull()), "\n\n")


def _heading(role: Column) -> Column:
    chain = F.lit(None).cast("string")
    for name, heading in reversed(CHAT_HEADINGS.items()):
        chain = F.when(role == name, F.lit(heading)).otherwise(chain)
    return chain


def user_message(instruction: Column | str, input_: Column | str) -> Column:
    """Instruction with a non-empty input appended as context."""
    return F.concat(
        text_of(instruction),
        F.when(text_of(input_) != "", F.concat(F.lit("\n\nContext: "), text_of(input_))).otherwise(""),
    )


def chatml_turn(role: Column | str, content: Column | str) -> Column:
    return F.concat(
        F.lit("<|im_start|>"), text_of(role), F.lit("\n"), text_of(content), F.lit("<|im_end|>\n")
    )


def chatml(messages: Column | str) -> Column:
    return F.array_join(
        F.transform(col(messages), lambda m: chatml_turn(m["role"], m["content"])), ""
    )


def chat_template_for(model_name: Column | str) -> Column:
    lowered = F.lower(text_of(model_name))
    chain = F.lit("chatml")
    for family, template in reversed(CHAT_TEMPLATES):
        chain = F.when(F.contains(lowered, F.lit(family)), F.lit(template)).otherwise(chain)
    return chain


def qa_prompt(instruction: Column | str, input_: Column | str) -> Column:
    question = F.concat(F.lit("Question: "), text_of(instruction), F.lit("\n\nAnswer:"))
    context = F.concat(F.lit("Context: "), text_of(input_), F.lit("\n\n"))
    return F.when(text_of(input_) != "", F.concat(context, question)).otherwise(question)


def choice_prompt(question: Column | str, options: Column | str) -> Column:
    """``options`` is a map letter -> text; lines are sorted by letter."""
    entries = F.array_sort(F.map_entries(col(options)))
    lines = F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"], F.lit(". "), e["value"])), "\n"
    )
    return fill_template(CHOICE_PROMPT, question=text_of(question), options=lines)


def extract_choice(c: Column | str) -> Column:
    """First standalone A-D, else the first A-D character, else A."""
    upper = F.upper(text_of(c))
    alone = F.nullif(F.regexp_extract(upper, r"(?U)\b([A-D])\b", 1), F.lit(""))
    anywhere = F.nullif(F.regexp_extract(upper, "([A-D])", 1), F.lit(""))
    return F.coalesce(alone, anywhere, F.lit("A"))


def version_tag(weakness: Column | str) -> Column:
    return F.concat(F.lit("v0.1.0-"), F.replace(text_of(weakness), F.lit("_"), F.lit("-")))


def dataset_tag(weakness: Column | str) -> Column:
    return F.concat(F.lit("ds-"), version_tag(weakness))
