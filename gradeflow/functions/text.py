"""Text expressions. All are built-in column expressions and stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.split() and str.strip() treat as white space.
WS = r"[\x09-\x0d\x1c-\x20\x85\p{Z}]"
# The 32 ASCII punctuation characters.
PUNCTUATION = r"[!-/:-@\[-`{-~]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_of(c: Column | str) -> Column:
    """Null and absent both read as the empty string."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def strip(c: Column | str) -> Column:
    return F.regexp_replace(text_of(c), f"^{WS}+|{WS}+$", "")


def is_blank(c: Column | str) -> Column:
    return ~text_of(c).rlike(f"[^{WS[1:]}")


def words(c: Column | str) -> Column:
    return F.filter(F.split(text_of(c), f"{WS}+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def normalize_answer(c: Column | str) -> Column:
    """Lower case, ASCII punctuation deleted, white space collapsed and trimmed."""
    bare = F.regexp_replace(F.lower(text_of(c)), PUNCTUATION, "")
    return F.trim(F.regexp_replace(bare, f"{WS}+", " "))


def normalized_words(c: Column | str) -> Column:
    return F.filter(F.split(normalize_answer(c), " "), lambda w: w != "")


def ascii_words(c: Column | str) -> Column:
    """Lower-case runs of a-z and 0-9, the usual tokens of n-gram recall scores."""
    return F.filter(F.split(F.lower(text_of(c)), "[^a-z0-9]+"), lambda w: w != "")


def ngrams(tokens: Column | str, n: int) -> Column:
    """Consecutive n-grams joined by one blank; shorter inputs give an empty array.

    ``tokens`` should be a materialised column, so it is not re-split per n-gram.
    """
    toks = col(tokens)
    if n == 1:
        return toks
    return F.when(
        F.size(toks) >= n,
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(toks) - (n - 1), F.lit(1))),
            lambda i: F.array_join(F.slice(toks, i, n), " "),
        ),
    ).otherwise(F.array().cast("array<string>"))


def grams_of_orders(tokens: Column | str, orders, *tags: Column) -> Column:
    """All n-grams of several orders in one array of structs (n, gram, tags...)."""
    def tagged(n: int) -> Column:
        return F.transform(ngrams(tokens, n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram"), *tags))

    return F.flatten(F.array(*[tagged(n) for n in orders]))


def keyword_hits(text: Column | str, topic: str) -> Column:
    """How many topic words occur as a substring; a repeated topic word counts each time."""
    lowered = F.lower(text_of(text))
    hits = [F.when(F.contains(lowered, F.lit(w)), 1).otherwise(0) for w in topic.lower().split()]
    total = F.lit(0)
    for hit in hits:
        total = total + hit
    return total


def seed_hash(key: Column | str, seed: int) -> Column:
    """Engine-neutral pseudo-random sort key: md5 of ``seed:key`` in hex."""
    return F.md5(F.concat(F.lit(f"{seed}:"), col(key).cast("string")))


def pair_hash(instruction: Column | str, output: Column | str) -> Column:
    return F.md5(F.concat(text_of(instruction), F.lit("|||"), text_of(output)))


def content_hash(c: Column | str) -> Column:
    """Hash of the normalised text, the key of exact contamination checks."""
    return F.md5(normalize_answer(c))


def is_json(c: Column | str) -> Column:
    """One JSON value and nothing after it; the parser reads all of it."""
    wrapped = F.concat(F.lit("["), col(c), F.lit(",0]"))
    return F.coalesce(F.json_array_length(wrapped) == 2, F.lit(False))
