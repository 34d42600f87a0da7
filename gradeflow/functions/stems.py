"""Word stems as column expressions.

M. F. Porter, "An algorithm for suffix stripping" (1980), and the extended rules that the
usual n-gram recall scorers apply by default: irregular forms, short words in -ies and
-ied, -y after a consonant, -bli, -fulli and -logi. A word is a text of a-z and 0-9.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeflow.session import materialize

# Suffix -> replacement, by step; the extended rules replace abli by the three last entries.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP2_PLAIN = {"abli": "able"}
STEP2_EXTENDED = {"bli": "ble", "fulli": "ful", "logi": "log"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
         "ous", "ive", "ize"]
# Irregular forms of the extended rules.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}
#: Words up to this length stay as they are.
SHORT = 3
#: Runs of the letter y are read as vowels and consonants in turn, this many pairs at most.
Y_PAIRS = 3


def _let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(x), body), 1)


def _drop(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.greatest(F.length(w) - n, F.lit(0)))


def shape(w: Column) -> Column:
    """Each letter as C or V; y is a vowel after a consonant."""
    out = F.regexp_replace(F.translate(w, "aeiou", "VVVVV"), "[^Vy]", "C")
    out = F.regexp_replace(out, "^y", "C")
    for _ in range(Y_PAIRS):
        out = F.replace(F.replace(out, F.lit("Cy"), F.lit("CV")), F.lit("Vy"), F.lit("VC"))
    return out


def _some(s: Column) -> Column:
    return s.rlike("^C*V+C")


def _more(s: Column) -> Column:
    return s.rlike("^C*V+C+V+C")


def _one(s: Column) -> Column:
    return s.rlike("^C*V+C+V*$")


def _cvc(w: Column, s: Column, extended: bool) -> Column:
    usual = s.rlike("CVC$") & ~w.rlike("[wxy]$")
    return usual | (s == "VC") if extended else usual


def _step1a(w: Column, extended: bool) -> Column:
    ies = F.when(F.length(w) == 4, _drop(w, 1)).otherwise(_drop(w, 2)) if extended else _drop(w, 2)
    return (
        F.when(w.endswith("sses"), _drop(w, 2)).when(w.endswith("ies"), ies).when(w.endswith("ss"), w)
        .when(w.endswith("s"), _drop(w, 1)).otherwise(w)
    )


def _mended(w: Column, extended: bool) -> Column:
    """The stem after -ed or -ing: hop(p), fil(e), conflat(e)."""
    def by_shape(s: Column) -> Column:
        # doubled letters: the last character and the one before it
        double = (F.right(w, F.lit(1)) == F.left(F.right(w, F.lit(2)), F.lit(1))) & (F.length(w) > 1) & s.endswith("C")
        return (
            F.when(w.rlike("(at|bl|iz)$"), F.concat(w, F.lit("e")))
            .when(double, F.when(w.rlike("[lsz]$"), w).otherwise(_drop(w, 1)))
            .when(_one(s) & _cvc(w, s, extended), F.concat(w, F.lit("e"))).otherwise(w)
        )

    return _let(shape(w), by_shape)


def _step1b(w: Column, extended: bool) -> Column:
    def cut(n: int) -> Column:
        return _let(_drop(w, n), lambda x: F.when(F.contains(shape(x), F.lit("V")), _mended(x, extended)).otherwise(w))

    rest = (
        F.when(w.endswith("eed"), F.when(_some(shape(_drop(w, 3))), _drop(w, 1)).otherwise(w))
        .when(w.endswith("ed"), cut(2)).when(w.endswith("ing"), cut(3)).otherwise(w)
    )
    if not extended:
        return rest
    return F.when(w.endswith("ied"), F.when(F.length(w) == 4, _drop(w, 1)).otherwise(_drop(w, 2))).otherwise(rest)


def _step1c(w: Column, extended: bool) -> Column:
    s = shape(_drop(w, 1))
    fits = (F.length(w) > 2) & s.endswith("C") if extended else F.contains(s, F.lit("V"))
    return F.when(w.endswith("y") & fits, F.concat(_drop(w, 1), F.lit("i"))).otherwise(w)


def _replaced(w: Column, table: dict[str, str], fits: Callable[[Column, Column], Column]) -> Column:
    """The longest suffix of the table replaced if ``fits(stem, suffix)``."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])

    def by_suffix(suffix: Column) -> Column:
        stem = F.substring(w, F.lit(1), F.length(w) - F.length(suffix))
        return F.when((suffix != "") & _let(stem, lambda x: fits(x, suffix)), F.concat(stem, F.try_element_at(pairs, suffix))).otherwise(w)

    return _let(F.regexp_extract(w, f"({'|'.join(table)})$", 1), by_suffix)


def _step2(w: Column, extended: bool) -> Column:
    if not extended:
        return _replaced(w, STEP2 | STEP2_PLAIN, lambda x, _: _some(shape(x)))
    # -logi is measured with its l
    fits = lambda x, suffix: _some(shape(F.when(suffix == "logi", F.concat(x, F.lit("l"))).otherwise(x)))
    first = F.when(w.endswith("alli") & _some(shape(_drop(w, 4))), _drop(w, 2)).otherwise(w)
    return _let(first, lambda x: _replaced(x, STEP2 | STEP2_EXTENDED, fits))


def _step3(w: Column, extended: bool) -> Column:
    return _replaced(w, STEP3, lambda x, _: _some(shape(x)))


def _step4(w: Column, extended: bool) -> Column:
    fits = lambda x, suffix: _more(shape(x)) & ((suffix != "ion") | x.rlike("[st]$"))
    return _replaced(w, dict.fromkeys(STEP4, ""), fits)


def _step5a(w: Column, extended: bool) -> Column:
    def by_stem(x: Column) -> Column:
        return _let(shape(x), lambda s: F.when(_more(s) | (_one(s) & ~_cvc(x, s, extended)), x).otherwise(w))

    return F.when(w.endswith("e"), _let(_drop(w, 1), by_stem)).otherwise(w)


def _step5b(w: Column, extended: bool) -> Column:
    return F.when(w.endswith("ll") & _more(shape(_drop(w, 1))), _drop(w, 1)).otherwise(w)


STEPS = (_step1a, _step1b, _step1c, _step2, _step3, _step4, _step5a, _step5b)


def stem_words(tokens: Column | str, extended: bool = True) -> Column:
    """Stems of an array of words longer than three letters; shorter ones stay."""
    words = F.col(tokens) if isinstance(tokens, str) else tokens
    irregular = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    # a word and its stem so far; the word decides whether the rules apply
    pairs = F.transform(words, lambda w: F.struct(w.alias("word"), w.alias("stem")))

    def after(step: Callable[[Column, bool], Column]) -> Callable[[Column], Column]:
        return lambda p: F.struct(p["word"].alias("word"), step(p["stem"], extended).alias("stem"))

    for step in STEPS:
        pairs = F.transform(pairs, after(step))

    def chosen(p: Column) -> Column:
        known = F.try_element_at(irregular, p["word"]) if extended else F.lit(None).cast("string")
        return F.when(F.length(p["word"]) <= SHORT, p["word"]).otherwise(F.coalesce(known, p["stem"]))

    return F.transform(pairs, chosen)


#: Words with a stem of their own that are sent to the tasks; beyond it, words are stemmed where they stand.
DICTIONARY_WORDS = 2_000_000


@cache
def _stem_of_word(application: str, extended: bool) -> Column:
    """The stem of column ``word``; building the expression takes longer than a large vocabulary, so a session builds it once."""
    return F.element_at(stem_words(F.array("word"), extended), 1)


def stem_dictionary(tokens: DataFrame, *columns: str, extended: bool = True) -> Broadcast | None:
    """(words, stems) of the different words of some array columns that have another stem; null if they are too many.

    Each word is stemmed once, however often it occurs.
    """
    every = tokens.select(F.explode(F.array_distinct(F.concat(*columns))).alias("word")).where(F.length("word") > SHORT).distinct()
    # few bytes, much work: a fixed number of parts, which is not merged
    spark = tokens.sparkSession
    every = every.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "word")
    stems = every.select("word", _stem_of_word(spark.sparkContext.applicationId, extended).alias("stem")).where("word <> stem")
    stored = materialize(stems, "stems")
    if stored.count() > DICTIONARY_WORDS:
        return None
    table = stored.toArrow()
    return spark.sparkContext.broadcast(tuple(table[c].combine_chunks().cast(pa.string()) for c in ("word", "stem")))


def stems_of(tokens: Column | str, dictionary: Broadcast | None) -> Column:
    """Stems of an array of words by the dictionary, or by the rules if there is none."""
    if dictionary is None:
        return stem_words(tokens)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def looked_up(lists: pa.Array) -> pa.Array:
        words, stems = dictionary.value
        flat = lists.flatten().cast(pa.string())
        found = pc.coalesce(stems.take(pc.index_in(flat, words)), flat)
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        ends = pa.array([0, *lengths.cumsum()], pa.int32())
        return pa.ListArray.from_arrays(ends, found)

    return looked_up(tokens)
