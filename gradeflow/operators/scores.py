"""Scores of prediction/reference pairs. pairs: id (unique), prediction, reference."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.functions.pyhelpers import best_cosine, lcs
from gradeflow.functions.stems import stem_dictionary, stems_of
from gradeflow.functions.text import ascii_words, grams_of_orders, normalize_answer, normalized_words, strip, text_of, words


def pair_by_position(predictions: DataFrame, references: DataFrame, key: str = "id") -> DataFrame:
    """Pairs that exist on both sides; the position is an explicit key."""
    return predictions.join(references, key)


def ngram_overlap(
    pairs: DataFrame, tokens: Callable[[Column], Column], orders: Sequence[int] = (1,), key: str = "id",
    stem: bool = False, stems: Broadcast | None = None,
) -> DataFrame:
    """Per pair and order n: clipped matches and n-gram totals of both sides.

    Long form: n-grams are counted per (pair, gram), then the smaller count is summed.
    Counting starts inside the scan task, so repeats of a gram never travel.
    """
    prepared = pairs.select(
        F.col(key), tokens(F.col("prediction")).alias("_p"), tokens(F.col("reference")).alias("_r")
    )
    if stem:
        prepared = prepared.select(key, *[stems_of(c, stems).alias(c) for c in ("_p", "_r")])
    side = lambda c, p, r: grams_of_orders(c, orders, F.lit(p).alias("p"), F.lit(r).alias("r"))
    # one empty entry per order keeps pairs without any n-gram
    none = F.array(*[
        F.struct(F.lit(n).alias("n"), F.lit(None).cast("string").alias("gram"), F.lit(0).alias("p"), F.lit(0).alias("r"))
        for n in orders
    ])
    grams = prepared.select(key, F.inline(F.concat(side("_p", 1, 0), side("_r", 0, 1), none)))
    counted = grams.groupBy(key, "n", "gram").agg(F.sum("p").alias("p"), F.sum("r").alias("r"))
    return counted.groupBy(key, "n").agg(
        F.sum(F.least("p", "r")).alias("matches"), F.sum("p").alias("n_prediction"), F.sum("r").alias("n_reference")
    )


def f_measure(matches: Column, n_prediction: Column, n_reference: Column, both_empty: float = 0.0) -> Column:
    precision, recall = matches / n_prediction, matches / n_reference
    return (
        F.when((n_prediction == 0) & (n_reference == 0), both_empty).when(matches == 0, 0.0)
        .otherwise(2 * (precision * recall) / (precision + recall))
    )


def token_f1(pairs: DataFrame, key: str = "id") -> DataFrame:
    """Multiset F1 on normalised words; 1 if both sides are empty."""
    overlap = ngram_overlap(pairs, normalized_words, (1,), key)
    return overlap.select(
        key, f_measure(F.col("matches"), F.col("n_prediction"), F.col("n_reference"), 1.0).alias("f1")
    )


def common_tokens(prediction: Column | str, reference: Column | str) -> Column:
    """Distinct normalised words both sides share."""
    return F.array_intersect(normalized_words(prediction), normalized_words(reference))


def token_set_f1(prediction: Column | str, reference: Column | str) -> Column:
    """Set F1 on lower-case words with punctuation kept; 0 if either side is empty."""
    p = F.array_distinct(words(F.lower(text_of(prediction))))
    r = F.array_distinct(words(F.lower(text_of(reference))))
    return f_measure(F.size(F.array_intersect(p, r)), F.size(p), F.size(r))


def exact_match_norm(prediction: Column | str, reference: Column | str) -> Column:
    return (normalize_answer(prediction) == normalize_answer(reference)).cast("double")


def exact_match_plain(prediction: Column | str, reference: Column | str, variant: str = "compare") -> Column:
    """Lower-case trimmed equality. On an empty side ``compare`` still compares, ``zero`` gives 0."""
    p, r = F.lower(strip(prediction)), F.lower(strip(reference))
    same = (p == r).cast("double")
    if variant == "compare":
        return same
    if variant == "zero":
        return F.when((p == "") | (r == ""), 0.0).otherwise(same)
    raise ValueError(f"unknown variant {variant!r}")


def pair_stems(pairs: DataFrame) -> Broadcast | None:
    """The stem dictionary of both sides, for ``rouge_n`` and ``rouge_l``."""
    return stem_dictionary(pairs.select(*[ascii_words(c).alias(c) for c in ("prediction", "reference")]), "prediction", "reference")


def rouge_n(pairs: DataFrame, orders: Sequence[int] = (1, 2), key: str = "id", stem: bool = False,
            stems: Broadcast | None = None) -> DataFrame:
    """N-gram F-measure per pair: columns rouge1, rouge2, ... With ``stem``, words are looked up in ``stems``, if given."""
    overlap = ngram_overlap(pairs, ascii_words, orders, key, stem, stems)
    value = f_measure(F.col("matches"), F.col("n_prediction"), F.col("n_reference"))
    return overlap.groupBy(key).agg(*[
        F.max(F.when(F.col("n") == n, value)).alias(f"rouge{n}") for n in orders
    ])


def rouge_l(pairs: DataFrame, key: str = "id", stem: bool = False, stems: Broadcast | None = None) -> DataFrame:
    """F-measure on the longest common subsequence of whole texts; one row in, one row out."""
    toks = pairs.select(key, ascii_words("prediction").alias("_p"), ascii_words("reference").alias("_r"))
    if stem:
        toks = toks.select(key, *[stems_of(c, stems).alias(c) for c in ("_p", "_r")])
    measured = toks.select(key, lcs("_p", "_r").alias("_l"), F.size("_p").alias("_np"), F.size("_r").alias("_nr"))
    return measured.select(key, f_measure(F.col("_l"), F.col("_np"), F.col("_nr")).alias("rougeL"))


def bleu_counts(pairs: DataFrame, key: str = "id") -> DataFrame:
    """Per pair and n = 1..4: clipped matches, candidate n-grams; lengths are the n = 1 totals."""
    return ngram_overlap(pairs, words, (1, 2, 3, 4), key)


def corpus_bleu(counts: DataFrame, epsilon: float = 0.1) -> DataFrame:
    """Corpus score with one reference; a zero match count is replaced by ``epsilon``.

    Each pair counts at least one candidate n-gram per order, however short it is; the
    brevity penalty takes the plain lengths.
    """
    figures = {"matches": F.col("matches"), "n_prediction": F.col("n_prediction"), "n_reference": F.col("n_reference"),
               "n_grams": F.greatest("n_prediction", F.lit(1))}
    sums = counts.agg(*[
        F.coalesce(F.sum(F.when(F.col("n") == n, c)), F.lit(0)).cast("double").alias(f"{name}_{n}")
        for n in (1, 2, 3, 4) for name, c in figures.items()
    ])
    log_mean = F.lit(0.0)
    for n in (1, 2, 3, 4):
        m, total = F.col(f"matches_{n}"), F.greatest(F.col(f"n_grams_{n}"), F.lit(1.0))
        log_mean = log_mean + 0.25 * F.ln(F.when(m == 0, F.lit(epsilon)).otherwise(m) / total)
    cand, ref = F.col("n_prediction_1"), F.col("n_reference_1")
    brevity = F.when(cand > ref, 1.0).when(cand == 0, 0.0).otherwise(F.exp(1 - ref / F.when(cand > 0, cand)))
    return sums.select(
        F.when(F.col("matches_1") == 0, 0.0).otherwise(brevity * F.exp(log_mean)).alias("bleu")
    )


def long_metrics(row: DataFrame) -> DataFrame:
    """One row of metric columns -> rows (metric, value)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns])
    return row.select(F.inline(pairs))


def _mean_or_zero(c: str) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0)).alias(c)


def qa_f1_em_mean(pairs: DataFrame, key: str = "id") -> DataFrame:
    exact = pairs.select(key, exact_match_norm("prediction", "reference").alias("exact_match"))
    return token_f1(pairs, key).join(exact, key).agg(_mean_or_zero("f1"), _mean_or_zero("exact_match"))


def rouge_mean(pairs: DataFrame, key: str = "id", stem: bool = True) -> DataFrame:
    stems = pair_stems(pairs) if stem else None
    both = rouge_n(pairs, (1, 2), key, stem, stems).join(rouge_l(pairs, key, stem, stems), key)
    return both.agg(*[F.avg(c).alias(c) for c in ("rouge1", "rouge2", "rougeL")])


def all_qa_metrics(pairs: DataFrame, key: str = "id", stem: bool = True,
                   vectors: DataFrame | None = None) -> DataFrame:
    """Every metric as (metric, value); vector matching only if vectors are supplied."""
    result = long_metrics(qa_f1_em_mean(pairs, key)).unionByName(
        long_metrics(rouge_mean(pairs, key, stem))
    ).unionByName(long_metrics(corpus_bleu(bleu_counts(pairs, key))))
    if vectors is not None:
        matched = greedy_vector_match(vectors).agg(*[
            F.avg(c).alias(f"bertscore_{c}") for c in ("precision", "recall", "f1")
        ])
        result = result.unionByName(long_metrics(matched))
    return result


def greedy_vector_match(pairs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Columns prediction_vectors, reference_vectors (arrays of vectors, one per token)."""
    return pairs.select(*keep, best_cosine("prediction_vectors", "reference_vectors").alias("_m")).select(
        *keep, "_m.precision", "_m.recall", "_m.f1"
    )


# --- named metric functions, open for registration ---

METRICS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "f1": lambda pairs: qa_f1_em_mean(pairs).select("f1"),
    "exact_match": lambda pairs: pairs.agg(F.avg(exact_match_norm("prediction", "reference")).alias("exact_match")),
    "token_set_f1": lambda pairs: pairs.agg(F.avg(token_set_f1("prediction", "reference")).alias("token_set_f1")),
    "bleu": lambda pairs: corpus_bleu(bleu_counts(pairs)),
}


def metric_hook(pairs: DataFrame, *names: str, extra: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Named metrics as (metric, value); ``extra`` adds or replaces metric functions."""
    known = {**METRICS, **(extra or {})}
    result = None
    for name in names or tuple(known):
        rows = long_metrics(known[name](pairs))
        result = rows if result is None else result.unionByName(rows)
    return result


def length_reward(text: Column | str) -> Column:
    """Placeholder reward: characters / 100, at most 1."""
    return F.least(F.length(text_of(text)) / 100.0, F.lit(1.0))


def reward_mean(rewards: DataFrame, by: str = "batch") -> DataFrame:
    return rewards.groupBy(by).agg(F.avg("reward").alias("reward_mean"))
