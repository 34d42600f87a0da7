"""Toxicity by weak supervision.

Many voters look at a document: fixed insult lexicons, patterns, and words and word
beginnings mined from labelled documents. A generative label model holds the rate at which
each voter speaks up in toxic and in other documents; the given labels are one more voter,
which may err. Expectation maximisation estimates the rates; voters that repeat each other
beyond what the class explains are weighted down by their correlations. A linear
classifier is trained on the posterior labels and scores all documents.

Only the fit is bounded: about ``LABELLED`` labelled documents by a hash of their id. Its
counts and votes are made by Spark jobs, its result is a vector of weights.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.catalog import register
from gradeflow.session import materialize

#: Labelled documents of the fit, about.
LABELLED = 20_000
#: Mined voters, least toxic documents of one, and how much likelier it must be in toxic documents.
MINED, SUPPORT, LIFT = 300, 3, 10.0
#: Lengths of the word beginnings that can be voters.
STEMS = (4, 5, 6, 7)
#: So many different words of any word list make a voter of their own.
CROWDS = (1, 2, 3)
ROUNDS = 12
RIDGE = 0.3

# Insults of four languages.
LEXICONS = {
    "en": "idiot moron stupid loser scum trash clown pathetic worthless disgusting dumb imbecile bastard jerk fool filth vermin",
    "de": "idiot trottel dumm arsch arschloch hurensohn schlampe vollidiot abschaum wichser dreckskerl",
    "fr": "idiot imbécile crétin connard salope merde ordure abruti débile enculé",
    "es": "idiota imbécil estúpido mierda puta pendejo basura cabrón escoria gilipollas",
}
# Patterns; the first speaks of masked words, then insults, threats and shouting.
PATTERNS = {
    "masked": r"\b[a-z]+[*@#]{2,}[a-z]+\b",
    "you are": r"\byou(?: are|'re)(?: such)? an? (?:idiot|moron|loser|clown|fool|jerk|bastard)\b",
    "threat": r"\b(?:kill yourself|go die|shut up|hate you)\b",
    "marks": r"!{3,}",
}
WORD = re.compile(r"\w+")


@dataclass
class Voters:
    """All voters: a word or word beginning each, a lexicon each, a pattern each, a number of listed words each."""

    words: list[str] = field(default_factory=list)

    def __post_init__(self):
        self.index = {w: i for i, w in enumerate(self.words)}
        n = len(self.words)
        self.lexicons = [(n + i, frozenset(words.split())) for i, words in enumerate(LEXICONS.values())]
        n += len(LEXICONS)
        self.patterns = [(n + i, re.compile(p)) for i, p in enumerate(PATTERNS.values())]
        self.crowds = n + len(PATTERNS)
        self.size = self.crowds + len(CROWDS)
        self.insults = frozenset().union(*(lexicon for _, lexicon in self.lexicons))

    def votes(self, text: str) -> list[int]:
        """Numbers of the voters that speak up for the whole text."""
        text = text.lower()
        words = set(WORD.findall(text))
        out, listed = set(), 0
        for w in words:
            found = self._of(w)
            out.update(found)
            listed += bool(found) or w in self.insults
        out.update(self.crowds + i for i, least in enumerate(CROWDS) if listed >= least)
        out.update(i for i, lexicon in self.lexicons if not lexicon.isdisjoint(words))
        out.update(i for i, pattern in self.patterns if pattern.search(text))
        return sorted(out)

    def _of(self, word: str) -> list[int]:
        found = [self.index[word]] if word in self.index else []
        for k in STEMS:
            if len(word) > k and (stem := word[:k] + "*") in self.index:
                found.append(self.index[stem])
        return found


@dataclass
class Model:
    voters: Voters
    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        x = self.bias + float(self.weights[self.voters.votes(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


def held_out(key: str) -> Column:
    """Whether crc32 of the id as text is a multiple of five."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def _count_words(batches):
    """(word, documents with label 1, documents with label 0), summed within the task's batches."""
    for b in batches:
        toxic, other = Counter(), Counter()
        for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words = set(WORD.findall(text.lower()))
            words.update([w[:k] + "*" for w in words for k in STEMS if len(w) > k])
            (toxic if label else other).update(words)
        names = list(toxic.keys() | other.keys())
        yield pa.record_batch([
            pa.array(names, pa.string()), pa.array([toxic[w] for w in names], pa.int64()), pa.array([other[w] for w in names], pa.int64()),
        ], names=["word", "toxic", "other"])


def _vote(voters: Voters):
    def run(batches):
        for b in batches:
            votes = [voters.votes(t) for t in b.column(0).to_pylist()]
            yield pa.record_batch(
                [b.column(1), b.column(2), pa.array(votes, pa.list_(pa.int32()))], names=["label", "hash", "votes"])

    return run


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Posterior of label 1 for each row of a 0/1 matrix of votes; ``labels`` vote as well."""
    seen = np.column_stack((votes, labels)).astype(np.float64)
    posterior = np.where(labels > 0, 0.8, 0.05)
    weight = np.ones(seen.shape[1])
    for turn in range(rounds):
        mass = posterior.sum(), (1 - posterior).sum()
        rate1 = (posterior @ seen + 0.5) / (mass[0] + 1)
        rate0 = ((1 - posterior) @ seen + 0.5) / (mass[1] + 1)
        # voters speak up for label 1: one that does not is left undecided
        rate1 = np.maximum(rate1, rate0)
        if turn % 4 == 3:  # once the classes have settled
            weight = 1 / _repetition(seen, posterior, rate1, rate0)
            weight[-1] = 1.0
        speaks = weight * np.log(rate1 / rate0)
        silent = weight * np.log((1 - rate1) / (1 - rate0))
        odds = np.log(mass[0] / mass[1]) + seen @ (speaks - silent) + silent.sum()
        posterior = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
    return posterior


def _repetition(seen, posterior, rate1, rate0) -> np.ndarray:
    """1 + the sum of a voter's positive correlations with the others, given the label."""
    total = np.zeros((seen.shape[1],) * 2)
    for share, rate in ((posterior, rate1), (1 - posterior, rate0)):
        centred = seen - rate
        total += (centred * share[:, None]).T @ centred
    scale = np.sqrt(np.maximum(np.diag(total), 1e-12))
    related = np.maximum(total / scale[:, None] / scale[None, :], 0)
    np.fill_diagonal(related, 0)
    return 1 + related.sum(axis=1)


def linear_classifier(votes: np.ndarray, target: np.ndarray, ridge: float = RIDGE, steps: int = 15) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression on soft labels, by Newton steps."""
    x = np.column_stack((votes, np.ones(len(votes)))).astype(np.float64)
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    beta = np.zeros(x.shape[1])
    beta[-1] = np.log((target.sum() + 0.5) / (len(target) - target.sum() + 0.5))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (target - p) - penalty * beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return beta[:-1], float(beta[-1])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        labelled: int = LABELLED) -> Model:
    """The model of the labelled documents that are not held out.

    Equal texts count once, with label 1 if any of them has it; null labels and texts are
    left out. Without labelled documents, or with one class alone, the lexicons and patterns
    vote with fixed weights.
    """
    known = labels.where(F.col(label).isNotNull() & ~held_out(key)).groupBy(F.col(key).cast("long").alias("doc")).agg(
        F.max(F.col(label).cast("int")).alias("label"))
    known = materialize(known, "known")
    n = known.count()
    # a hash of the id picks the share that makes up the bound
    steps = 1 << 20
    share = min(steps, labelled * steps // max(n, 1))
    sample = known.where(F.pmod(F.xxhash64("doc"), steps) < share)
    texts = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text")).where("text is not null")
    # about ``labelled`` rows of two numbers
    train = texts.join(F.broadcast(sample), "doc")
    train = train.groupBy(F.xxhash64("text").alias("hash")).agg(F.max("label").alias("label"), F.min("text").alias("text"))
    train = materialize(train, "train")
    words = train.select("text", "label").mapInArrow(_count_words, "word string, toxic long, other long")
    sizes = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        voters = Voters()
        return Model(voters, np.full(voters.size, 3.0), -4.0)
    lift = F.col("toxic") / F.lit(sizes[1]) / ((F.col("other") + 0.5) / F.lit(sizes[0]))
    mined = words.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).where(
        F.col("toxic") >= SUPPORT).withColumn("lift", lift).where(F.col("lift") >= LIFT)
    best = mined.orderBy((F.col("toxic") * F.log("lift")).desc(), "word").limit(MINED).select("word").collect()
    voters = Voters([r["word"] for r in best])
    cast = train.select("text", "label", "hash").mapInArrow(_vote(voters), "label int, hash long, votes array<int>")
    rows = cast.orderBy("hash").toArrow()
    votes = np.zeros((len(rows), voters.size), dtype=np.float32)
    lists = rows["votes"].combine_chunks()
    counts = np.diff(lists.offsets.to_numpy())
    votes[np.repeat(np.arange(len(rows)), counts), lists.flatten().to_numpy()] = 1
    posterior = label_model(votes, rows["label"].to_numpy())
    return Model(voters, *linear_classifier(votes, posterior))


def _score(model: Model):
    def run(batches):
        for b in batches:
            score = [model.score(t or "") for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(score, pa.float64())], names=["doc", "score"])

    return run


def toxicity_scores(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, held_out, score, predicted.

    Null texts score as empty ones; rows without an id are not held out; repeated rows score
    alike. Other columns are not read.
    """
    rows = docs.select(F.col(key).alias("doc"), F.col(text).cast("string").alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    out = rows.mapInArrow(_score(model), f"doc {kind}, score double").withColumnRenamed("doc", key)
    return out.select(key, F.coalesce(held_out(key), F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def not_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose score is 0.5 or more; all columns as they were."""
    names = docs.columns

    def keep(batches):
        column = names.index(text)
        for b in batches:
            clean = [model.score(t or "") < 0.5 for t in b.column(column).to_pylist()]
            yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


@register("op10_toxicity")
def op10(spark, folder: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity_scores(docs, fit(docs, labels))
