"""Plug-in points: user functions run in Arrow batches, models are loaded once per task."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeflow.functions.pyhelpers import dict_literal
from gradeflow.operators.layout import pad_ids
from gradeflow.sources.readers import require_columns

FALLBACK = "A"
CHOICES = ("A", "B", "C", "D")
#: Texts of a batch that are Python values at one time.
AT_ONCE = 256


def batch_predict(items: DataFrame, load_model: Callable, predict_one: Callable, model_path: str = "") -> DataFrame:
    """items: id, question, options (dict text), meta_info, optional metamap_phrases.

    ``predict_one(model, question, options, meta_info, phrases)``; an exception or an answer
    outside A-D becomes A. ``fallback`` tells such rows.
    """
    require_columns(items, ["id", "question", "options", "meta_info"], "items")
    phrases = F.coalesce("metamap_phrases", F.lit("")) if "metamap_phrases" in items.columns else F.lit("")
    needed = items.select(
        "id", F.col("question").cast("string"), "options", F.col("meta_info").cast("string"),
        phrases.cast("string").alias("phrases"),
    )

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model(model_path)
        for batch in batches:
            answers, failed = [], []
            for row in batch.itertuples(index=False):
                try:
                    answer = predict_one(model, row.question, dict_literal(row.options), row.meta_info, row.phrases)
                    answer = str(answer).strip().upper()
                except Exception:  # a user function may fail in any way
                    answer = None
                failed.append(answer not in CHOICES)
                answers.append(answer if answer in CHOICES else FALLBACK)
            yield pd.DataFrame({"id": batch["id"], "predicted_idx": answers, "fallback": failed})

    return needed.mapInPandas(predict, "id long, predicted_idx string, fallback boolean")


def answer_with(pairs: DataFrame, generate: Callable[[str, str], str], key: str = "id",
                max_samples: int | None = None) -> DataFrame:
    """Test pairs -> (id, prediction, reference) from ``generate(instruction, input)``.

    ``max_samples`` takes the first rows by id, as an evaluation cap.
    """
    source = pairs.select(
        key, F.coalesce("instruction", F.lit("")).alias("instruction"),
        F.coalesce("input", F.lit("")).alias("input"), F.coalesce("output", F.lit("")).alias("output"),
    )
    if max_samples is not None:
        source = source.orderBy(key).limit(max_samples)

    @F.arrow_udf(T.StringType())
    def said(instructions: pa.Array, inputs: pa.Array) -> pa.Array:
        parts = []
        for low in range(0, len(instructions), AT_ONCE):
            both = (texts.slice(low, AT_ONCE).to_pylist() for texts in (instructions, inputs))
            parts.append(pa.array([generate(i, x) for i, x in zip(*both)], pa.string()))
        return pa.concat_arrays(parts or [pa.array([], pa.string())])

    # the references stay where they are; a generator need not say the same twice
    return source.select(key, said.asNondeterministic()("instruction", "input").alias("prediction"), F.col("output").alias("reference"))


def reward_with(text: Column | str, reward: Callable[[list[str]], Sequence[float]]) -> Column:
    """Reward function over a list of texts as a column."""
    @F.pandas_udf(T.DoubleType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(reward(list(texts))), dtype="float64")

    return run(text)


def map_rows(df: DataFrame, fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """Apply ``fn`` to each row. Use column expressions where they can say the same."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame([fn(r) for r in b.to_dict("records")])

    return df.mapInPandas(run, schema)


def tokenize_with(df: DataFrame, text: str, encode: Callable[[str], Sequence[int]], max_length: int,
                  pad_id: int, keep: Sequence[str] = ()) -> DataFrame:
    """Like ``layout.tokenize_pad`` with a supplied tokenizer function."""
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([list(encode(t))[:max_length] for t in texts], dtype=object)

    return pad_ids(df.select(*keep, run(text).alias("_ids")), "_ids", max_length, pad_id, keep)
