"""Small row helpers that run inside Arrow tasks: LCS length, vector match, dict literal."""

from __future__ import annotations

import ast

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a, b) -> int:
    """Longest common subsequence by bit rows: one big-integer step per token of ``b``."""
    places: dict = {}
    for i, token in enumerate(a):
        places[token] = places.get(token, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        hit = row & places.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


#: Rows of a batch whose words are numbered at one time.
AT_ONCE = 256


@F.arrow_udf(T.LongType())
def lcs(a: pa.Array, b: pa.Array) -> pa.Array:
    """``lcs_length`` of each row; words are compared by their numbers, so none becomes a Python text."""
    out = []
    for low in range(0, len(a), AT_ONCE):
        sides = [x.slice(low, AT_ONCE) for x in (a, b)]
        lengths = np.concatenate([pc.fill_null(pc.list_value_length(x), 0).to_numpy() for x in sides])
        ends = np.concatenate(([0], np.cumsum(lengths))).tolist()
        words = pa.concat_arrays([x.flatten() for x in sides]).dictionary_encode()
        codes = words.indices.fill_null(-1).to_numpy()
        n = len(sides[0])
        out += [lcs_length(codes[ends[i] : ends[i + 1]].tolist(), codes[ends[n + i] : ends[n + i + 1]].tolist()) for i in range(n)]
    return pa.array(out, pa.int64())


def dict_literal(text) -> dict[str, str]:
    """Python dict text -> map; anything else gives an empty map."""
    try:
        value = ast.literal_eval(text)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return {}
    if not isinstance(value, dict):
        return {}
    return {str(k): str(v) for k, v in value.items()}


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def parse_options(text: pd.Series) -> pd.Series:
    return pd.Series([dict_literal(t) for t in text], dtype=object)


MATCH = T.StructType([T.StructField(n, T.DoubleType()) for n in ("precision", "recall", "f1")])


@F.pandas_udf(MATCH)
def best_cosine(prediction: pd.Series, reference: pd.Series) -> pd.DataFrame:
    """Mean best cosine of each prediction vector to the reference vectors, and the reverse."""
    rows = []
    for p, r in zip(prediction, reference):
        a, b = _unit(p), _unit(r)
        if len(a) == 0 or len(b) == 0:
            rows.append((0.0, 0.0, 0.0))
            continue
        cosine = a @ b.T
        precision, recall = float(cosine.max(axis=1).mean()), float(cosine.max(axis=0).mean())
        both = precision + recall
        rows.append((precision, recall, 2 * precision * recall / both if both else 0.0))
    return pd.DataFrame(rows, columns=["precision", "recall", "f1"])


def _unit(vectors) -> np.ndarray:
    if vectors is None or len(vectors) == 0:
        return np.empty((0, 0))
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1.0, norm)
