"""Ids of texts by a trained subword tokenizer, in Arrow batches."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that are encoded together.
AT_ONCE = 256


def tokenizer_file(name: str) -> str:
    """A path as it is; a bare file name is looked up among the installed public tokenizers."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def subword_ids(tokenizer: str):
    """A function of a text column: the ids of whole texts, without special tokens. The file is loaded once per task."""
    loaded: list = []

    def encoder():
        if not loaded:
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            loaded.append(Tokenizer.from_file(tokenizer_file(tokenizer)))
        return loaded[0]

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids_of(texts: pa.Array) -> pa.Array:
        parts = []
        for low in range(0, len(texts), AT_ONCE):
            some = [t or "" for t in texts.slice(low, AT_ONCE).to_pylist()]
            parts.append(pa.array([e.ids for e in encoder().encode_batch_fast(some, add_special_tokens=False)], pa.list_(pa.int32())))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return ids_of
