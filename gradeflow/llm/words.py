"""Words and word hashes of whole Arrow batches, under the names that the operators of this folder use."""

from gradeflow.functions.wordhash import (  # noqa: F401
    ALNUM, BYTE_BASE, CHUNK_BYTES, GRAM_BASE, LOWER, PLACE, PLAIN, SPAN_BASE, SPAN_BASE_2, U, Words, anchors, chunks, grams, inverse, mix, powers,
    sliding_min, spans, windows,
)
