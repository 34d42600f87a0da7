import random

import numpy as np
import plain
import pyarrow as pa
import pytest

from gradeflow.llm.words import ALNUM, PLAIN, Words, anchors, chunks, grams, sliding_min, spans, windows


def random_texts(n=200):
    rng = random.Random(3)
    letters = "abcXYZ09 \t\n\r\x0b\x0c\x1c\x00-_.é漢😀\x85"
    return [None if i % 17 == 0 else "".join(rng.choices(letters, k=rng.randrange(0, 60))) for i in range(n)]


@pytest.mark.parametrize("limit", [1, 50, 10_000])
@pytest.mark.parametrize("table, lower, rule", [(PLAIN, False, plain.plain_words), (ALNUM, True, plain.item_words)])
def test_words_equal_the_patterns(limit, table, lower, rule):
    texts = random_texts()
    found = []
    for low, high, data, offsets in chunks(pa.array(texts), limit):
        w = Words(data, offsets, table, lower)
        body = w.data.tobytes()
        for row in range(high - low):
            a, z = w.first[row], w.first[row + 1]
            found.append([body[s:e].decode() for s, e in zip(w.starts[a:z], w.ends[a:z])])
    assert found == [rule(t) for t in texts]


def test_hashes_depend_on_the_word_alone():
    texts = random_texts()
    seen = {}
    for _, _, data, offsets in chunks(pa.array(texts), 64):
        w = Words(data, offsets, PLAIN, False)
        body = w.data.tobytes()
        for s, e, h in zip(w.starts, w.ends, w.hashes().tolist()):
            assert seen.setdefault(body[s:e], h) == h
    assert len(set(seen.values())) == len(seen)


def test_spans_depend_on_the_words_alone():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 4, 500).astype(np.uint64) + np.uint64(9)
    starts = np.arange(400)
    length = rng.integers(1, 60, 400)
    h1, h2 = spans(h, starts, length)
    keys = [tuple(h[s : s + n].tolist()) for s, n in zip(starts, length)]
    assert len(set(keys)) == len(set(zip(h1.tolist(), h2.tolist())))
    again = spans(np.concatenate((h[:7], h)), starts + 7, length)
    assert (again[0] == h1).all() and (again[1] == h2).all()


def test_sliding_min_and_anchors():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 50, 300).astype(np.uint64) << np.uint64(40)
    for width in (1, 2, 5, 41):
        assert (sliding_min(x, width) == [x[i : i + width].min() for i in range(300 - width + 1)]).all()
        at = anchors(x, np.arange(300 - width + 1), width)
        assert (at == [i + int(np.argmin(x[i : i + width])) for i in range(300 - width + 1)]).all()


def test_windows_stay_within_documents():
    counts = np.array([3, 0, 1, 5])
    first = np.concatenate(([0], np.cumsum(counts)))
    assert windows(counts, first, 3).tolist() == [0, 4, 5, 6]
    assert len(grams(np.arange(2).astype(np.uint64), 3)) == 0
