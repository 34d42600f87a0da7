import math
import random
from collections import Counter

import pytest

from gradeflow.functions import pyhelpers as h
from gradeflow.functions.stems import stem_words
from gradeflow.operators import scores as s

PAIRS = "id long, prediction string, reference string"


def sample(seed=1, n=60):
    rng = random.Random(seed)
    words = ["the", "The", "cat,", "cat", "sat", "on", "mat.", "dog", "!!", "a"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))
    rows = [(i, text(), text()) for i in range(n)]
    return rows + [(n, "same words here now", "same words here now"), (n + 1, "", ""), (n + 2, None, "x"), (n + 3, "?", "")]


def plain_norm(t):
    import string

    return " ".join((t or "").lower().strip().translate(str.maketrans("", "", string.punctuation)).split())


def plain_f1(p, r):
    a, b = plain_norm(p).split(), plain_norm(r).split()
    if not a or not b:
        return float(a == b)
    same = sum((Counter(a) & Counter(b)).values())
    return 0.0 if same == 0 else 2 * (same / len(a)) * (same / len(b)) / (same / len(a) + same / len(b))


def plain_ngrams(t, n):
    toks = [w for w in __import__("re").split("[^a-z0-9]+", (t or "").lower()) if w]
    return Counter(tuple(toks[i:i + n]) for i in range(len(toks) - n + 1))


def plain_rouge(p, r, n):
    a, b = plain_ngrams(p, n), plain_ngrams(r, n)
    same = sum((a & b).values())
    if same == 0:
        return 0.0
    x, y = same / sum(a.values()), same / sum(b.values())
    return 2 * x * y / (x + y)


def plain_bleu(rows):
    match, total, c, r = Counter(), Counter(), 0, 0
    for _, p, ref in rows:
        a, b = (p or "").split(), (ref or "").split()
        c, r = c + len(a), r + len(b)
        for n in (1, 2, 3, 4):
            x = Counter(tuple(a[i:i + n]) for i in range(len(a) - n + 1))
            y = Counter(tuple(b[i:i + n]) for i in range(len(b) - n + 1))
            match[n] += sum((x & y).values())
            total[n] += max(sum(x.values()), 1)
    if match[1] == 0:
        return 0.0
    logs = sum(0.25 * math.log((match[n] or 0.1) / max(total[n], 1)) for n in (1, 2, 3, 4))
    return (1 if c > r else math.exp(1 - r / c)) * math.exp(logs)


def test_pair_scores_equal_the_plain_rules(spark):
    rows = sample()
    pairs = spark.createDataFrame(rows, PAIRS)
    f1 = {r.id: r.f1 for r in s.token_f1(pairs).collect()}
    rouge = {r.id: r for r in s.rouge_n(pairs).collect()}
    length = {r.id: r.rougeL for r in s.rouge_l(pairs).collect()}
    assert len(f1) == len(rouge) == len(length) == len(rows)
    for i, p, r in rows:
        assert f1[i] == pytest.approx(plain_f1(p, r)) and 0 <= f1[i] <= 1
        assert rouge[i].rouge1 == pytest.approx(plain_rouge(p, r, 1))
        assert rouge[i].rouge2 == pytest.approx(plain_rouge(p, r, 2))
        assert length[i] <= rouge[i].rouge1 + 1e-9
    assert s.corpus_bleu(s.bleu_counts(pairs)).first().bleu == pytest.approx(plain_bleu(rows))


def test_bleu_of_short_predictions(spark):
    """One candidate n-gram at least per pair and order, as published."""
    two = [(1, "a b", "a b c d"), (2, "a b c d e", "a b c d e")]
    got = s.corpus_bleu(s.bleu_counts(spark.createDataFrame(two, PAIRS))).first().bleu
    # matches 7, 5, 3, 2 of 7, 5, 3 + 1, 2 + 1; brevity exp(1 - 9 / 7)
    assert got == pytest.approx(math.exp(1 - 9 / 7) * (3 / 4 * 2 / 3) ** 0.25)
    for rows in (two + [(3, "", "x y"), (4, "x", "x")], [(1, "x y z", "x y z")], [(1, "", "x")]):
        pairs = spark.createDataFrame(rows, PAIRS)
        assert s.corpus_bleu(s.bleu_counts(pairs)).first().bleu == pytest.approx(plain_bleu(rows))


def test_same_text_scores_one(spark):
    pairs = spark.createDataFrame([(1, "one two three four five", "one two three four five")], PAIRS)
    got = {r.metric: r.value for r in s.all_qa_metrics(pairs).collect()}
    assert set(got) == {"f1", "exact_match", "rouge1", "rouge2", "rougeL", "bleu"}
    assert all(v == pytest.approx(1.0) for v in got.values())


def test_empty_set_scores_zero(spark):
    none = spark.createDataFrame([], PAIRS)
    assert tuple(s.qa_f1_em_mean(none).first()) == (0.0, 0.0)
    assert s.corpus_bleu(s.bleu_counts(none)).first().bleu == 0.0


def test_set_f1_and_plain_match(spark):
    rows = [(1, "A b b", "a  B"), (2, "", "x"), (3, "", "  "), (4, "a, b", "a b")]
    pairs = spark.createDataFrame(rows, PAIRS).select(
        "id", s.token_set_f1("prediction", "reference").alias("f"),
        s.exact_match_plain("prediction", "reference").alias("c"),
        s.exact_match_plain("prediction", "reference", "zero").alias("z"))
    assert [tuple(r) for r in pairs.orderBy("id").collect()] == [
        (1, 1.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0), (3, 0.0, 1.0, 0.0), (4, 0.5, 0.0, 0.0)]


def test_lcs_against_the_table_method():
    rng = random.Random(2)
    for _ in range(200):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        b = [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert h.lcs_length(a, b) == table[-1][-1]


# Examples of the paper, with the last letters that its rules leave.
PAPER = [
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"),
    ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"),
    ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"),
    ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("triplicate", "triplic"),
    ("hopeful", "hope"), ("goodness", "good"), ("revival", "reviv"), ("adjustment", "adjust"), ("adoption", "adopt"),
    ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"),
]
# Where the extended rules differ.
EXTENDED = [
    ("ties", "tie"), ("dies", "die"), ("ponies", "poni"), ("died", "die"), ("studied", "studi"), ("enjoy", "enjoy"), ("happy", "happi"),
    ("sky", "sky"), ("skies", "sky"), ("dying", "die"), ("news", "news"), ("archaeology", "archaeolog"), ("hopefully", "hope"),
    ("possibly", "possibl"), ("owed", "owe"), ("aging", "age"), ("proceed", "proceed"), ("say", "say"), ("formally", "formal"),
]


def test_stems(spark):
    from plain_stems import stem

    rng = random.Random(8)
    parts = ["a", "e", "i", "o", "u", "y", "b", "ll", "ss", "zz", "t", "st", "x", "yy", "9", *s_suffixes()]
    words = [w for w, _ in PAPER + EXTENDED] + ["", "a", "by", "yes"] + ["".join(rng.choices(parts, k=rng.randint(1, 5))) for _ in range(4000)]
    words = [w for w in words if "yyyyyy" not in w]
    df = spark.createDataFrame([(words,)], "w array<string>")
    for extended in (False, True):
        got = df.select(stem_words("w", extended)).first()[0]
        assert got == [stem(w, extended) for w in words]
    first = dict(zip(words, df.select(stem_words("w", False)).first()[0]))
    assert [first[w] for w, _ in PAPER] == [x for _, x in PAPER]
    second = dict(zip(words, df.select(stem_words("w")).first()[0]))
    assert [second[w] for w, _ in EXTENDED] == [x for _, x in EXTENDED]


def s_suffixes():
    from gradeflow.functions.stems import STEP2, STEP2_EXTENDED, STEP2_PLAIN, STEP3, STEP4

    return [*STEP2, *STEP2_EXTENDED, *STEP2_PLAIN, *STEP3, *STEP4, "s", "ies", "sses", "eed", "ied", "ed", "ing"]


def test_dict_literal():
    assert h.dict_literal("{'A': \"it's\", 'B': 2}") == {"A": "it's", "B": "2"}
    for bad in ("[1]", "{'A': ", None, "", "open('x')"):
        assert h.dict_literal(bad) == {}


def test_vector_match(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [0.0, 2.0]], [[3.0, 0.0]]), ([], [[1.0, 0.0]])],
                               "prediction_vectors array<array<double>>, reference_vectors array<array<double>>")
    rows = sorted(tuple(r) for r in s.greedy_vector_match(df).collect())
    assert rows == [(0.0, 0.0, 0.0), (0.5, 1.0, pytest.approx(2 / 3))]


def test_stem_dictionary_equals_the_rules(spark, monkeypatch):
    """Words are stemmed once and looked up; too many of them are stemmed where they stand."""
    from pyspark.sql import functions as F

    from gradeflow.functions import stems as st

    rows = [(1, ["running", "skies", "an", "caresses", "running", "zzz9"]), (2, []), (3, ["agreed", "agreed", "hopping"])]
    df = spark.createDataFrame(rows, "id int, w array<string>").repartition(2)
    want = {r.id: r.s for r in df.select("id", st.stem_words("w").alias("s")).collect()}
    for limit in (st.DICTIONARY_WORDS, 0):
        monkeypatch.setattr(st, "DICTIONARY_WORDS", limit)
        table = st.stem_dictionary(df, "w")
        assert (table is None) == (limit == 0)
        assert {r.id: r.s for r in df.select("id", st.stems_of("w", table).alias("s")).collect()} == want
    empty = st.stem_dictionary(df.limit(0), "w")
    assert empty is None or df.select(F.size(st.stems_of("w", empty))).count() == 3


def test_lcs_reads_arrow_lists(monkeypatch):
    import pyarrow as pa

    from gradeflow.functions import pyhelpers as h

    rng = random.Random(8)
    sides = [[[rng.choice("abcé") * rng.randint(1, 2) for _ in range(rng.randrange(30))] for _ in range(700)] for _ in range(2)]
    want = [h.lcs_length(a, b) for a, b in zip(*sides)]
    arrays = [pa.array(x, pa.list_(pa.string())) for x in sides]
    for size in (1, 256, 10_000):
        monkeypatch.setattr(h, "AT_ONCE", size)
        # slices of Arrow lists, not lists of Python texts
        assert h.lcs.func(*[x.slice(3) for x in arrays]).to_pylist() == want[3:]
    assert h.lcs.func(*[x.slice(0, 0) for x in arrays]).to_pylist() == []
