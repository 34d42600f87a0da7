import hashlib
import random
import re

import pytest

from gradeflow.operators import contamination as c
from gradeflow.operators import dedup as d


def texts(seed=3, n=96):
    """Templates with edits: many near copies of one text, others that only share a part."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(n):
        kind = i % 4
        if kind == 0:  # near copies of the base
            t = list(base)
            for _ in range(rng.randint(0, 2)):
                t[rng.randrange(60)] = rng.choice(words)
        elif kind == 1:  # half of the base, half new
            t = base[:35] + [rng.choice(words) for _ in range(25)]
        elif kind == 2:
            t = [rng.choice(words) for _ in range(rng.randint(1, 40))]
        else:
            t = list(base) if rng.random() < 0.5 else ["same", "short"]
        rows.append((i, " ".join(t)))
    return rows


def plain_minhash(df, threshold, hashes):
    """(kept ids, dropped id -> lowest kept row it matches)."""
    family = d.hash_family(hashes, 42)
    rows = {}
    for i, text in df.select("doc_id", "text").collect():
        w = text.split()
        grams = {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} or {" ".join(w)}
        x = {int(hashlib.md5(g.encode()).hexdigest()[:15], 16) for g in grams}
        signature = [min((a * (v % d.PRIME) + b) % d.PRIME for v in x) for a, b in family]
        rows[i] = x, {(k, *signature[k : k + 4]) for k in range(0, hashes, 4)}
    kept, target = [], {}
    near = lambda i, k: rows[i][1] & rows[k][1] and len(rows[i][0] & rows[k][0]) >= threshold * len(rows[i][0] | rows[k][0])
    for i in sorted(rows):
        same = [k for k in kept if near(i, k)]
        if same:
            target[i] = min(same)
        else:
            kept.append(i)
    return kept, target


@pytest.mark.parametrize("threshold, hashes", [(0.8, 64), (0.6, 16)])
def test_minhash_equals_the_plain_rule(spark, threshold, hashes):
    df = spark.createDataFrame(texts(), "doc_id long, text string")
    kept, target = plain_minhash(df, threshold, hashes)
    for options in ({}, {"leader_rounds": 0}, {"leader_rounds": 1, "tile": 5}, {"leader_rounds": 9, "tile": 1000}):
        got = d.minhash_dedup(df, threshold=threshold, hashes=hashes, **options).collect()
        assert {r.doc_id: r.duplicate_of for r in got} == {**{k: None for k in kept}, **target}
        assert sorted(r.doc_id for r in got if r.kept) == kept


def test_minhash_for_any_partitioning(spark, partitions):
    df = spark.createDataFrame(texts(5), "doc_id long, text string")
    kept, target = plain_minhash(df, 0.8, 64)
    assert {r[0]: r[2] for r in partitions(lambda: d.minhash_dedup(df))} == {**{k: None for k in kept}, **target}


def test_sketches_lose_no_pair():
    """Sketches differ in no more bits than the sets in shingles."""
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**60, rng.integers(1, 3000)))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.9], rng.integers(0, 2**60, rng.integers(0, 300)))))
        x, y = (np.frombuffer(d.sketch_of(s), dtype=np.uint64) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_minhash_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "one  two\t"), (6, "x " * 40000), (7, "x x x x x x"), (8, "y")]
    got = {r.doc_id: r.duplicate_of for r in d.minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: None, 2: 1, 3: 1, 4: None, 5: 4, 6: None, 7: 6, 8: None}
    assert d.minhash_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_exact_dedup_is_idempotent(spark):
    df = spark.createDataFrame(texts(), "doc_id long, text string")
    once = d.exact_dedup(df)
    assert once.count() == len({t for _, t in texts()})
    assert d.exact_dedup(once).count() == once.count()


def plain_norm(text):
    import string

    return " ".join(text.lower().translate(str.maketrans("", "", string.punctuation)).split())


@pytest.mark.parametrize("limit", [None, 0])
def test_contained_and_near_equal_brute_force(spark, monkeypatch, limit):
    """Both ways: item n-grams and items sent to the tasks, and joined."""
    if limit is not None:
        for name in ("FILTER_GRAMS", "ITEM_WORDS"):
            monkeypatch.setattr(c, name, limit)
    rng = random.Random(5)
    words = [f"t{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([1, 3, 7, 8, 9, 16, 17, 30])]
    items += [(99, "  ... "), (100, items[3][1].upper() + "!")]
    docs = []
    for i in range(60):
        body = [rng.choice(words) for _ in range(rng.randint(0, 25))]
        if i % 2:
            whole = rng.choice(items)[1].split()
            cut = whole if i % 4 == 1 else whole[: max(1, len(whole) * 2 // 3)]
            body = body + [w.upper() + "," for w in cut] + body
        docs.append((i, " ".join(body)))
    doc_df = spark.createDataFrame(docs, "doc_id long, text string")
    item_df = spark.createDataFrame(items, "item_id long, text string")
    contained, near = set(), set()
    for di, dt in docs:
        dn = plain_norm(dt).split()
        for ii, it in items:
            w = plain_norm(it).split()
            if not w:
                continue
            if f" {' '.join(w)} " in f" {' '.join(dn)} ":
                contained.add((di, ii))
            n = min(8, len(w))
            grams = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}
            have = {tuple(dn[i:i + n]) for i in range(len(dn) - n + 1)}
            if len(grams & have) / len(grams) >= 0.5:
                near.add((di, ii))
    assert {tuple(r) for r in c.contained_items(doc_df, item_df).collect()} == contained
    assert {(r.doc_id, r.item_id) for r in c.near_items(doc_df, item_df).collect()} == near
    assert contained <= near
    flagged = {r.doc_id for r in c.flagged_documents(doc_df, item_df).collect()}
    assert flagged == {di for di, _ in near}
    left = {r.doc_id for r in c.contamination_filter(doc_df, item_df).collect()}
    assert left == {i for i, _ in docs} - flagged


def test_the_optimizer_chooses_the_broadcast_from_sizes(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.range(50).selectExpr("id as item_id", "cast(id as string) as text")
    plan = lambda: c.contained_items(docs, items)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan()


def test_no_text_is_shuffled_by_its_hash(spark):
    """Exchanges on a hash carry ids and hashes; those with texts go by the unique key."""
    a = spark.createDataFrame([(i, f"x {i % 7}") for i in range(40)], "doc_id long, text string")
    b = spark.createDataFrame([(i, f"x {i}") for i in range(3)], "doc_id long, text string")
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for df in (d.cross_dataset_dedup(a, b), c.contamination_exact(a, b.withColumnRenamed("doc_id", "item_id"))):
            plan = df._jdf.queryExecution().executedPlan().toString()
            keys = re.findall(r"hashpartitioning\((\w+)#", plan)
            assert set(keys) == {"doc_id", "_hash"}
            assert df.count() in (22, 18)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)


def test_document_grams_do_not_leave_the_scan(spark):
    """No plan explodes n-grams of documents, and equal hashes alone are no hit."""
    docs = spark.createDataFrame([(i, f"t{i} a b c d e f g h i") for i in range(20)], "doc_id long, text string")
    known = spark.createDataFrame([("a b c d e f g h",), ("b c d e f g h x",), ("a",)], "gram string")
    hits = c.gram_hits(docs, known, "doc_id", "text", [1, 8])
    assert "Generate" not in hits._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, hits.collect())) == sorted([(i, g) for i in range(20) for g in ("a", "a b c d e f g h")])


def test_odd_documents(spark):
    docs = spark.createDataFrame([("k1", None), ("k2", ""), ("k3", " \u3000 ... "), ("k4", "Gr\u00fc\u00dfe an ALLE, "), ("k4", "gr\u00fc\u00dfe an alle"),
                                  (None, "x gr\u00fc\u00dfe an alle y"), ("k5", "gr\u00fc\u00dfe an allen"), ("k6", "w " * 30000)], "doc_id string, text string")
    items = spark.createDataFrame([(1, "Gr\u00fc\u00dfe an alle!"), (2, None), (3, "--"), (4, "w w w w w w w w w")], "item_id long, text string")
    assert {tuple(r) for r in c.contained_items(docs, items).collect()} == {("k4", 1), (None, 1), ("k6", 4)}
    assert {(r.doc_id, r.item_id) for r in c.near_items(docs, items).where("doc_id is not null").collect()} == {("k4", 1), ("k6", 4)}


def test_no_items(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert c.flagged_documents(docs, none).count() == 0
    assert c.contained_items(docs, none).count() == 0


def test_bare_words_equal_the_expression(spark):
    """The normalisation in the task and the column expression give the same words."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import functions as F

    from gradeflow.functions.text import normalized_words
    from gradeflow.functions.wordhash import PLAIN, Words, bare, chunks

    rng = random.Random(8)
    signs = [*"abÉßñ中😀019.,!-_'\"", *" \t\n\x0b\x1c\x1f\x85\xa0     　​‐、", "ab ", "É. "]
    texts = ["".join(rng.choices(signs, k=rng.randrange(25))) for _ in range(3000)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    want = [r.w for r in df.select("i", normalized_words("t").alias("w")).orderBy("i").collect()]
    lowered = [r.t for r in df.select("i", F.lower("t").alias("t")).orderBy("i").collect()]
    got = []
    for _, _, data, offsets in chunks(pa.array(lowered), 4000):
        w = Words(*bare(np.array(data), offsets), PLAIN, lower=False)
        spans = [w.data[a:z].tobytes().decode() for a, z in zip(w.starts, w.ends)]
        got += [spans[a:z] for a, z in zip(w.first[:-1], w.first[1:])]
    assert got == want


def test_ngram_diversity_equals_sets_of_texts(spark, monkeypatch):
    from collections import Counter

    from gradeflow.operators import quality as q

    rng = random.Random(4)
    signs = ["a", "b", "É", "c\u00a0d", "x\u2003y", "..", "\x1c", "中"]
    rows = [(rng.choice(["de", "en", None, ""]), " ".join(rng.choices(signs, k=rng.randrange(12)))) for _ in range(300)] + [("de", None), ("xx", ""), ("en", "a " * 9000)]
    want = {}
    for lang in {r[0] for r in rows}:
        for n in (1, 2, 3):
            grams = Counter(tuple(w[i : i + n]) for by, t in rows if by == lang for w in [(t or "").split()] for i in range(len(w) - n + 1))
            if grams:
                want[lang, n] = len(grams), sum(grams.values())
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    for size in (8 << 20, 50):
        monkeypatch.setattr(q, "COMBINE_BYTES", size)
        got = {(r.lang, r.n): (r.distinct_grams, r.all_grams) for r in q.ngram_diversity(df, "lang").collect()}
        assert got == want
    assert q.ngram_diversity(df.limit(0), "lang").count() == 0


def test_ngram_diversity_shuffles_digests_only(spark, partitions):
    import numpy as np
    import pyarrow as pa

    from gradeflow.operators import quality as q

    df = spark.createDataFrame([(i, "en" if i % 3 else None, " ".join(f"w{j * (i + 1) % 977}" for j in range(3000))) for i in range(40)], "id long, lang string, text string")
    arrow = q._gram_digests((1, 2, 3), pa.string())
    batches = [pa.RecordBatch.from_pandas(df.select("lang", "text").toPandas())]
    sent = pa.Table.from_batches(arrow(batches))
    # whatever the number of n-grams, a task sends no more rows than buckets
    assert len(sent) <= 2 * 3 * 2**q.BUCKET_BITS and sum(sent["c"].to_pylist()) == 40 * (3000 + 2999 + 2998)
    assert {len(x) % q.DIGEST_BYTES for x in sent["digests"].to_pylist()} == {0}
    got = partitions(lambda: q.ngram_diversity(df, "lang").select("lang", "n", "distinct_grams", "all_grams"))
    want = {}
    for r in df.collect():
        w = r.text.split()
        for n in (1, 2, 3):
            want.setdefault((r.lang, n), []).extend(zip(*[w[i:] for i in range(n)]))
    assert {(a, n): (d, c) for a, n, d, c in got} == {k: (len(set(v)), len(v)) for k, v in want.items()}
    # the first numbers may be alike
    assert q._different(np.array([[1, 2], [1, 3], [1, 2], [4, 2]], dtype=np.uint64)) == 3


def test_modulo_of_the_hash_family_is_exact():
    import numpy as np

    rng = random.Random(6)
    p = d.PRIME
    values = np.array([0, 1, p - 1, p, p + 1, 2 * p, p * (2**28), 2**59 + 2**28] + [rng.randrange(2**60) for _ in range(500)])
    assert (d._modulo_prime(values.copy()) == values % p).all()
