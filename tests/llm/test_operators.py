"""Each operator against its rule stated plainly, on a corpus with odd rows."""

import hashlib
import random
from collections import Counter

import plain
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradeflow.llm.components import components
from gradeflow.llm.decontaminate import decontaminate
from gradeflow.llm.licenses import LICENSES, license_scan
from gradeflow.llm.line_dedup import line_dedup
from gradeflow.llm.ngram_join import similarity_classes
from gradeflow.llm.substring_dedup import repeated_spans, substring_dedup
from gradeflow.llm.token_counts import length_histogram, length_quantile, length_report, truncated_total
from gradeflow.llm.tokens import BYTE_BPE, WORD_BPE, byte_encoding
from gradeflow.llm.url_filters import Rule, filter_urls, site_rule, word_rule


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def counted(expected):
    return sorted(expected, key=str)


@pytest.mark.parametrize("size, gram", [(50, 10), (12, 4), (5, 5)])
def test_substring_dedup(docs, corpus, size, gram):
    got = rows(substring_dedup(docs, size=size, gram=gram), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == counted(plain.substring_dedup(corpus, size))


def test_substring_dedup_for_any_partitioning(docs, corpus, partitions):
    got = partitions(lambda: substring_dedup(docs).drop("kept_text"))
    assert got == counted(plain.substring_dedup(corpus))


def test_substring_dedup_stores_shared_pieces_only(spark, monkeypatch):
    from gradeflow.llm import substring_dedup as module

    stored = {}

    def counting(df, name):
        out = usual(df, name)
        stored[name] = out.count()
        return out

    usual = module.materialize
    monkeypatch.setattr(module, "materialize", counting)
    texts = [(i, " ".join(f"w{i}x{j}" for j in range(4000))) for i in range(20)] + [(20, " ".join(f"w3x{j}" for j in range(100, 200)))]
    got = {r.doc_id: r.n_removed for r in substring_dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {i: 0 for i in range(20)} | {20: 100}
    # the pieces of 80,000 unshared words are in no table
    assert stored["shared"] and max(stored.values()) < 150


def test_spans_equal_their_source(docs, corpus):
    texts = {}
    for i, t in corpus:
        texts.setdefault(i, []).append(plain.plain_words(t))
    found = repeated_spans(docs).collect()
    assert found
    for s in found:
        assert s.src_doc < s.doc and s.length >= 50
        assert any(
            w[s.start : s.start + s.length] == v[s.src_start : s.src_start + s.length]
            for w in texts[s.doc] for v in texts[s.src_doc] if len(w) >= s.start + s.length)


ITEMS_FROM = ["one two", "one", "", None, "absent words here", "ONE;two"]


def items_of(corpus):
    rng = random.Random(1)
    texts = [t for _, t in corpus if t and len(t.split()) > 30]
    items = list(enumerate(ITEMS_FROM)) + [(None, "same same same")]
    for k in range(12):
        w = rng.choice(texts).split()
        p = rng.randrange(len(w) - 20)
        items.append((100 + k, " ".join(w[p : p + rng.choice([9, 10, 11, 20])]).upper() if k % 2 else "Junk. " + ", ".join(w[p : p + 15])))
    return items + [items[-1], (5, items[-1][1])]


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_decontaminate(spark, docs, corpus, limit):
    items = items_of(corpus)
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(docs, table, broadcast_bytes=limit).withColumn("listed", F.array_join("items", ","))
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "listed", "contaminated") == counted(plain.decontaminate(corpus, items))
    assert any(r[2] for r in plain.decontaminate(corpus, items))


@pytest.mark.parametrize("words, similarity", [(3, (90, 100)), (5, (80, 100)), (3, (1, 2)), (1, (80, 100))])
def test_similarity_classes(docs, corpus, words, similarity):
    got = rows(similarity_classes(docs, words=words, similarity=similarity), "doc_id", "n_shingles", "component_id")
    assert got == counted(plain.classes(corpus, words, *similarity))


def test_similarity_classes_for_any_partitioning(docs, corpus, partitions):
    got = partitions(lambda: similarity_classes(docs, words=3, similarity=(80, 100)).drop("tag"))
    assert got == counted(plain.classes(corpus, 3, 80, 100))


def test_similarity_classes_of_a_large_family(spark, monkeypatch):
    """More members than a tile has rows; the links form chains."""
    from gradeflow.llm import groups

    monkeypatch.setattr(groups.tiles, "__defaults__", (16,))
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    family = []
    for i in range(150):
        w = list(base)
        for _ in range(i % 12):
            w[rng.randrange(60)] = f"n{rng.randrange(9)}"
        family.append((i, " ".join(w)))
    table = spark.createDataFrame(family, "doc_id long, text string")
    got = rows(similarity_classes(table, words=3, similarity=(80, 100)), "doc_id", "n_shingles", "component_id")
    assert got == counted(plain.classes(family, 3, 80, 100))


def test_similarity_classes_without_broadcasts(docs, corpus, monkeypatch):
    """Key tables beyond the bound are joined by shuffles."""
    from gradeflow.llm import groups

    monkeypatch.setattr(groups.small, "__defaults__", (0,))
    got = rows(similarity_classes(docs, words=3, similarity=(80, 100)), "doc_id", "n_shingles", "component_id")
    assert got == counted(plain.classes(corpus, 3, 80, 100))


def test_similarity_classes_when_short_keys_agree_by_chance(docs, corpus, monkeypatch):
    """Blocks of different sets in one group cost comparisons only; keys are packed after every stretch of texts."""
    from gradeflow.llm import ngram_join as module

    for name, value in (("KEY_BYTES", 1), ("BUCKETS", 3), ("PACKED", 1)):
        monkeypatch.setattr(module, name, value)
    got = rows(similarity_classes(docs, words=3, similarity=(80, 100)), "doc_id", "n_shingles", "component_id")
    assert got == counted(plain.classes(corpus, 3, 80, 100))


def test_block_keys_leave_the_texts_packed(spark):
    """A row per bucket and stretch of texts, not per key; each key that two sets have comes out with all of them."""
    import numpy as np

    from gradeflow.llm import ngram_join as module

    texts = [f"{' '.join(f'w{i // 2}x{j}' for j in range(400))} {'end' * (i % 2)}" for i in range(40)] * 3
    sent = list(module._keys(5, (80, 100), 8)([pa.record_batch([pa.array(texts)], names=["text"])]))
    bands, have = module.Bands((80, 100)), {}
    for text in texts:
        words = module.Words(np.frombuffer(text.encode(), dtype=np.uint8), np.array([0, len(text)]), module.PLAIN, lower=True)
        (grams,) = module.shingles(words, 5)
        for key in bands.keys(grams).tolist():
            have.setdefault(key, set()).add(module.vertex_of(grams))
    assert sum(b.num_rows for b in sent) == 8 < len(have) / 100
    got = {}
    for batch in module._crowded(pa.Table.from_batches(sent).sort_by("bucket").combine_chunks().to_batches()):
        for key, vertex in zip(*(c.to_pylist() for c in batch.columns)):
            got.setdefault(key, []).append(vertex)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in have.values() if len(v) > 1)


def shuffle_files(spark):
    """Sizes of the shuffle files on this machine's disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    files = [files.apply(i) for i in range(files.size())]
    return {f.getName(): f.length() for f in files if f.getName().startswith("shuffle_")}


def test_no_shuffle_files_outlive_a_stored_table(spark):
    from gradeflow.session import CLEANUP, materialize

    before = shuffle_files(spark)
    stored = materialize(spark.range(100_000).repartition(7, "id"), "dealt")
    assert not shuffle_files(spark).keys() - before.keys() and stored.count() == 100_000
    assert spark.conf.get(CLEANUP) == "false"


def test_near_copies_shuffle_no_texts(spark):
    """Only rows with the same id and text are dealt out whole; of those the first in the order of all columns stays."""
    import corpus_pipeline

    rng = random.Random(3)
    body = [" ".join(rng.choices([f"w{i}" for i in range(5000)], k=1500)) for _ in range(300)]
    table = [(i, t, "b") for i, t in enumerate(body)] + [(1000 + i, body[i] + " x", "b") for i in range(50)]
    table += [(5, body[5], "a"), (5, body[5], "c"), (6, body[7], "a"), (None, body[9], "a"), (400, None, "z"), (400, None, "y")]
    docs = spark.createDataFrame(table, "doc_id long, text string, source string").repartition(3)
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")  # else this small table is broadcast with its texts
    try:
        stage = corpus_pipeline.near_copies(spark, corpus_pipeline.materialize(docs, "docs"), "")
        before = shuffle_files(spark)
        got = {r.doc_id: tuple(r) for r in stage.collect()}
        assert sum(n for f, n in shuffle_files(spark).items() if f not in before) < 0.1 * sum(map(len, body))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    # two texts of id 6 are the least of their classes, 7 is a copy of one of them
    assert got.pop(6)[1] in (body[6], body[7]) and stage.where("doc_id = 6").count() == 1
    kept = {i: (i, t, "b") for i, t in enumerate(body) if i not in (6, 7)}
    assert got == kept | {5: (5, body[5], "a"), None: (None, body[9], "a"), 400: (400, None, "y")}


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(90)] + [(5, 5)]
    roots = plain.union(600, pairs)
    got = {r.v: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {v: roots[v] for p in pairs for v in p if p[0] != p[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_lines(table, ratio, least):
    pages, total = Counter(), Counter(s for _, s, _ in table)
    for _, s, t in table:
        pages.update({(s, x.strip(" ")) for x in (t or "").split("\n") if x.strip(" ")})
    out = []
    for i, s, t in table:
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if not (pages[s, x.strip(" ")] >= least and pages[s, x.strip(" ")] > ratio * total[s])]
        out.append((i, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_line_dedup(spark):
    rng = random.Random(4)
    lines = [f"line {i}" for i in range(30)] + ["", "  ", " menu ", "menu"]
    table = [(i, rng.choice(["a", "a", "a", "b", None]), None if i % 19 == 0 else "\n".join(rng.choices(lines, k=rng.randrange(0, 9))))
             for i in range(80)]
    table += [table[3], (900, "alone", "only\nonly"), (901, "a", "z" * 60000)]
    df = spark.createDataFrame(table, "doc_id long, source string, text string").withColumns(
        {"_row": F.lit(1), "_of": F.lit("x"), "n_lines": F.lit(0)})
    got = line_dedup(df, ratio=0.15)
    assert {"_row", "_of"} < set(got.columns)
    assert rows(got, "doc_id", "text", "n_lines", "n_dropped") == counted(plain_lines(table, 0.15, 3))
    assert line_dedup(df.limit(0)).count() == 0


def test_line_dedup_of_copies(spark):
    def own(i, n=4):
        return [f"line {k} of document {i} alone" for k in range(n)]

    table = [(i, "a", "\n".join(["home | about | contact", *own(i)])) for i in range(40)]
    table += [(100 + i, "a", "\n".join(own("copied"))) for i in range(20)]  # a third of the source
    table += [(200 + i, "b", "\n".join(own("of three"))) for i in range(3)] + [(210 + i, "b", "\n".join(own(f"b{i}"))) for i in range(9)]
    near = own("nearly copied", 9)
    table += [(300 + i, "c", "\n".join([*near, f"ending {i}"])) for i in range(20)] + [(340 + i, "c", "\n".join(own(f"c{i}"))) for i in range(40)]
    table += [(400, "a", "home | about | contact"), (401, "a", None), (402, None, "x\ny"), (403, "a", "")]
    df = spark.createDataFrame(table, "doc_id long, source string, text string").repartition(5)
    got = {r.doc_id: r for r in line_dedup(df, copies=False).collect()}
    assert len(got) == len(table)
    for i, _, text in table:
        menu = i < 40 and got[i].n_dropped > 0
        assert got[i].text == (text.split("\n", 1)[1] if menu else text) and got[i].n_dropped == menu
    # one text keeps the line, be it the one that is nothing else
    assert sum(got[i].n_dropped for i in range(40)) >= 39


def test_line_dedup_of_scattered_edits(spark):
    rng = random.Random(2)
    lines = [f"sentence {k} of the passage" for k in range(10)]
    copies = [[x + f" edited {i}" if rng.random() < 0.4 else x for x in lines] for i in range(30)]
    table = [(i, "a", "\n".join(c)) for i, c in enumerate(copies)] + [(100 + i, "a", f"other {i}\nend {i}") for i in range(60)]
    df = spark.createDataFrame(table, "doc_id long, source string, text string")
    left = Counter(x for r in line_dedup(df, ratio=0.05, copies=False).collect() for x in r.text.split("\n"))
    assert set(left) == {x for _, _, t in table for x in t.split("\n")} and all(left[x] == 1 for x in lines)


def test_license_scan(spark):
    mit = dict(LICENSES)["MIT"]
    table = [
        (1, mit), (2, "Copyright (c) 2020 Someone\n\n" + mit.replace("sublicense", "sub-licence").upper()), (3, mit + " and more"), (4, None), (5, ""),
        (6, "text\nReleased under the MIT Licence\n  licensed under CC BY-NC 4.0\nReleased under the MIT License."), (1, mit), (7, "x " * 40000),
    ]
    got = {(r.doc_id, r.license, r.notices) for r in license_scan(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert got == {(1, "MIT", ""), (2, "MIT", ""), (3, None, ""), (4, None, ""), (5, None, ""), (6, None, "CC-BY-NC-4.0,MIT"), (7, None, "")}


def test_filter_urls(spark):
    rules = [site_rule("allow", "com/"), site_rule("block", "example.com/en/"), site_rule("allow", "www.example.com/en/"),
             site_rule("block", "net/es"), *word_rule("block", "pills"), Rule("any", r"/secret$", (), "block", 1)]
    urls = {
        "https://WWW.Example.com/en/1?q#f": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
        "http://a.example.com/EN/": ("a.example.com", "/EN/", "com/", "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://example.com": ("example.com", "", None, "allow"),
        "http://x.net/español": ("x.net", "/español", "net/es", "block"),
        "http://x.net#/es": ("x.net", "", None, "allow"),
        "http://cheap-pills.org/": ("cheap-pills.org", "/", None, "block"),
        "http://pillsbury.org/": ("pillsbury.org", "/", None, "allow"),
        "ftp://h/a://b/secret": ("h", "/a://b/secret", "any", "block"),
        "no scheme.com/en/": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "http://" + "a" * 50000 + ".com/": ("a" * 50000 + ".com", "/", "com/", "allow"),
    }
    table = [(i, u, "h") for i, u in enumerate(urls)] + [(0, next(iter(urls)), "h")]
    df = spark.createDataFrame(table, "page_id long, url string, host string")
    got = rows(filter_urls(df, rules), "page_id", "host", "path", "rule", "verdict")
    assert got == counted([(i, *urls[u]) for i, u, _ in table])
    assert filter_urls(df.limit(0), rules).count() == 0 and filter_urls(df, []).count() == len(table)


@pytest.mark.parametrize("tokenizer", [BYTE_BPE, WORD_BPE])
def test_token_counts(spark, docs, corpus, tokenizer):
    if tokenizer == BYTE_BPE:
        lengths = [len(byte_encoding().encode_ordinary(t or "")) for _, t in corpus]
    else:
        import public_tokenizers
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(public_tokenizers.path(WORD_BPE))
        lengths = [len(whole.encode(t or "", add_special_tokens=False).ids) for _, t in corpus]
    report = length_report(length_histogram(docs, tokenizer=tokenizer), block=64).cache()
    for r in report.collect():
        cut = r.n_tokens
        assert (r.n_docs, r.docs_within, r.docs_beyond) == (lengths.count(cut), sum(n <= cut for n in lengths), sum(n > cut for n in lengths))
        assert (r.tokens_within, r.tokens_total) == (sum(n for n in lengths if n <= cut), sum(lengths))
        assert r.tokens_truncated == sum(min(n, cut) for n in lengths) and r.share_within == r.docs_within / len(lengths)
    for limit in (0, 1, 7, 100, 333, 10**6):
        assert truncated_total(report, limit) == sum(min(n, limit) for n in lengths)
    assert length_quantile(report, 0.5) == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    empty = length_report(length_histogram(docs.limit(0)))
    assert empty.count() == 0 and length_quantile(empty, 0.5) is None and truncated_total(empty, 9) == 0


def test_empty_tables(spark, docs):
    none, items = docs.limit(0), spark.createDataFrame([], "item_id long, text string")
    assert substring_dedup(none).count() == similarity_classes(none).count() == decontaminate(none, items).count() == 0
    assert decontaminate(docs, items).where("contaminated").count() == 0
    assert license_scan(none).count() == 0


def test_sha_of_nothing(docs):
    got = substring_dedup(docs.where("text is null")).select("kept_sha256").distinct().collect()
    assert [r[0] for r in got] == [hashlib.sha256(b"").hexdigest()]


def test_line_dedup_of_a_text_with_many_lines(spark):
    """Each line is looked up by hash, so 100,000 lines take seconds."""
    long = "\n".join(f"line {i}" for i in range(100_000))
    table = [(1, "a", long), (2, "a", long + "\nend")] + [(10 + i, "a", f"line 7\nown {i}\nmore {i}") for i in range(8)]
    df = spark.createDataFrame(table, "doc_id long, source string, text string")
    for copies in (True, False):
        got = {r.doc_id: r for r in line_dedup(df, ratio=0.5, copies=copies).collect()}
        assert (got[1].n_lines, got[2].n_lines) == (100_000, 100_001)
        assert sum(r.n_dropped for r in got.values()) == (10 if copies else 9)


@pytest.mark.parametrize("module", ["gradeflow.llm.groups", "gradeflow.operators.groups"])
def test_groups_with_the_same_members_are_taken_once(spark, module):
    import importlib

    groups = {1: (1, 2, 3), 2: (3, 2, 1), 3: (1, 2), 4: (2, 1), 5: (7,), 6: (1, 2, 3, 4)}
    df = spark.createDataFrame([(k, m) for k, v in groups.items() for m in v], "key long, member long").repartition(5)
    got = sorted(map(tuple, importlib.import_module(module).distinct_groups(df, "key", "member").collect()))
    assert got == [(k, m) for k in (1, 3, 6) for m in sorted(groups[k])]
