"""Benchmark decontamination by winnowing.

Of every window of ``span`` words the smallest gram of ``GRAM`` words is its fingerprint,
chosen by the words of the window alone. A document and an item that share ``span`` words
therefore share a fingerprint in them (the guarantee of winnowing). Items shorter than that
are one window, and their whole sequence is the fingerprint.

Fingerprints of the documents are matched with those of the items; a match is extended to
the windows around it, whose digests are joined with the digests of the items' windows.
Fingerprints of the items that prove small (``BROADCAST_BYTES``) are matched inside the
tasks that read the texts; larger ones by a join of both sides. The result is the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.catalog import register
from gradeflow.llm.words import ALNUM, Words, anchors, chunks, grams, spans, windows
from gradeflow.session import materialize

SPAN = 10
GRAM = 5
#: Item fingerprints up to this size are sent to every task.
BROADCAST_BYTES = 32 << 20

ITEM = "item string, h1 long, h2 long, len int, prints array<long>"
DOC = "doc long, tag long, n_words long, wins array<struct<pos:int,len:int,h1:long,h2:long>>"
PRINTS = "doc long, tag long, n_words long, prints array<long>, places array<int>, lens array<int>"


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values))


def _prints(w: Words, h: np.ndarray, span: int, short: list[int]):
    """(print, place, length) of all fingerprints, by document; lengths below ``span`` mark whole short items."""
    g = grams(h, min(GRAM, span))
    starts = windows(w.counts, w.first, span)
    place = np.unique(anchors(g, starts, span - min(GRAM, span) + 1))
    found = [(g[place], place, np.full(len(place), span))]
    for m in short:
        at = windows(w.counts, w.first, m)
        found.append((grams(h, m)[at], at, np.full(len(at), m)))
    value, place, length = (np.concatenate(x) for x in zip(*found))
    # a print says which kind of window it stands for
    value = (value ^ (length.astype(np.uint64) << np.uint64(57))).view(np.int64)
    order = np.argsort(place, kind="stable")
    return value[order], place[order], length[order]


def _items(span: int):
    """One row per distinct window of an item, with the fingerprints of the item in its first row."""

    def run(batches):
        for b in batches:
            for low, high, data, offsets in chunks(b.column(1)):
                w = Words(data, offsets, ALNUM, lower=True)
                h = w.hashes()
                for row in range(high - low):
                    n = int(w.counts[row])
                    if not n:
                        continue
                    own = h[w.first[row] : w.first[row + 1]]
                    length = min(span, n)
                    at = np.arange(n - length + 1)
                    h1, h2 = spans(own, at, length)
                    if n < span:
                        value = grams(own, n)
                    else:
                        g = grams(own, min(GRAM, span))
                        value = g[np.unique(anchors(g, at, span - min(GRAM, span) + 1))]
                    value = (value ^ (np.uint64(length) << np.uint64(57))).view(np.int64).tolist()
                    m = len(at)
                    yield pa.record_batch([
                        pa.array([b.column(0)[low + row].as_py()] * m, pa.string()), pa.array(h1), pa.array(h2),
                        pa.array([length] * m, pa.int32()), pa.array([value] + [[]] * (m - 1), pa.list_(pa.int64())),
                    ], names=["item", "h1", "h2", "len", "prints"])

    return run


def _around(w: Words, h: np.ndarray, places: np.ndarray, lens: np.ndarray, span: int):
    """Windows (document, place, length, digests) that hold one of the given fingerprints."""
    row = np.searchsorted(w.first, places, side="right") - 1
    low, high = w.first[row], w.first[row + 1]
    reach = span - min(GRAM, span)
    first = np.where(lens < span, places, np.maximum(places - reach, low))
    last = np.where(lens < span, places, np.minimum(places, high - span))
    n = np.maximum(last - first + 1, 0)
    base = np.concatenate(([0], np.cumsum(n)))[:-1]
    at = np.arange(n.sum()) - np.repeat(base, n) + np.repeat(first, n)
    length = np.repeat(lens, n)
    both = np.unique(at * (span + 1) + length)
    at, length = both // (span + 1), both % (span + 1)
    h1, h2 = spans(h, at, length)
    row = np.searchsorted(w.first, at, side="right") - 1
    return row, at - w.first[row], length, h1, h2


def _doc_batch(b, low, w, row, pos, length, h1, h2):
    kinds = pa.struct([("pos", pa.int32()), ("len", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])
    wins = pa.StructArray.from_arrays(
        [pa.array(pos, pa.int32()), pa.array(length, pa.int32()), pa.array(h1), pa.array(h2)], fields=list(kinds))
    counts = np.bincount(row, minlength=len(w.counts)) if len(row) else np.zeros(len(w.counts), dtype=np.int64)
    offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
    return pa.record_batch([
        b.column(0).slice(low, len(w.counts)), b.column(1).slice(low, len(w.counts)),
        pa.array(w.counts, pa.int64()), pa.ListArray.from_arrays(offsets, wins),
    ], names=["doc", "tag", "n_words", "wins"])


def _match(known: np.ndarray, span: int, short: list[int]):
    """Documents with the windows around fingerprints that are in ``known`` (sorted)."""

    def run(batches):
        for b in batches:
            for low, _, data, offsets in chunks(b.column(2)):
                w = Words(data, offsets, ALNUM, lower=True)
                h = w.hashes()
                value, place, length = _prints(w, h, span, short)
                hit = np.zeros(len(value), dtype=bool)
                if len(known):
                    at = np.minimum(np.searchsorted(known, value), len(known) - 1)
                    hit = known[at] == value
                yield _doc_batch(b, low, w, *_around(w, h, place[hit], length[hit], span))

    return run


def _all_prints(span: int, short: list[int]):
    def run(batches):
        for b in batches:
            for low, high, data, offsets in chunks(b.column(2)):
                w = Words(data, offsets, ALNUM, lower=True)
                value, place, length = _prints(w, w.hashes(), span, short)
                row = np.searchsorted(w.first, place, side="right") - 1
                n = np.bincount(row, minlength=high - low) if len(row) else np.zeros(high - low, dtype=np.int64)
                yield pa.record_batch([
                    b.column(0).slice(low, high - low), b.column(1).slice(low, high - low), pa.array(w.counts, pa.int64()),
                    _lists(value, n), _lists((place - w.first[row]).astype(np.int32), n), _lists(length.astype(np.int32), n),
                ], names=["doc", "tag", "n_words", "prints", "places", "lens"])

    return run


def _extend(span: int):
    def run(batches):
        for b in batches:
            hits = b.column(3)
            for low, high, data, offsets in chunks(b.column(2)):
                w = Words(data, offsets, ALNUM, lower=True)
                own = [hits[low + row].as_py() or [] for row in range(high - low)]
                place = np.array([p["pos"] + w.first[i] for i, x in enumerate(own) for p in x], dtype=np.int64)
                length = np.array([p["len"] for x in own for p in x], dtype=np.int64)
                yield _doc_batch(b, low, w, *_around(w, w.hashes(), place, length, span))

    return run


def _joined(rows: DataFrame, prints: DataFrame, span: int, short: list[int]) -> DataFrame:
    """The same as ``_match`` by a join of the fingerprints of both sides."""
    all_prints = materialize(rows.mapInArrow(_all_prints(span, short), PRINTS), "prints")
    each = all_prints.select("doc", "tag", F.explode(F.arrays_zip("prints", "places", "lens")).alias("p")).select(
        "doc", "tag", F.col("p.prints").alias("print"), F.col("p.places").alias("pos"), F.col("p.lens").alias("len"))
    hits = each.join(prints, "print", "left_semi").groupBy(F.col("doc").alias("hit_doc"), F.col("tag").alias("hit_tag")).agg(
        F.collect_set(F.struct("pos", "len")).alias("hits"))
    return rows.join(hits, F.expr("doc <=> hit_doc and tag = hit_tag"), "left").select("doc", "tag", "text", "hits").mapInArrow(_extend(span), DOC)


def _size_checked(prints: DataFrame, limit: int) -> np.ndarray | None:
    """The prints as a sorted array if they fit into ``limit`` bytes; at most one row more is fetched."""
    most = limit // 8
    got = prints.limit(most + 1).toPandas()["print"].to_numpy(dtype=np.int64)
    return np.sort(got) if len(got) <= most else None


def benchmark_hits(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                   item_text: str = "text", span: int = SPAN, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, hits, items) as narrow tables.

    documents: doc, tag, n_words; hits: doc, tag, pos, len, h1, h2 of each window that occurs
    in an item; items: item, h1, h2, len of each window of an item. ``tag`` is a hash of the
    text, so rows that share an id are kept apart.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(F.col(text)).alias("tag"), F.col(text).cast("string").alias("text"))
    own = items.select(F.col(item_key).cast("string").alias("item"), F.col(item_text).cast("string").alias("text"))
    wins = materialize(own.mapInArrow(_items(span), ITEM), "item_windows")
    prints = materialize(wins.select(F.explode("prints").alias("print")).distinct(), "item_prints")
    # at most span - 1 numbers
    short = sorted(r.len for r in wins.where(F.col("len") < span).select("len").distinct().collect())
    known = _size_checked(prints, broadcast_bytes)
    found = _joined(rows, prints, span, short) if known is None else rows.mapInArrow(_match(known, span, short), DOC)
    found = materialize(found, "document_windows")
    digests = materialize(wins.select("h1", "h2", "len").distinct(), "digests")
    each = found.select("doc", "tag", F.explode("wins").alias("w")).select("doc", "tag", "w.*")
    hits = each.join(digests, ["h1", "h2", "len"], "left_semi").distinct()
    return found.select("doc", "tag", "n_words"), materialize(hits, "hits"), wins.select("item", "h1", "h2", "len").distinct()


def _covered(intervals):
    """Number of places covered by (pos, len) intervals."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(acc, x):
        end = F.greatest(acc["end"], x["pos"] + x["len"])
        return F.struct(end.alias("end"), (acc["n"] + end - F.greatest(acc["end"], F.least(x["pos"], end))).alias("n"))

    return F.aggregate(F.array_sort(intervals), start, step, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                  item_text: str = "text", span: int = SPAN, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of ``docs``: key, tag, n_words, n_hit, n_items, items (sorted ids as text), contaminated.

    Words are runs of ASCII letters and digits (lower-cased) and of all characters outside
    ASCII. Null and empty texts have no words and no hits; items without words or without
    an id are in no list, but an item without an id still marks words. An empty benchmark
    hits nothing. Rows that share an id are judged one by one.
    """
    found, hits, wins = benchmark_hits(docs, items, key, text, item_key, item_text, span, broadcast_bytes)
    hit = hits.groupBy("doc", "tag").agg(F.collect_set(F.struct("pos", "len")).alias("at")).select(
        "doc", "tag", _covered("at").cast("long").alias("n_hit"))
    named = hits.select("doc", "tag", "h1", "h2", "len").distinct().join(wins.where("item is not null"), ["h1", "h2", "len"])
    listed = named.groupBy("doc", "tag").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumnsRenamed({"doc": "item_doc", "tag": "item_tag"})
    none = F.array().cast("array<string>")
    marks = hit.join(listed, F.expr("doc <=> item_doc and tag = item_tag"), "left").withColumnsRenamed({"doc": "hit_doc", "tag": "hit_tag"})
    out = found.join(marks, F.expr("doc <=> hit_doc and tag = hit_tag"), "left")
    return out.select(
        F.col("doc").alias(key), "tag", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size(F.coalesce("items", none)), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


SQL = r"""
    with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
    b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
    iw as (select distinct item_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') g
           from (select item_id, w, least(len(w), 10) n, unnest(range(1, len(w) - least(len(w), 10) + 2)) p from b where len(w) > 0)),
    dw as (select doc_id, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') g
           from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) p from d, (select distinct n from iw) where len(w) >= n)),
    hits as (select doc_id, p, dw.n, item_id from dw join iw on dw.g = iw.g and dw.n = iw.n),
    places as (select doc_id, count(distinct p + k) n_hit from hits, range(0, 10) t(k) where k < n group by doc_id),
    listed as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) items
               from (select distinct doc_id, item_id::varchar item from hits where item_id is not null) group by doc_id)
    select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
      sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
    from d left join places using (doc_id) left join listed using (doc_id)"""


@register("op3_decontaminate", SQL)
def op3(spark, folder: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    out = decontaminate(docs, items)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")
