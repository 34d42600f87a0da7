"""Removal of repeated passages by a compacted De Bruijn graph of word k-mers.

An edge of the graph is a window of ``size`` consecutive words; it leads from the node of
its first size-1 words to that of its last size-1 words. Successive edges whose smallest
inner gram is the same occurrence form one piece, so that a document is a path of a few
pieces (minimizer super-k-mers) instead of thousands of edges, and equal passages are cut
into equal pieces but for their two ends.

1. Pieces (gram, digest of all words, document, place). Grams of one document only are left out.
2. Equal pieces collapse to the first document that has them. A gram with one piece does
   not branch: all copies of the piece are decided by a join with its source.
3. A gram with several pieces branches there. Only for the first documents of such pieces
   are single edges made and joined.
4. Neighbours in a document whose sources are neighbours too compact to one span, which
   thereby equals the words at its source coordinates.

Every shuffle moves narrow rows that were combined before it; texts move twice, once for
branching documents and once for the result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradeflow.llm.catalog import register
from gradeflow.llm.words import PLAIN, Words, anchors, chunks, grams, spans, windows
from gradeflow.session import materialize

SIZE = 50
GRAM = 10

PIECE = "gram long, h1 long, h2 long, doc long, tag long, pos int, n int"
EDGE = "h1 long, h2 long, doc long, tag long, pos int, n int"
RESULT = "doc long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _batch(schema: str, **columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    names = [x.split() for x in schema.split(", ")]
    return pa.record_batch([pa.array(columns[n]).cast(kinds[k]) for n, k in names], names=[n for n, _ in names])


def _pieces(size: int, gram: int):
    def run(batches):
        for b in batches:
            doc, tag = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for low, _, data, offsets in chunks(b.column(2)):
                w = Words(data, offsets, PLAIN, lower=False)
                starts = windows(w.counts, w.first, size)
                if not len(starts):
                    continue
                h = w.hashes()
                g = grams(h, gram)
                place = anchors(g, starts, size - gram + 1)
                new = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
                n = np.diff(np.concatenate((new, [len(place)])))
                at = starts[new]
                h1, h2 = spans(h, at, n + size - 1)
                row = np.searchsorted(w.first, at, side="right") - 1
                yield _batch(PIECE, gram=g[place[new]].view(np.int64), h1=h1, h2=h2, doc=doc[low + row],
                             tag=tag[low + row], pos=at - w.first[row], n=n)

    return run


def _edges(size: int):
    def run(batches):
        for b in batches:
            doc, tag = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            wanted = b.column(3)
            for low, high, data, offsets in chunks(b.column(2)):
                w = Words(data, offsets, PLAIN, lower=False)
                h = w.hashes()
                for row in range(high - low):
                    parts = wanted[low + row].as_py() or []
                    at = np.concatenate([np.arange(p["pos"], p["pos"] + p["n"]) for p in parts])
                    h1, h2 = spans(h[w.first[row] : w.first[row + 1]], at, size)
                    many = np.ones(len(at), dtype=np.int64)
                    yield _batch(EDGE, h1=h1, h2=h2, doc=many * doc[low + row], tag=many * tag[low + row], pos=at, n=many)

    return run


def _cut(batches):
    """Documents without the words of their spans."""
    for b in batches:
        found = b.column(2)
        for low, high, data, offsets in chunks(b.column(1)):
            w = Words(data, offsets, PLAIN, lower=False)
            rows = []
            for row in range(high - low):
                n = int(w.counts[row])
                gone = np.zeros(n + 1, dtype=np.int64)
                for s in found[low + row].as_py() or []:
                    gone[s["start"]] += 1
                    gone[s["start"] + s["length"]] -= 1
                keep = np.cumsum(gone)[:n] == 0
                a, z = w.first[row], w.first[row + 1]
                body = data[offsets[row] : offsets[row + 1]].tobytes()
                base = int(offsets[row])
                text = b" ".join(body[s - base : e - base] for s, e, k in zip(
                    w.starts[a:z].tolist(), w.ends[a:z].tolist(), keep.tolist()) if k)
                rows.append((n, n - int(keep.sum()), hashlib.sha256(text).hexdigest(), text.decode()))
            n, gone, digest, text = zip(*rows)
            yield pa.record_batch([
                b.column(0).slice(low, high - low), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                pa.array(digest, pa.string()), pa.array(text, pa.string())], names=[x.split()[0] for x in RESULT.split(", ")])


def _source(table: DataFrame, *by: str) -> DataFrame:
    """First document and place of each sequence that occurs more than once."""
    return table.groupBy(*by).agg(F.min(F.struct("doc", "pos")).alias("src"), F.count("*").alias("copies"))


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """Maximal spans (doc, tag, start, length, src_doc, src_start) of words covered by windows that
    start in a document with a smaller id, and the words they equal there.

    ``tag`` is a hash of the text, so rows that share an id are kept apart. Rows without an
    id or with fewer than ``size`` words have no spans. Nulls read as empty texts.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(F.col(text)).alias("tag"), F.col(text).cast("string").alias("text"))
    rows = rows.where("doc is not null")
    # most pieces are not shared, so they are made twice and only those that are shared are stored
    pieces = rows.mapInArrow(_pieces(size, gram), PIECE)
    shared = pieces.groupBy("gram").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("gram")
    occurrences = materialize(pieces.join(materialize(shared, "shared"), "gram", "left_semi"), "occurrences")
    first = materialize(_source(occurrences, "gram", "h1", "h2"), "first")
    branching = materialize(first.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1").select("gram"), "branching")
    placed = occurrences.join(first, ["gram", "h1", "h2"])
    whole = placed.where("doc > src.doc").select("doc", "tag", "pos", "n", "src")
    # single edges, only where the graph branches
    ends = first.join(branching, "gram", "left_semi").select("gram", "h1", "h2", F.col("src.doc").alias("doc"))
    parts = occurrences.join(ends, ["gram", "h1", "h2", "doc"]).groupBy("doc", "tag").agg(
        F.collect_list(F.struct("pos", "n")).alias("parts"))
    edges = materialize(rows.join(parts, ["doc", "tag"]).select("doc", "tag", "text", "parts").mapInArrow(_edges(size), EDGE), "edges")
    edge_first = edges.groupBy("h1", "h2").agg(F.min(F.struct("doc", "pos")).alias("src"), F.max("doc").alias("last"))
    edge_first = materialize(edge_first.where("src.doc < last").drop("last"), "edge_first")
    single = edges.join(edge_first, ["h1", "h2"]).where("doc > src.doc").select("doc", "tag", "pos", "n", "src")
    path = Window.partitionBy("doc", "tag").orderBy("pos")
    follows = (
        (F.col("src.doc") == F.lag("src.doc").over(path))
        & (F.col("pos") == F.lag(F.col("pos") + F.col("n")).over(path))
        & (F.col("src.pos") == F.lag(F.col("src.pos") + F.col("n")).over(path))
    )
    chained = whole.unionByName(single).withColumn("new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1))
    chained = chained.withColumn("island", F.sum("new").over(path))
    return chained.groupBy("doc", "tag", "island").agg(
        F.min("pos").alias("start"), (F.sum("n") + (size - 1)).cast("int").alias("length"),
        F.min("src.doc").alias("src_doc"), F.min("src.pos").alias("src_start"),
    ).drop("island")


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs``: the key, n_words, n_removed, kept_sha256 and kept_text.

    Words are runs of bytes other than space and \\x09-\\x0D. Null and empty texts have no
    words and keep the empty text; rows without an id keep all words; an empty table gives
    an empty result. Rows with one id do not remove each other's words. Other columns of
    ``docs`` do not matter and may have any name.
    """
    found = repeated_spans(docs, key, text, size, gram).groupBy("doc", "tag").agg(
        F.collect_list(F.struct("start", "length")).alias("spans"))
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(F.col(text)).alias("tag"), F.col(text).cast("string").alias("text"))
    out = rows.join(found, ["doc", "tag"], "left").select("doc", "text", "spans").mapInArrow(_cut, RESULT)
    return out.withColumnRenamed("doc", key)


SQL = r"""
    with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
    win as (select doc_id, p, md5(array_to_string(list_slice(w, p, p + 49), ' ')) h
            from (select doc_id, w, unnest(range(1, len(w) - 48)) p from d where len(w) >= 50)),
    hits as (select win.doc_id, win.p from win join (select h, min(doc_id) m from win group by h) f on win.h = f.h and f.m < win.doc_id),
    gone as (select distinct doc_id, p + k i from hits, range(0, 50) t(k)),
    words as (select doc_id, unnest(range(1, len(w) + 1)) i, unnest(w) x from d),
    kept as (select doc_id, count(*) n, string_agg(x, ' ' order by i) t from words
             where not exists (select 1 from gone where gone.doc_id = words.doc_id and gone.i = words.i) group by doc_id)
    select d.doc_id, len(w)::bigint n_words, (len(w) - coalesce(n, 0))::bigint n_removed, sha256(coalesce(t, '')) kept_sha256
    from d left join kept using (doc_id)"""


@register("op2_substring_dedup", SQL)
def op2(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return substring_dedup(docs).drop("kept_text")
