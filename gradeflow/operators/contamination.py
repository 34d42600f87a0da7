"""Checks of training text against benchmark items. items: item_id, text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from gradeflow.functions.text import content_hash, ngrams, normalize_answer, normalized_words, text_of
from gradeflow.functions.wordhash import PLAIN, U, Words, bare, chunks, grams, mix, windows
from gradeflow.session import materialize

GRAM = 8  # words per n-gram
NEAR_SHARE = 0.5
#: Item n-grams whose hashes (8 bytes each) are sent to the tasks; beyond it, document n-grams are joined.
FILTER_GRAMS = 4_000_000
#: Item words, and characters of item texts, that are sent to the tasks as an automaton; beyond it, items are found by tiles.
ITEM_WORDS, ITEM_CHARS = 2_000_000, 16_000_000


def contamination_exact(docs: DataFrame, items: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents whose normalised text equals an item; ``key`` is unique.

    Only hashes meet; the texts are fetched by key.
    """
    hashes = items.select(content_hash("text").alias("_hash")).distinct()
    own = materialize(docs.select(key, content_hash("text").alias("_hash")), "content-hashes")
    return docs.join(own.join(materialize(hashes, "item-hashes"), "_hash", "left_semi").select(key), key, "left_semi")


def item_grams(items: DataFrame, n: int = GRAM) -> DataFrame:
    """Word n-grams of the items with their offset; a shorter item is one gram of all its words."""
    tokens = items.select("item_id", normalized_words("text").alias("_words")).where(F.size("_words") > 0)
    grams = F.when(F.size("_words") >= n, ngrams("_words", n)).otherwise(F.array(F.array_join("_words", " ")))
    return tokens.select("item_id", F.size("_words").alias("n_words"), F.posexplode(grams).alias("offset", "gram"))


def _gram_lengths(items: DataFrame, n: int) -> list[int]:
    """Gram lengths in use: at most ``n`` numbers."""
    sizes = items.select(F.least(F.size(normalized_words("text")), F.lit(n)).alias("n")).distinct().collect()
    return sorted(r["n"] for r in sizes if r["n"] > 0)


def _doc_grams(docs: DataFrame, key: str, text: str, lengths: list[int], positions: bool) -> DataFrame:
    """Word n-grams of whole documents of all lengths in one pass, with every position or each gram once."""
    tokens = docs.select(F.col(key), normalized_words(text).alias("_words"))
    if not positions:
        parts = F.flatten(F.array(*[F.array_distinct(ngrams("_words", n)) for n in lengths]))
        return tokens.select(key, F.explode(parts).alias("gram"))

    def placed(n: int):
        return F.transform(ngrams("_words", n), lambda g, i: F.struct(i.alias("position"), g.alias("gram")))

    return tokens.select(key, F.inline(F.flatten(F.array(*[placed(n) for n in lengths]))))


def _window_hashes(words: Words, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of all runs of ``n`` words within a document."""
    starts = windows(words.counts, words.first, n)
    return starts, mix(grams(hashes, n)[starts] ^ U(n)) if len(starts) else np.zeros(0, dtype=U)


def _known_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each n-gram, by its number of words."""
    for b in batches:
        for _, _, data, offsets in chunks(b.column(0)):
            words = Words(data, offsets, PLAIN, lower=False)
            hashes = words.hashes()
            found = np.zeros(len(words.counts), dtype=U)
            for n in np.unique(words.counts):
                starts, values = _window_hashes(words, hashes, int(n))
                whole = words.counts == n
                found[whole] = values[np.isin(starts, words.first[:-1][whole])]
            yield pa.record_batch([pa.array(found.view(np.int64))], names=["hash"])


def _scan(key: str, lengths: Sequence[int], known):
    """(key, gram) once for each n-gram of a document whose hash is known."""

    def run(batches):
        table = known.value
        mask = U((1 << max(16, int(len(table) * 16).bit_length())) - 1)
        maybe = np.zeros(int(mask) + 1, dtype=bool)
        maybe[table & mask] = True
        for b in batches:
            for low, _, data, offsets in chunks(b.column(1)):
                words = Words(*bare(data, offsets), PLAIN, lower=False)
                hashes = words.hashes()
                rows, texts = [], []
                for n in lengths:
                    starts, values = _window_hashes(words, hashes, n)
                    hit = np.flatnonzero(maybe[values & mask])
                    place = np.minimum(np.searchsorted(table, values[hit]), len(table) - 1)
                    hit = hit[table[place] == values[hit]]
                    doc = np.searchsorted(words.first, starts[hit], side="right") - 1
                    for d, s in {(d, v): s for d, v, s in zip(doc.tolist(), values[hit].tolist(), starts[hit].tolist())}.items():
                        rows.append(low + d[0])
                        texts.append(" ".join(words.data[words.starts[s] : words.ends[s + n - 1]].tobytes().decode().split()))
                yield pa.record_batch([b.column(0).take(pa.array(rows, pa.int64())), pa.array(texts, pa.string())], names=[key, "gram"])

    return run


def gram_hits(docs: DataFrame, known: DataFrame, key: str, text: str, lengths: Sequence[int]) -> DataFrame:
    """(key, gram) of the document n-grams that are in the stored table ``known`` (gram), each once per document.

    The task that reads a text tests rolling hashes of its n-grams against the sorted hashes of the
    known ones, so only hits leave it; their texts are then compared. With more than ``FILTER_GRAMS`` known
    n-grams, those of the documents are joined instead.
    """
    if known.count() > FILTER_GRAMS:
        return _doc_grams(docs, key, text, list(lengths), positions=False).join(known, "gram", "left_semi")
    hashes = known.select("gram").mapInArrow(_known_hashes, "hash long").toArrow()["hash"].to_numpy().view(U)
    table = docs.sparkSession.sparkContext.broadcast(np.unique(hashes))
    rows = docs.select(F.col(key), F.lower(text_of(text)).alias("_text"))  # the task does the rest of the normalisation
    kind = dict(docs.dtypes)[key]
    return rows.mapInArrow(_scan(key, lengths, table), f"`{key}` {kind}, gram string").join(known, "gram", "left_semi").select(key, "gram")


def _automaton(items: list[tuple[list[str], list]]):
    """(words, automaton) of the items; the automaton takes the places of words, from 1, and its entries are lists of ids."""
    import ahocorasick

    number: dict[str, int] = {}
    found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for words, ids in items:
        found.add_word(tuple(number.setdefault(w, len(number) + 1) for w in words), ids)
    found.make_automaton()
    return pa.array(list(number), pa.large_string()), found


def _find_items(key: str, items, id_type: pa.DataType):
    """(key, item_id) of all items whose words stand in a row in a text, each once per text."""

    def run(batches):
        known, automaton = _automaton(items.value)
        for b in batches:
            for low, _, data, offsets in chunks(b.column(1)):
                words = Words(*bare(data, offsets), PLAIN, lower=False)
                body, at = words.packed()
                every = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(body)])
                numbers = pc.index_in(every, known).fill_null(-1).to_numpy().astype(np.int64) + 1  # 0: in no item
                rows, found = [], []
                for i, (first, last) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
                    hits = {x for _, ids in automaton.iter(tuple(numbers[first:last].tolist())) for x in ids}
                    rows += [low + i] * len(hits)
                    found += hits
                yield pa.record_batch([b.column(0).take(pa.array(rows, pa.int64())), pa.array(found, id_type)], names=[key, "item_id"])

    return run


def contained_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                    n: int = GRAM) -> DataFrame:
    """Pairs (document, item) where the item's normalised words occur in a row in the document.

    An automaton over the numbers of the items' words is run once over each document, so only hits leave
    the task that reads it. Items of more than ``ITEM_WORDS`` words or ``ITEM_CHARS`` characters in all are
    found by tiles instead.
    """
    bodies = items.select("item_id", normalize_answer("text").alias("text")).where("text <> ''")
    texts = materialize(bodies.groupBy("text").agg(F.collect_set("item_id").alias("ids")), "item-texts")
    size = texts.agg(F.sum(F.size(F.split("text", " ")) + F.size("ids")).alias("words"), F.sum(F.length("text")).alias("chars")).first()
    if (size["words"] or 0) > ITEM_WORDS or (size["chars"] or 0) > ITEM_CHARS:
        return _contained_by_tiles(docs, items, key, text, n)
    known = docs.sparkSession.sparkContext.broadcast([(r["text"].split(" "), r["ids"]) for r in texts.collect()])
    kind, id_kind = dict(docs.dtypes)[key], dict(items.dtypes)["item_id"]
    if not known.value:
        return docs.select(key).limit(0).withColumn("item_id", F.lit(None).cast(id_kind))
    id_type = to_arrow_type(items.schema["item_id"].dataType)
    rows = docs.select(F.col(key), F.lower(text_of(text)).alias("_text"))
    return rows.mapInArrow(_find_items(key, known, id_type), f"`{key}` {kind}, item_id {id_kind}").distinct()


def _contained_by_tiles(docs: DataFrame, items: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """The pairs of ``contained_items`` for any number of items.

    The item is tiled by n-grams at offsets 0, n, 2n, ... and its last n words. It occurs at
    a start if every tile is found at its offset from there, so texts are never joined.
    """
    lengths = _gram_lengths(items, n)
    if not lengths:
        return docs.select(key).limit(0).withColumn("item_id", F.lit(None).cast("long"))
    tiles = item_grams(items, n).where(
        (F.col("offset") % n == 0) | (F.col("offset") == F.col("n_words") - n)
    )
    counts = tiles.groupBy("item_id").agg(F.count("*").alias("n_tiles"))
    # stored, so the optimizer knows its size when it chooses the join
    sized = materialize(tiles.join(counts, "item_id").drop("n_words"), "item-tiles")
    hits = _doc_grams(docs, key, text, lengths, positions=True).join(sized, "gram")
    starts = hits.groupBy(key, "item_id", (F.col("position") - F.col("offset")).alias("start")).agg(
        F.count("*").alias("found"), F.first("n_tiles").alias("n_tiles")
    )
    return starts.where(F.col("found") == F.col("n_tiles")).select(key, "item_id").distinct()


def near_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
               n: int = GRAM, share: float = NEAR_SHARE) -> DataFrame:
    """Pairs (document, item, share) where at least ``share`` of the item's n-grams are in the document."""
    lengths = _gram_lengths(items, n)
    if not lengths:
        return docs.select(key).limit(0).withColumn("item_id", F.lit(None).cast("long")).withColumn(
            "share", F.lit(None).cast("double"))
    grams = materialize(item_grams(items, n).select("item_id", "gram").distinct(), "item-grams")
    known = materialize(grams.select("gram").distinct(), "known-grams")
    hits = materialize(gram_hits(docs, known, key, text, lengths), "gram-hits")
    # an item found at all has one of its rarest n - ceil(share * n) + 1 grams in the document
    counts = hits.groupBy("gram").agg(F.count("*").alias("docs"))
    order = W.partitionBy("item_id").orderBy(F.coalesce("docs", F.lit(0)), "gram")
    ranked = grams.join(counts, "gram", "left").select(
        "item_id", "gram", F.row_number().over(order).alias("place"), F.count("*").over(W.partitionBy("item_id")).alias("n_grams"))
    rarest = ranked.where(F.col("place") <= F.col("n_grams") - F.ceil(F.col("n_grams") * share - 1e-9) + 1)
    pairs = hits.join(rarest.select("item_id", "gram", "n_grams"), "gram").select(key, "item_id", "n_grams").distinct()
    wanted = pairs.join(grams, "item_id").join(hits, [key, "gram"])
    return (
        wanted.groupBy(key, "item_id").agg(F.count("*").alias("found"), F.first("n_grams").alias("n_grams"))
        .select(key, "item_id", (F.col("found") / F.col("n_grams")).alias("share"))
        .where(F.col("share") >= share)
    )


def flagged_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ids of documents that equal, contain or nearly contain an item.

    A document that equals or contains an item has all of its n-grams, so the near match
    finds all three kinds in one pass.
    """
    return near_items(docs, items, key).select(key).distinct()


def contamination_filter(docs: DataFrame, items: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.join(flagged_documents(docs, items, key), key, "left_anti")


def contamination_rate(docs: DataFrame, items: DataFrame, key: str = "doc_id") -> DataFrame:
    flags = docs.select(key).join(
        flagged_documents(docs, items, key).withColumn("flag", F.lit(1)), key, "left"
    )
    return flags.agg(
        F.count("*").alias("total"), F.count("flag").alias("flagged"),
        (F.count("flag") / F.count("*")).alias("rate"),
    )
