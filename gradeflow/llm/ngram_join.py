"""Similarity join of word n-gram sets by parity sketches.

A set is XOR-hashed into a bit sketch: each n-gram flips one bit. Sets that differ in s
n-grams have sketches that differ in s bits at most, so the Hamming distance is a lower
bound of the symmetric difference. In a band of set sizes a Jaccard threshold allows a
known largest difference d. The sketch of a band is cut into more than d blocks: each
differing n-gram changes one block, so two linked sets agree in one block at least
(pigeonhole). A block is kept sparsely, as the XOR of the 64-bit values of its n-grams.

Blocks without n-grams agree by chance; they are left out wherever a set has more than d
other blocks, because then one of those must agree.

1. One pass over the texts stores, per document, the hash of its set, its size and a folded
   sketch. Equal sets are one vertex from here on.
2. A second pass sends short block keys with their vertices, packed by bucket; the task of a
   bucket keeps the keys of two vertices and more. Their members are compared by sketch
   within pairs of tiles; a spanning forest of the pairs that pass is returned, not all pairs.
3. Each vertex's smallest partner is verified on the whole sets and linked vertices form
   components; then all other edges of the forest that cross components; at last, all
   pairs that pass the sketch test and still cross components. No link is left out, and
   pairs within a component need no test.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.catalog import register
from gradeflow.llm.components import components
from gradeflow.llm.groups import distinct_groups, forest, runs, small, tiles, together
from gradeflow.llm.words import PLAIN, U, Words, chunks, grams, mix
from gradeflow.session import materialize

WORDS = 5
#: Least similarity as a fraction of whole numbers.
SIMILARITY = (80, 100)
#: Sizes of a band differ by this factor at most. Wider bands list fewer documents twice, but cut small sets finer.
BAND = 1.5
SKETCH_WORDS = 16
#: Bytes of a block key that are sent; the bucket has its first bits. Blocks whose short keys agree by chance are one group
#: whose pairs are compared like any others.
KEY_BYTES = 5
#: Grams of all sets that make a bucket of keys (about half as many keys), least number of buckets, and keys packed at a time.
BUCKET_GRAMS, BUCKETS, PACKED = 1 << 20, 64, 1 << 20

DOC = "doc long, tag long, vertex long, n int, sketch binary"


def shingles(words: Words, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct k-gram hashes of each document; shorter documents are one gram."""
    h = words.hashes()
    g = grams(h, k)
    for row, n in enumerate(words.counts.tolist()):
        low = words.first[row]
        if n >= k:
            yield np.unique(g[low : low + n - k + 1])
        else:
            yield grams(h[low : low + n], n) ^ U(n) if n else np.zeros(0, dtype=U)


class Bands:
    """Set sizes cut into bands, and the number of blocks of each band's sketch."""

    def __init__(self, similarity: tuple[int, int]):
        self.num, self.den = similarity
        self.edges = [1]

    def largest_difference(self, a: int, b: int) -> int:
        """Largest symmetric difference of linked sets of a and b elements."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def band(self, n: int) -> int:
        while self.edges[-1] <= n:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * max(BAND, self.den / self.num))))
        return int(np.searchsorted(self.edges, n, side="right")) - 1

    def top(self, band: int) -> int:
        while len(self.edges) < band + 2:
            self.band(self.edges[-1])
        return self.edges[band + 1] - 1

    def keys(self, grams_of: np.ndarray) -> np.ndarray:
        """Block keys of a set in its band and, if it can have partners there, in the next."""
        n = len(grams_of)
        own = self.band(n)
        largest = n * self.den // self.num
        values = mix(grams_of ^ U(0x2545F4914F6CDD1D))
        out = []
        for band in (own, own + 1) if largest > self.top(own) else (own,):
            top = self.top(band)
            blocks = self.largest_difference(top, top) + 1
            blocks += -(-blocks // 50) if blocks > 1 else 0
            place = ((grams_of >> U(32)) * U(blocks)) >> U(32)  # grows with the gram
            cut = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            value = np.bitwise_xor.reduceat(values, cut)
            full = value != 0
            index, value = place[cut][full], value[full]
            if len(index) <= self.largest_difference(n, min(largest, top)):
                empty = np.setdiff1d(np.arange(blocks, dtype=U), index)
                index, value = np.concatenate((index, empty)), np.concatenate((value, np.zeros(len(empty), dtype=U)))
            out.append(mix(value ^ mix(index + (U(band + 1) << U(40)))))
        return np.concatenate(out)


def sketch(grams_of: np.ndarray) -> bytes:
    """The parity sketch folded to a fixed number of bits, which keeps the lower bound."""
    bit = mix(grams_of + U(0x632BE59BD9B4E019)) >> U(64 - 4 - 6)
    assert SKETCH_WORDS == 16
    out = np.zeros(SKETCH_WORDS, dtype=U)
    np.bitwise_xor.at(out, (bit >> U(6)).astype(np.int64), U(1) << (bit & U(63)))
    return out.tobytes()


def vertex_of(grams_of: np.ndarray) -> int:
    """A 64-bit hash of a set."""
    code = np.array([len(grams_of)], dtype=U) * U(0x9E3779B97F4A7C15)
    code = mix(code ^ np.bitwise_xor.reduce(mix(grams_of))) + np.add.reduce(mix(grams_of + U(1)))
    return int(code.view(np.int64)[0])


def _describe(k: int):
    """The documents with their set's vertex, size and sketch; null for those without n-grams."""

    def run(batches):
        for b in batches:
            for low, high, data, offsets in chunks(b.column(2)):
                sets = list(shingles(Words(data, offsets, PLAIN, lower=True), k))
                yield pa.record_batch([
                    b.column(0).slice(low, high - low), b.column(1).slice(low, high - low),
                    pa.array([vertex_of(x) if len(x) else None for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int32()),
                    pa.array([sketch(x) if len(x) else None for x in sets], pa.binary()),
                ], names=["doc", "tag", "vertex", "n", "sketch"])

    return run


def _pack(keys: np.ndarray, vertices: np.ndarray, buckets: int) -> pa.RecordBatch:
    """(bucket, keys, vertices): the short keys of each bucket and their vertices, side by side."""
    bits = U(8 * KEY_BYTES)
    bucket = ((keys >> U(32)) * U(buckets)) >> U(32)
    order = np.argsort(bucket, kind="stable")
    bucket, keys, vertices = bucket[order], keys[order] & ((U(1) << bits) - U(1)), vertices[order]
    cuts = np.append(np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), len(bucket))
    short = np.ascontiguousarray(keys.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES])

    def pieces(data: np.ndarray, size: int) -> pa.Array:
        return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts * size), pa.py_buffer(data)]).cast(pa.binary())

    return pa.record_batch([pa.array(bucket[cuts[:-1]].astype(np.int32)), pieces(short, KEY_BYTES), pieces(vertices.astype("<i8", copy=False), 8)],
                           names=["bucket", "keys", "vertices"])


def _keys(k: int, similarity: tuple[int, int], buckets: int):
    """The block keys of each set's sketch, packed; copies within a stretch of texts are left out."""

    def run(batches):
        bands = Bands(similarity)
        keys, seen, held = [], {}, 0
        for b in batches:
            for _, _, data, offsets in chunks(b.column(0)):
                for x in shingles(Words(data, offsets, PLAIN, lower=True), k):
                    vertex = vertex_of(x) if len(x) else None
                    if len(x) and vertex not in seen:
                        keys.append(bands.keys(x))
                        seen[vertex] = len(keys[-1])
                        held += len(keys[-1])
                if held >= PACKED:
                    yield _pack(np.concatenate(keys), np.repeat(np.array([*seen], dtype=np.int64), [*seen.values()]), buckets)
                    keys, seen, held = [], {}, 0
        if held:
            yield _pack(np.concatenate(keys), np.repeat(np.array([*seen], dtype=np.int64), [*seen.values()]), buckets)

    return run


def _crowded(batches):
    """(key, vertex) of the keys of two vertices and more, bucket by bucket."""
    for table, cuts in runs(batches, ("bucket",)):
        bucket = table["bucket"].to_numpy()
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own = table.slice(low, high - low)
            vertex = np.frombuffer(b"".join(own["vertices"].to_pylist()), dtype="<i8")
            key = np.zeros((len(vertex), 8), dtype=np.uint8)
            key[:, :KEY_BYTES] = np.frombuffer(b"".join(own["keys"].to_pylist()), dtype=np.uint8).reshape(-1, KEY_BYTES)
            key = key.view("<i8")[:, 0] | (int(bucket[low]) << (8 * KEY_BYTES))
            order = np.argsort(key)
            key, vertex = key[order], vertex[order]
            same = key[1:] == key[:-1]
            shared = np.concatenate(([False], same)) | np.concatenate((same, [False]))
            key, vertex = key[shared], vertex[shared]
            order = np.lexsort((vertex, key))
            key, vertex = key[order], vertex[order]
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (vertex[1:] != vertex[:-1])))[: len(key)]
            key, vertex = key[new], vertex[new]
            same = key[1:] == key[:-1]
            shared = (np.concatenate(([False], same)) | np.concatenate((same, [False])))[: len(key)]
            if shared.any():
                yield pa.record_batch([pa.array(key[shared]), pa.array(vertex[shared])], names=["key", "vertex"])


def _near(sizes: np.ndarray, sketches: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """Which pairs may be linked by their sizes and the Hamming distance of their sketches."""
    num, den = similarity
    m = len(sizes)
    out = np.zeros((m, m), dtype=bool)
    step = max(1, (1 << 16) // m)
    for low in range(0, m, step):
        a = slice(low, low + step)
        apart = np.bitwise_count(sketches[a, None, :] ^ sketches[None, :, :]).sum(axis=2, dtype=np.int64)
        both = sizes[a, None] + sizes[None, :]
        out[a] = apart * (den + num) <= both * (den - num)
        out[a] &= np.maximum(sizes[a, None], sizes[None, :]) * num <= np.minimum(sizes[a, None], sizes[None, :]) * den
    np.fill_diagonal(out, False)
    return out


def _candidates(similarity: tuple[int, int], every: bool):
    """Pairs (a, b), a < b, that may be linked: a spanning forest of each group, or ``every`` pair across roots."""

    def run(batches):
        for table, cuts in runs(batches, ("key", "low", "high")):
            vertex, n, root = (table[c].to_numpy() for c in ("vertex", "n", "root"))
            bits = np.frombuffer(b"".join(table["sketch"].to_pylist()), dtype=U).reshape(-1, SKETCH_WORDS)
            found = []
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if high - low < 2:
                    continue
                own = slice(low, high)
                if every and (root[own] == root[low]).all():
                    continue
                near = _near(n[own].astype(np.int64), bits[own], similarity)
                if every:
                    near &= root[own, None] != root[None, own]
                    a, b = np.nonzero(np.triu(near))
                else:
                    a, b = forest(near)
                if len(a):
                    found.append(np.stack((vertex[own][a], vertex[own][b])))
            if found:
                a, b = np.concatenate(found, axis=1)
                pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
                pairs = pairs[pairs[:, 0] != pairs[:, 1]]
                yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _sets(k: int):
    def run(batches):
        for b in batches:
            for low, high, data, offsets in chunks(b.column(1)):
                w = Words(data, offsets, PLAIN, lower=True)
                yield pa.record_batch([
                    b.column(0).slice(low, high - low), pa.array([x.tobytes() for x in shingles(w, k)], pa.binary()),
                ], names=["vertex", "grams"])

    return run


def _verify(similarity: tuple[int, int]):
    num, den = similarity

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                one, two = (np.frombuffer(v.as_buffer(), dtype=U) for v in (x, y))
                common = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(den * common >= num * (len(one) + len(two) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.record_batch([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    return run


def similarity_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS,
                       similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: key, tag, n_shingles, component_id.

    Words are runs of bytes other than space and \\x09-\\x0D, A-Z lower-cased. Two documents
    are linked if den * intersection >= num * union of their sets of ``words``-grams;
    component_id is the smallest id reachable by links, the own id included. Null and empty
    texts have no grams and no links. Rows without an id are compared as well; their
    component has the smallest id of the others, or null. ``tag`` is a hash of id and text.
    """
    tag = F.xxhash64(F.col(key).cast("long"), F.col(text).cast("string")).alias("tag")
    rows = docs.select(F.col(key).cast("long").alias("doc"), tag, F.col(text).cast("string").alias("text"))
    described = materialize(rows.mapInArrow(_describe(words), DOC), "described")
    full = described.where("n > 0")
    # equal sets are one vertex, whose text is that of the smallest tag
    vertices = materialize(full.groupBy("vertex").agg(
        F.min("doc").alias("doc"), F.min("tag").alias("tag"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "vertices")
    links = _links(rows, vertices, words, similarity)
    classes = vertices.join(components(links).withColumnRenamed("v", "vertex"), "vertex", "left").select(
        "vertex", "doc", F.coalesce("root", "vertex").alias("root"))
    classes = materialize(classes, "classes")
    least = materialize(classes.groupBy("root").agg(F.min("doc").alias("component_id")), "least")
    named = materialize(classes.join(least, "root").select("vertex", "component_id"), "named")
    shape = [F.col("doc").alias(key), "tag", F.col("n").cast("long").alias("n_shingles")]
    return full.join(named, "vertex").select(*shape, "component_id").unionByName(
        described.where("n = 0").select(*shape, F.col("doc").alias("component_id")))


def _links(rows: DataFrame, vertices: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """Links (a, b) between vertices, enough to connect whatever is linked."""
    grams_in_all = vertices.agg(F.sum("n")).first()[0] or 0
    packed = rows.select("text").mapInArrow(_keys(words, similarity, max(BUCKETS, grams_in_all // BUCKET_GRAMS)),
                                            "bucket int, keys binary, vertices binary")
    members = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_crowded, "key long, vertex long")
    # near copies share most blocks: those with the same members list the same pairs
    members = materialize(distinct_groups(materialize(members, "block_members"), "key", "vertex"), "members")
    about = vertices.join(members.select("vertex").distinct(), "vertex", "left_semi").drop("doc")
    about = materialize(about, "about")
    pairs_of_tiles = materialize(tiles(members, "key", "vertex"), "tiles")
    about_each = about.drop("tag")

    def sets_of(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("vertex")).union(pairs.select("b")).distinct()
        wanted = materialize(about.join(ends, "vertex", "left_semi").select("vertex", "tag"), "wanted")
        texts = rows.join(small(wanted), "tag").select("vertex", "text")
        return materialize(texts.mapInArrow(_sets(words), "vertex long, grams binary"), "sets")

    def verified(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
        left, right = (sets.select(F.col("vertex").alias(v), F.col("grams").alias(f"grams_{v}")) for v in "ab")
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "grams_a", "grams_b")
        return materialize(both.mapInArrow(_verify(similarity), "a long, b long"), name)

    def compared(described: DataFrame, every: bool) -> DataFrame:
        rows = together(pairs_of_tiles.join(described, "vertex"), "key", "vertex")
        return rows.mapInArrow(_candidates(similarity, every), "a long, b long").distinct()

    tentative = materialize(compared(about_each.withColumn("root", F.col("vertex")), False), "tentative")
    sets = sets_of(tentative)
    nearest = tentative.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = verified(nearest, sets, "nearest_links")
    roots = components(links)
    crossing = (
        tentative.join(roots.select(F.col("v").alias("a"), F.col("root").alias("root_a")), "a", "left")
        .join(roots.select(F.col("v").alias("b"), F.col("root").alias("root_b")), "b", "left")
        .where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b").join(nearest, ["a", "b"], "left_anti")
    )
    links = materialize(links.unionByName(verified(crossing, sets, "crossing_links")), "forest_links")
    labels = components(links).withColumnRenamed("v", "vertex")
    rooted = about_each.join(labels, "vertex", "left").withColumn("root", F.coalesce("root", "vertex"))
    rest = compared(materialize(rooted, "rooted"), True)
    rest = materialize(rest.join(tentative, ["a", "b"], "left_anti"), "rest")
    return links.unionByName(verified(rest, sets_of(rest), "rest_links"))


SQL = r"""
    with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
    s as (select distinct doc_id, case when len(w) < 3 then array_to_string(w, ' ') else array_to_string(list_slice(w, p, p + 2), ' ') end g
          from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) p from d where len(w) > 0)),
    n as (select doc_id, count(*) n from s group by doc_id),
    -- linked sets share one of the rarest n - ceil(0.9 n) + 1 shingles of either
    f as (select g, count(*) c from s group by g),
    r as (select doc_id, g, row_number() over (partition by doc_id order by c, g) k from s join f using (g)),
    p as (select doc_id, g from r join n using (doc_id) where k <= n - ceil(0.9 * n) + 1),
    c as (select distinct a.doc_id a, b.doc_id b from p a join p b on a.g = b.g and a.doc_id < b.doc_id),
    x as (select a, b, count(*) i from c join s sa on sa.doc_id = a join s sb on sb.doc_id = b and sb.g = sa.g group by a, b),
    l as (select a, b from x join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * i >= 90 * (na.n + nb.n - i)),
    e as (select a, b from l union all select b, a from l),
    reach as (select doc_id v, doc_id u from d union select v, e.b from reach join e on e.a = u)
    select d.doc_id, coalesce(n, 0)::bigint n_shingles, m component_id
    from d left join n using (doc_id) join (select v, min(u) m from reach group by v) on v = d.doc_id"""


@register("op4_ngram_join", SQL)
def op4(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return similarity_classes(docs, words=3, similarity=(90, 100)).drop("tag")
