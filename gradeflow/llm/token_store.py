"""Token ids of documents in binary files that can be read document by document.

A file is a row of independent zstandard frames, each a fixed number of little-endian
unsigned 32-bit ids (the last one fewer). Then come two skippable frames, so that any
zstandard tool reads the file as the plain ids of its documents in a row:

* the documents: their number and that of those without an id, the ids of the others, and
  the end of each in the file's ids, compressed;
* the seek table of the published seekable format: compressed and plain size and the lower
  half of the XXH64 of the plain bytes of every frame, then the footer.

A reader takes the footer, the seek table and the documents, and decompresses only those
frames that hold what it wants. Files hold ranges of document ids. Tasks write files of
names of their own and report them as rows; only files in the stored report count, so a task
that ran twice or was lost leaves at most a file that nobody reads.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gradeflow.llm.catalog import register
from gradeflow.llm.tokens import ByteBPE
from gradeflow.llm.words import chunks
from gradeflow.session import materialize, scratch_path

TOKENIZER = "byte_bpe_50k.json"
#: End of document.
END_ID = 2
#: Ids of a frame.
FRAME_IDS = 65_536
#: Bytes of text that go to one file, about.
FILE_BYTES = 64 << 20
#: Bytes of text that are encoded at once.
CHUNK_BYTES = 8 << 20
LEVEL = 3

# Fixed values of the published formats: skippable frames, seek table footer, its checksum flag.
DOCUMENTS_MAGIC, SEEK_MAGIC, FOOTER_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80

FILES = "part int, path string, n_docs long, n_null long, n_tokens long, n_bytes long, first_id long, last_id long"


def _at(path: str):
    """(file system, path in it) for a path or an address such as file:/..., hdfs://..., s3://..."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


class FrameWriter:
    """Writes documents one after the other; memory is a frame and 16 bytes a document."""

    def __init__(self, out, frame_ids: int = FRAME_IDS, level: int = LEVEL):
        self.out, self.frame_ids = out, frame_ids
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int, int]] = []
        self.rest = np.zeros(0, dtype="<u4")
        self.keys: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []
        self.n_docs = self.n_null = self.n_tokens = self.n_bytes = 0

    def _write(self, data: bytes) -> int:
        self.out.write(data)
        self.n_bytes += len(data)
        return len(data)

    def _frame(self, ids: np.ndarray) -> None:
        plain = ids.tobytes()
        self.frames.append((self._write(self.zstd.compress(plain)), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))

    def add(self, keys: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Documents in the order of their keys, nulls first, with all their ids in a row."""
        self.n_docs += len(keys)
        self.n_null += keys.null_count
        self.keys.append(keys.drop_null().to_numpy().astype("<i8"))
        self.ends.append(self.n_tokens + np.cumsum(lengths, dtype="<i8"))
        self.n_tokens += len(ids)
        ids = np.concatenate((self.rest, ids.astype("<u4")))
        whole = len(ids) // self.frame_ids * self.frame_ids
        for low in range(0, whole, self.frame_ids):
            self._frame(ids[low : low + self.frame_ids])
        self.rest = ids[whole:].copy()

    def close(self) -> None:
        if len(self.rest):
            self._frame(self.rest)
        empty = [np.zeros(0, dtype="<i8")]
        keys, ends = np.concatenate(self.keys or empty), np.concatenate(self.ends or empty)
        body = self.zstd.compress(struct.pack("<qq", self.n_docs, self.n_null) + keys.tobytes() + ends.tobytes())
        size = self._write(struct.pack("<II", DOCUMENTS_MAGIC, len(body)) + body)
        self.frames.append((size, 0, 0))
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), CHECKSUMS, FOOTER_MAGIC)
        self._write(struct.pack("<II", SEEK_MAGIC, len(table) + len(footer)) + table + footer)


class TokenFile:
    """Reads ids out of one file; ``opened`` counts the frames decompressed."""

    def __init__(self, path: str):
        system, where = _at(path)
        self.file = system.open_input_file(where)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != FOOTER_MAGIC or flags != CHECKSUMS:
            raise ValueError(f"no seek table at the end of {path}")
        table = np.frombuffer(self.file.read_at(12 * n, size - 9 - 12 * n), dtype="<u4").reshape(n, 3).astype(np.int64)
        self.path, self.size, self.plain, self.sums = path, table[:, 0], table[:, 1], table[:, 2]
        self.place = np.cumsum(self.size) - self.size
        self.upto = np.concatenate(([0], np.cumsum(self.plain) // 4))  # ids before each frame
        body = self.file.read_at(int(self.size[-1]) - 8, int(self.place[-1]) + 8)
        body = zstandard.ZstdDecompressor().decompress(body)
        n_docs, self.n_null = struct.unpack("<qq", body[:16])
        numbers = np.frombuffer(body, dtype="<i8", offset=16)
        self.keys, ends = numbers[: n_docs - self.n_null], numbers[n_docs - self.n_null :]
        self.bounds = np.concatenate(([0], ends))
        self.zstd = zstandard.ZstdDecompressor()
        self.opened = 0
        self.held: tuple[int, np.ndarray] | None = None

    def _frame(self, i: int) -> np.ndarray:
        if self.held is None or self.held[0] != i:
            data = self.file.read_at(int(self.size[i]), int(self.place[i]))
            plain = self.zstd.decompress(data, max_output_size=int(self.plain[i]))
            if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.sums[i]:
                raise ValueError(f"checksum of frame {i} of {self.path} differs")
            self.opened += 1
            self.held = i, np.frombuffer(plain, dtype="<u4")
        return self.held[1]

    def ids(self, doc: int) -> np.ndarray:
        """All ids of a document, given by its place in the file."""
        low, high = int(self.bounds[doc]), int(self.bounds[doc + 1])
        parts, i = [], int(np.searchsorted(self.upto, low, side="right")) - 1
        while low < high:
            end = min(high, int(self.upto[i + 1]))
            parts.append(self._frame(i)[low - int(self.upto[i]) : end - int(self.upto[i])])
            low, i = end, i + 1
        return np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")

    def places(self, key: int | None) -> range:
        """Places of the documents with an id."""
        if key is None:
            return range(self.n_null)
        return range(self.n_null + int(np.searchsorted(self.keys, key)), self.n_null + int(np.searchsorted(self.keys, key, "right")))

    def key(self, doc: int) -> int | None:
        return None if doc < self.n_null else int(self.keys[doc - self.n_null])


def _write_part(folder: str, tokenizer: str, end_id: int, frame_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        writer, encoder, out, ends = None, None, None, []
        for b in batches:
            for low, high, data, offsets in chunks(b.column(1), CHUNK_BYTES):
                if writer is None:
                    system, where = _at(f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.zst")
                    system.create_dir(where.rsplit("/", 1)[0], recursive=True)
                    out = system.open_output_stream(where, compression=None)
                    writer, encoder = FrameWriter(out, frame_ids), ByteBPE(tokenizer)
                ids, upto = encoder.encode(data, offsets)
                keys = b.column(0).slice(low, high - low)
                writer.add(keys, np.insert(ids, upto[1:], end_id), np.diff(upto) + 1)
                if known := keys.drop_null():
                    ends = [(ends or [known[0].as_py()])[0], known[-1].as_py()]
        if writer is not None:
            writer.close()
            out.close()
            first, last = ends or (None, None)
            # the folder's own form of address, so that any reader opens it as the writer did
            path = f"{folder}/{where.rsplit('/', 1)[1]}"
            row = (part, path, writer.n_docs, writer.n_null, writer.n_tokens, writer.n_bytes, first, last)
            kinds = [pa.int32(), pa.string()] + [pa.int64()] * 6
            yield pa.record_batch([pa.array([x], k) for x, k in zip(row, kinds)], names=[x.split()[0] for x in FILES.split(", ")])

    return run


def write_tokens(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER,
                 end_id: int = END_ID, frame_ids: int = FRAME_IDS, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the ids of whole texts, each with ``end_id``, in the order of the keys. Returns a stored row per file:

    part (its place), path, n_docs, n_null, n_tokens, n_bytes, first_id, last_id, start (ids of all files before).

    Null and empty texts are the end id alone. Rows without a key come first. Rows that share a key come
    in the order of a hash of their text; repeated rows are written each, spread over files if there
    are many. An empty table gives no file and no row. Other columns are not read. ``folder`` is a place that
    all executors reach, in a form that ``pyarrow.fs`` opens.
    """
    text_of = F.col(text).cast("string")
    rows = docs.select(F.col(key).cast("long").alias("key"), text_of.alias("text"), F.xxhash64(text_of).alias("tag"))
    size = rows.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    # a number that is given is kept, so a file is as large as asked for
    ranges = rows.repartitionByRange(-(-size // file_bytes) or 1, "key", "tag", "row").sortWithinPartitions("key", "tag", "row")
    files = materialize(ranges.select("key", "text").mapInArrow(_write_part(folder, tokenizer, end_id, frame_ids), FILES), "token-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return materialize(files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), "token-files")


READ = T.StructType([T.StructField("key", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()),
                     T.StructField("ids", T.BinaryType())])
#: Bytes of ids in a batch that leaves a reader; a batch has one document at least.
BATCH_BYTES = 4 << 20


def _documents(reader: TokenFile, start: int, places) -> Iterator[pa.RecordBatch]:
    names, kinds = READ.names, [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    rows, size = [], 0
    for doc in places:
        ids = reader.ids(doc)
        rows.append((reader.key(doc), start + int(reader.bounds[doc]), len(ids), ids.tobytes()))
        size += ids.nbytes + 32
        if size >= BATCH_BYTES:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
            rows, size = [], 0
    if rows:
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _read_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, start in zip(b["path"].to_pylist(), b["start"].to_pylist()):
            reader = TokenFile(path)
            yield from _documents(reader, start, range(len(reader.bounds) - 1))


def read_tokens(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """All documents of the files of ``write_tokens``: key, start (ids of all documents before), n_tokens, ids as bytes.

    A task reads a file frame by frame. A frame that does not match its checksum is an error.
    """
    spread = files.select("part", "path", "start").repartitionByRange(max(1, files.count()), "part")
    return spread.mapInArrow(_read_all, READ).withColumnRenamed("key", key)


def _read_wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader, path = None, None
    for b in batches:
        for p, start, wanted in zip(b["path"].to_pylist(), b["start"].to_pylist(), b["key"].to_pylist()):
            if p != path:
                reader, path = TokenFile(p), p
            yield from _documents(reader, start, reader.places(wanted))


def read_documents(files: DataFrame, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """As ``read_tokens``, for the keys in ``wanted`` alone; only frames that hold them are decompressed.

    A key that no file has gives no row, a repeated one counts once, and null asks for the rows without a key.
    Keys meet the files by the ranges of keys in the report: one row per file is broadcast.
    """
    keys = wanted.select(F.col(key).cast("long").alias("key")).distinct()
    holds = F.col("key").between(F.col("first_id"), F.col("last_id")) | (F.col("key").isNull() & (F.col("n_null") > 0))
    asked = keys.join(F.broadcast(files), holds).select("part", "path", "start", "key")
    asked = asked.repartition("part").sortWithinPartitions("part", "key")
    return asked.mapInArrow(_read_wanted, READ).withColumnRenamed("key", key)


def ids_of(ids: Column | str) -> Column:
    """The ids as an array of numbers."""
    digits = F.hex(F.col(ids) if isinstance(ids, str) else ids)

    def number(i: Column) -> Column:
        one = F.substring(digits, i * 8 + 1, F.lit(8))
        swapped = F.concat(*[F.substring(one, F.lit(p), F.lit(2)) for p in (7, 5, 3, 1)])
        return F.conv(swapped, 16, 10).cast("long")

    n = F.length(digits) / 8
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n.cast("int") - 1), number)).otherwise(F.array().cast("array<bigint>"))


@register("op13_token_output")
def op13(spark, folder: str) -> DataFrame:
    files = write_tokens(spark.read.parquet(f"{folder}/documents.parquet"), scratch_path(spark, "tokens"))
    return read_tokens(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
