"""Best-fit packing of documents into sequences of a fixed length.

Bounded-space online best fit: each task keeps a fixed number of open sequences in a bitset
keyed by free space. A piece goes where the least space stays free; if it fits nowhere a
new sequence is opened, and if too many are open the fullest closes first. Pieces come in
the order of a hash, so a task that runs again packs the same way. What is still open in
the end of a task is packed once more, sequence by sequence, with that of other tasks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.catalog import register
from gradeflow.llm.tokens import WORD_BPE, WordBPE
from gradeflow.llm.words import chunks
from gradeflow.session import materialize

CAPACITY = 4096
OPEN = 1024
#: End of document.
END_ID = 1
#: Pieces that one task packs.
PIECES = 250_000
#: Bits of a sequence number that count within a task.
LOCAL_BITS = 31

PIECE = "doc long, tag long, piece int, start long, length long, ids_crc32 long"


def _pieces(tokenizer: str, capacity: int, end_id: int):
    def run(batches):
        words = WordBPE(tokenizer)
        end = np.array([end_id], dtype="<u4")
        for b in batches:
            doc, tag = b.column(0), b.column(1)
            for low, high, data, offsets in chunks(b.column(2)):
                ids, upto = words.encode(data, offsets)
                row, piece, start, length, crc = [], [], [], [], []
                for i in range(high - low):
                    own = np.concatenate((ids[upto[i] : upto[i + 1]].astype("<u4"), end))
                    for p, at in enumerate(range(0, len(own), capacity)):
                        part = own[at : at + capacity]
                        row.append(low + i)
                        piece.append(p)
                        start.append(at)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                row = pa.array(row, pa.int64())
                yield pa.record_batch([
                    doc.take(row), tag.take(row), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                ], names=["doc", "tag", "piece", "start", "length", "ids_crc32"])

    return run


class OpenBins:
    """Open sequences in a bitset keyed by free space."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits = 0  # bit f is set if a sequence with f free places is open
        self.free: dict[int, list[int]] = {}
        self.open = 0
        self.next = 0

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) for a piece."""
        if length == self.capacity:
            self.next += 1
            return self.next - 1, 0
        fits = self.bits >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(space)
        else:
            if self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            space, bin_ = self.capacity, self.next
            self.next += 1
        if space > length:
            self.free.setdefault(space - length, []).append(bin_)
            self.bits |= 1 << (space - length)
            self.open += 1
        return bin_, self.capacity - space

    def _take(self, space: int) -> int:
        held = self.free[space]
        bin_ = held.pop()
        self.open -= 1
        if not held:
            self.bits &= ~(1 << space)
        return bin_


def _pack(capacity: int, most: int):
    """Adds bin and offset to rows with a ``length``; the bins of different tasks differ."""

    def run(batches):
        from pyspark import TaskContext

        bins = OpenBins(capacity, most)
        base = TaskContext.get().partitionId() << LOCAL_BITS
        for b in batches:
            lengths = b.column(b.schema.get_field_index("length")).to_pylist()
            placed = [bins.place(n) for n in lengths]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([base + p[0] for p in placed], pa.int64()), pa.array([p[1] for p in placed], pa.int64())],
                names=[*b.schema.names, "bin", "offset"])

    return run


def _packed(rows: DataFrame, order: list[str], n: int, capacity: int, most: int) -> DataFrame:
    """``rows`` packed in max(n / PIECES, 1) tasks, in the order of a hash of the ``order`` columns."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    mixed = rows.withColumn("_order", F.xxhash64(*order))
    mixed = mixed.repartition(max(1, -(-n // PIECES)), "_order").sortWithinPartitions("_order", *order).drop("_order")
    return mixed.mapInArrow(_pack(capacity, most), f"{schema}, bin long, offset long")


def best_fit(pieces: DataFrame, order: list[str], capacity: int = CAPACITY, most: int = OPEN) -> DataFrame:
    """``pieces`` with sequence_id and a gapless offset. ``order`` names columns that tell pieces apart.

    ``pieces`` needs a ``length`` from 1 to ``capacity`` and should be a stored table, as it is
    counted and then read. Equal rows are pieces of their own.
    """
    first = materialize(_packed(pieces, order, pieces.count(), capacity, most), "packed")
    bins = first.groupBy(F.col("bin").alias("part")).agg(F.sum("length").alias("length"))
    # a sequence that is not full is packed again as one piece
    loose = materialize(bins.where(F.col("length") < capacity), "loose")
    again = _packed(loose, ["part"], loose.count(), capacity, most)
    again = materialize(again.select("part", F.col("bin").alias("final"), F.col("offset").alias("base")), "joined")
    # odd and even numbers keep the sequences of both passes apart
    number = F.when(F.col("final").isNull(), F.col("bin") * 2).otherwise(F.col("final") * 2 + 1)
    return first.join(again, F.col("bin") == F.col("part"), "left").select(
        *pieces.columns, number.alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"))


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = WORD_BPE,
                   capacity: int = CAPACITY, most: int = OPEN, end_id: int = END_ID) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its text, then ``end_id``; null and empty texts are the end id
    alone. Only documents longer than ``capacity`` are cut, into full pieces and a rest.
    Rows without an id and repeated rows are packed like any other; an empty table gives
    no rows. Other columns are not read.
    """
    text_of, key_of = F.col(text).cast("string"), F.col(key).cast("long")
    rows = docs.select(key_of.alias("doc"), F.xxhash64(key_of, text_of).alias("tag"), text_of.alias("text"))
    pieces = materialize(rows.mapInArrow(_pieces(tokenizer, capacity, end_id), PIECE), "pieces")
    packed = best_fit(pieces, ["tag", "doc", "piece"], capacity, most)
    return packed.select(F.col("doc").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@register("op8_best_fit_packing")
def op8(spark, folder: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{folder}/documents.parquet"))
