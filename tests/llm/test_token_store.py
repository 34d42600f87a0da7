"""Token files: exact round trips, and reading single documents."""

import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from gradeflow.llm import token_store as t
from gradeflow.llm.tokens import ByteBPE, tokenizer_path
from gradeflow.llm.words import chunks


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(t.TOKENIZER))


def test_ids_equal_the_tokenizer(whole):
    rng = random.Random(1)
    signs = list("abcXYZ019 \n\n\t  ..,'\"s()<|>é×÷ñß 　 \u0085中文字😀\x1c\x0b\r-") + ["<|endoftext|>", "'s", "'re ", "foo ", "bar. ", " \n"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(60))) for _ in range(4000)] + ["<|endof", "text|> x", "", "中" * 5000, "a b " * 9000]
    encoder = ByteBPE(t.TOKENIZER)
    for remember in (10**6, 50):
        encoder.REMEMBER = remember
        for low, high, data, offsets in chunks(pa.array(texts), 20000):
            ids, upto = encoder.encode(data, offsets)
            for i in range(high - low):
                assert ids[upto[i] : upto[i + 1]].tolist() == whole.encode(texts[low + i], add_special_tokens=False).ids


def expected(whole, corpus):
    """(id, n_tokens, crc) of each row; rows without an id first."""
    rows = [(i, [*whole.encode(x or "", add_special_tokens=False).ids, t.END_ID]) for i, x in corpus]
    return sorted(((i, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for i, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("frame_ids, file_bytes", [(t.FRAME_IDS, t.FILE_BYTES), (64, 20_000), (1, 10**9)])
def test_round_trip(spark, docs, corpus, whole, tmp_path, frame_ids, file_bytes):
    if frame_ids == 1:
        docs, corpus = docs.where("doc_id > 803 and doc_id < 806"), [r for r in corpus if r[0] in (804, 805)]
    files = t.write_tokens(docs, f"{tmp_path}/tokens", frame_ids=frame_ids, file_bytes=file_bytes)
    assert files.count() > 5 or file_bytes > 20_000
    got = sorted((tuple(r) for r in t.read_tokens(files).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in got), key=lambda i: (i is not None, i or 0))  # order of the ids
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1]]  # without gaps
    assert sorted(((r[0], r[2], zlib.crc32(r[3])) for r in got), key=lambda r: (r[0] is not None, r[0] or 0, r[1:])) == expected(whole, corpus)


def test_any_tool_reads_a_file_as_its_ids(spark, docs, tmp_path):
    files = t.write_tokens(docs, f"file://{tmp_path}/tokens", frame_ids=100).collect()
    ids = b"".join(bytes(r.ids) for r in sorted(t.read_tokens(spark.createDataFrame(files)).collect(), key=lambda r: r.start))
    data = b"".join(open(f.path.removeprefix("file://"), "rb").read() for f in sorted(files, key=lambda f: f.part))
    assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read() == ids


def test_single_documents(spark, docs, corpus, whole, tmp_path):
    files = t.write_tokens(docs, f"{tmp_path}/tokens", frame_ids=64, file_bytes=20_000)
    wanted = spark.createDataFrame([(3,), (0,), (807,), (3,), (12345,), (None,), (700,)], "doc_id long")
    got = sorted(((r.doc_id, r.n_tokens, zlib.crc32(r.ids)) for r in t.read_documents(files, wanted).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))
    assert got == [r for r in expected(whole, corpus) if r[0] in (None, 0, 3, 700, 807)]
    one = t.read_documents(files, wanted.where("doc_id = 807")).select(t.ids_of("ids").alias("ids")).first().ids
    assert one == [*whole.encode(dict(corpus)[807], add_special_tokens=False).ids, t.END_ID]


def test_only_the_frames_of_a_document_are_opened(tmp_path):
    path = f"{tmp_path}/a.zst"
    lengths = np.array([5, 1, 250, 3, 41, 100])
    with open(path, "wb") as out:
        writer = t.FrameWriter(out, frame_ids=50)
        writer.add(pa.array([None, 1, 2], pa.int64()), np.arange(256, dtype=np.uint32), lengths[:3])
        writer.add(pa.array([4, 4, 9], pa.int64()), np.arange(256, 400, dtype=np.uint32), lengths[3:])
        writer.close()
    reader = t.TokenFile(path)
    assert (list(reader.places(None)), list(reader.places(4)), list(reader.places(3))) == ([0], [3, 4], [])
    assert reader.ids(4).tolist() == list(range(259, 300)) and reader.opened == 1
    assert reader.ids(2).tolist() == list(range(6, 256)) and reader.opened <= 7
    data = bytearray(open(path, "rb").read())
    data[int(reader.place[2]) + int(reader.size[2]) - 3] ^= 1
    with open(path, "wb") as out:
        out.write(data)
    damaged = t.TokenFile(path)
    assert damaged.ids(5).tolist() == list(range(300, 400))
    with pytest.raises(Exception):
        damaged.ids(2)


def test_empty_table(spark, docs, tmp_path):
    files = t.write_tokens(docs.limit(0), f"{tmp_path}/none")
    assert files.count() == 0 and t.read_tokens(files).count() == 0 and t.read_documents(files, docs).count() == 0
