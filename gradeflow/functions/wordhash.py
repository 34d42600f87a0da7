"""Words and word hashes of whole Arrow batches, computed on the UTF-8 bytes with numpy.

A batch is worked through in chunks of a few megabytes (at least one document each), so
memory does not grow with the batch. No text is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
U = np.uint64
#: Odd multipliers of the polynomial hashes.
BYTE_BASE, GRAM_BASE, SPAN_BASE, SPAN_BASE_2 = (U(x) for x in (
    0x9E3779B97F4A7C55, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def _table(keep) -> np.ndarray:
    return np.array([keep(b) for b in range(256)], dtype=bool)


#: Bytes that belong to a word: all but space and \x09-\x0D.
PLAIN = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Bytes that belong to a word: digits, letters and everything outside ASCII.
ALNUM = _table(lambda b: b >= 0x80 or chr(b).isalnum())
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    out = np.full(max(n, 1), base, dtype=U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


def inverse(base: np.uint64) -> np.uint64:
    return U(pow(int(base), -1, 1 << 64))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows; null reads as empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


PUNCTUATION = _table(lambda b: 0x21 <= b <= 0x7E and not chr(b).isalnum())
# White space beyond ASCII, as UTF-8: its first bytes, and the last ones that go with them.
WIDE_SPACES = [(b"\xc2", (0x85, 0xA0)), (b"\xe1\x9a", (0x80,)), (b"\xe2\x80", (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (b"\xe2\x81", (0x9F,)),
               (b"\xe3\x80", (0x80,))]
SPACES = _table(lambda b: b == 0x20 or 0x09 <= b <= 0x0D or 0x1C <= b <= 0x1F)


def spaced(data: np.ndarray) -> np.ndarray:
    """The texts with blanks for the bytes of all white space, as ``words`` splits them."""
    data = data.copy()
    data[SPACES[data]] = 0x20
    for lead, last in WIDE_SPACES:
        at = np.flatnonzero(data[: max(len(data) - len(lead), 0)] == lead[0])
        for i, byte in enumerate(lead[1:], 1):
            at = at[data[at + i] == byte]
        at = at[np.isin(data[at + len(lead)], last)]
        for i in range(len(lead) + 1):
            data[at + i] = 0x20
    return data


def bare(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts without ASCII punctuation, with blanks for all white space: what ``normalize_answer`` splits, in lower-case texts."""
    keep = ~PUNCTUATION[data]
    upto = np.concatenate(([0], np.cumsum(keep)))
    return spaced(data[keep]), upto[offsets]


class Words:
    """The words of some documents: byte spans, and the index of each document's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool):
        self.data = LOWER[data] if lower else data
        self.inside = inside[data]
        before, after = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
        before[1:], after[:-1] = self.inside[:-1], self.inside[1:]
        if len(data):
            before[offsets[:-1][offsets[:-1] < len(data)]] = False
            after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.starts = np.flatnonzero(self.inside & ~before)
        self.ends = np.flatnonzero(self.inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def packed(self) -> tuple[np.ndarray, np.ndarray]:
        """The words' bytes without what stands between them, and their offsets."""
        return self.data[self.inside], np.concatenate(([0], np.cumsum(self.ends - self.starts)))

    def hashes(self, base: np.uint64 = BYTE_BASE) -> np.ndarray:
        """A 64-bit hash of each word; hashes of different bases are independent."""
        if not len(self.starts):
            return np.zeros(0, dtype=U)
        body, offsets = self.packed()
        lengths = np.diff(offsets)
        place = np.arange(len(body)) - np.repeat(offsets[:-1], lengths)
        terms = (body.astype(U) + U(1)) * powers(base, int(lengths.max()))[place]
        return mix(np.add.reduceat(terms, offsets[:-1]) ^ (lengths.astype(U) << U(40)))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words; those across documents must be left out by the caller."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    out = hashes[:n].copy()
    for i in range(1, k):
        out = out * GRAM_BASE + hashes[i : i + n]
    return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def spans(hashes: np.ndarray, starts: np.ndarray, length) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the word sequences that begin at ``starts``."""
    out = []
    for seed, base in ((U(0), SPAN_BASE), (U(0x5851F42D4C957F2D), SPAN_BASE_2)):
        terms = mix(hashes + seed) * powers(base, len(hashes))[: len(hashes)]
        total = np.concatenate((np.zeros(1, dtype=U), np.cumsum(terms, dtype=U)))
        back = powers(inverse(base), len(hashes) + 1)
        out.append(mix((total[starts + length] - total[starts]) * back[starts]).view(np.int64))
    return out[0], out[1]


#: Low bits of a window minimum that hold the place; the hash keeps the bits above.
PLACE = U((1 << 28) - 1)


def windows(counts: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Starts of all windows of ``size`` words that lie within one document."""
    n = np.maximum(counts - size + 1, 0)
    base = np.concatenate(([0], np.cumsum(n)))
    return np.arange(base[-1]) - np.repeat(base[:-1], n) + np.repeat(first[:-1], n)


def anchors(gram: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """For each window start the place of the smallest gram among its ``width`` grams, leftmost on ties.

    The choice depends on the words of the window alone (winnowing).
    """
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    keyed = (gram & ~PLACE) | np.arange(len(gram), dtype=U)
    return (sliding_min(keyed, width)[starts] & PLACE).astype(np.int64)
