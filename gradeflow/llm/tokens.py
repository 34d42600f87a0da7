"""Token ids of whole Arrow batches with public tokenizer files; files are named by a path or in ``public_tokenizers``.

A BPE that drops white space and marks word ends encodes each run between blanks by
itself. Its distinct runs are encoded once per task and the ids of the texts are gathered
from them. Runs of ASCII and Latin-1 letters go through the same merges as byte pairs in
tiktoken, which is much faster; any other run goes through the tokenizer itself.
"""

from __future__ import annotations

import base64
import json
import os
import re

import numpy as np
import pyarrow as pa

from gradeflow.llm.words import PLAIN, Words

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.tiktoken"
#: Distinct runs that a task remembers before it starts anew.
REMEMBER = 400_000


def tokenizer_path(name: str) -> str:
    """A path as it is; a bare file name is looked up in the installed public files."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_encoding(name: str = BYTE_BPE):
    """A tiktoken encoding of a file of ranks."""
    import public_tokenizers
    import tiktoken

    with open(tokenizer_path(name)) as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class WordBPE:
    """Ids of texts by a word-end BPE, equal to the tokenizer's own without special tokens."""

    END = ""  # stands for the word end
    FAST = re.compile("(?:(?!<\\|)[\x21-\x7eÀ-ÿ])*")

    def __init__(self, name: str = WORD_BPE):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = tokenizer_path(name)
        self.whole = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        end, characters = self.END.encode(), _byte_characters()
        suffix = spec["model"]["end_of_word_suffix"]
        special = {t["content"] for t in spec["added_tokens"]}
        ids = {}
        for token, i in spec["model"]["vocab"].items():
            if token not in special:
                body = token.removesuffix(suffix)
                ids[bytes(characters[c] for c in body) + (end if body != token else b"")] = i
        # single bytes first, then the end mark, then bytes with it, then the merges in their order
        order = [bytes([b]) for b in range(256)] + [end[:2], end] + [bytes([b]) + end for b in range(256)]
        order = dict.fromkeys(order + sorted(ids, key=ids.get))
        ranks = {token: rank for rank, token in enumerate(order)}
        self.id_of_rank = np.array([ids.get(token, -1) for token in ranks], dtype=np.int32)
        self.ends = np.array([len(t) > len(end) and t.endswith(end) for t in ranks])
        self.pairs = tiktoken.Encoding("words", pat_str=f"[^{self.END}]*{self.END}", mergeable_ranks=ranks, special_tokens={})
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split["pattern"]["Regex"])
        self._forget()

    def _forget(self) -> None:
        self.code: dict[str, int] = {}
        self.flat = np.zeros(0, dtype=np.int32)
        self.at = np.zeros(0, dtype=np.int64)
        self.length = np.zeros(0, dtype=np.int64)

    def _learn(self, runs: list[str]) -> None:
        """Encode runs that are not known yet."""
        fast = [r for r in runs if self.FAST.fullmatch(r)]
        slow = [r for r in runs if not self.FAST.fullmatch(r)]
        ids, lengths = [], []
        if fast:
            marked = self.split.sub(lambda m: m.group() + self.END, " ".join(fast).lower())
            pieces = np.array([x.count(self.END) for x in marked.split(" ")], dtype=np.int64)
            ranks = np.array(self.pairs.encode_ordinary(marked.replace(" ", "")), dtype=np.int64)
            last = np.flatnonzero(self.ends[ranks]) + 1
            upto = np.concatenate(([0], last))[np.cumsum(pieces)]
            lengths.append(np.diff(np.concatenate(([0], upto))))
            ids.append(self.id_of_rank[ranks])
        if slow:
            found = [e.ids for e in self.whole.encode_batch(slow, add_special_tokens=False)]
            lengths.append(np.array([len(x) for x in found], dtype=np.int64))
            ids.append(np.array([i for x in found for i in x], dtype=np.int32))
        lengths = np.concatenate(lengths)
        self.code.update((r, len(self.at) + i) for i, r in enumerate(fast + slow))
        self.at = np.concatenate((self.at, len(self.flat) + np.concatenate(([0], np.cumsum(lengths)[:-1]))))
        self.flat = np.concatenate((self.flat, *ids))
        self.length = np.concatenate((self.length, lengths))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, offsets) for UTF-8 bytes and document offsets."""
        w = Words(data, offsets, PLAIN, lower=False)
        if not len(w.starts):
            return np.zeros(0, dtype=np.int32), np.zeros(len(offsets), dtype=np.int64)
        body, at = w.packed()
        runs = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(body)])
        runs = runs.dictionary_encode()
        distinct = runs.dictionary.to_pylist()
        if len(self.code) > REMEMBER:
            self._forget()
        if new := [r for r in distinct if r not in self.code]:
            self._learn(new)
        codes = np.fromiter(map(self.code.__getitem__, distinct), np.int64, len(distinct))[runs.indices.to_numpy()]
        lengths = self.length[codes]
        upto = np.concatenate(([0], np.cumsum(lengths)))
        place = np.arange(upto[-1]) + np.repeat(self.at[codes] - upto[:-1], lengths)
        return self.flat[place], upto[w.first]


def _bytes_in(*ranges: tuple[int, int]) -> np.ndarray:
    return np.array([any(a <= b <= z for a, z in ranges) for b in range(256)], dtype=bool)


class ByteBPE:
    """Ids of texts by a byte-level BPE of the ``tokenizers`` library, equal to encoding each whole text.

    The pre-tokenizer always starts a new piece before white space that follows a visible
    character, after a lone line break, and before ASCII punctuation that follows a letter or
    digit. Texts are cut at such places (only where the bytes leave no doubt), the distinct
    pieces are encoded once per task by the tokenizer itself, and ids are gathered from
    them. Text without such places, such as Chinese, is encoded run by run.
    """

    VISIBLE, LETTER = _bytes_in((0x21, 0x7E)), _bytes_in((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))
    PUNCTUATION = VISIBLE & ~LETTER
    CONTINUES, TWO_BYTES = _bytes_in((0x80, 0xBF)), _bytes_in((0xC3, 0xDF))  # C2 leads the no-break space
    OPENS = VISIBLE | TWO_BYTES | _bytes_in((0xE4, 0xEE), (0xF0, 0xF4))
    LATIN = _bytes_in((0xC3, 0xC9))
    BREAK = _bytes_in((0x09, 0x0D))
    SPACE = BREAK | _bytes_in((0x20, 0x20))
    #: Distinct pieces that a task remembers, and how many are encoded at once.
    REMEMBER, AT_ONCE = 1_000_000, 20_000

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(tokenizer_path(name))
        self.special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.code: dict[str, int] = {}
        self.flat = np.zeros(0, dtype=np.uint32)
        self.at = np.zeros(0, dtype=np.int64)
        self.length = np.zeros(0, dtype=np.int64)

    def _learn(self, pieces: list[str]) -> None:
        ids, lengths = [self.flat], [self.length]
        for low in range(0, len(pieces), self.AT_ONCE):
            found = [e.ids for e in self.whole.encode_batch_fast(pieces[low : low + self.AT_ONCE], add_special_tokens=False)]
            lengths.append(np.array([len(x) for x in found], dtype=np.int64))
            ids.append(np.array([i for x in found for i in x], dtype=np.uint32))
        self.code.update(zip(pieces, range(len(self.code), len(self.code) + len(pieces))))
        self.flat, self.length = np.concatenate(ids), np.concatenate(lengths)
        self.at = np.cumsum(self.length) - self.length

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Places where a piece begins, the beginnings of all documents with text among them."""
        cut = np.zeros(len(data) + 1, dtype=bool)
        lead = np.zeros(len(data), dtype=np.uint8)
        lead[1:] = data[:-1]
        follows = self.CONTINUES[data]
        visible = self.VISIBLE[data] | (follows & self.TWO_BYTES[lead])  # the byte ends a character that is no space
        # the two signs among the Latin-1 letters are no letters
        letter = self.LETTER[data] | (follows & self.LATIN[lead] & ~((lead == 0xC3) & ((data == 0x97) | (data == 0xB7))))
        space = self.SPACE[data]
        cut[1:-1] = (visible[:-1] & space[1:]) | (letter[:-1] & self.PUNCTUATION[data[1:]])
        cut[2:-1] |= visible[:-2] & self.BREAK[data[1:-1]] & self.OPENS[data[2:]]
        whole = data.tobytes()
        for token in self.special:  # their strings are one token
            at = whole.find(token)
            while at >= 0:
                cut[at + 1 : at + len(token)] = False
                at = whole.find(token, at + 1)
        cut[offsets] = True
        return np.flatnonzero(cut)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, offsets) for UTF-8 bytes and document offsets."""
        if not len(data):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(offsets), dtype=np.int64)
        cuts = self._cuts(data, offsets)
        if cuts[-1] != len(data):
            cuts = np.append(cuts, len(data))
        pieces = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)])
        pieces = pieces.dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        if len(self.code) > self.REMEMBER:
            self._forget()
        if new := [p for p in distinct if p not in self.code]:
            self._learn(new)
        codes = np.fromiter(map(self.code.__getitem__, distinct), np.int64, len(distinct))[pieces.indices.to_numpy()]
        lengths = self.length[codes]
        upto = np.concatenate(([0], np.cumsum(lengths)))
        place = np.arange(upto[-1]) + np.repeat(self.at[codes] - upto[:-1], lengths)
        return self.flat[place], upto[np.searchsorted(cuts, offsets)]
