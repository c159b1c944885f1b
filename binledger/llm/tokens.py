"""Token ids of many texts, from a public tokenizer file, encoding each distinct chunk once.

A byte-level BPE splits a text into pieces that hold at most the one space before them, and
what follows a piece does not change it. So a text may be parted before any run of white space that
follows a visible character, and every part (white space and the word after it) encoded by itself:
the ids, put together again, are those of the whole text. Tests hold this against the
tokenizer on whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from binledger.llm.words import SEPARATOR, hash_runs, text_bytes

VOCABULARY = "byte_bpe_50k.json"
#: Distinct chunks a worker remembers before it starts anew; bounds memory, changes no result.
REMEMBERED = 800_000

_encoders: dict[str, "Encoder"] = {}


def encoder(path: str | None = None) -> "Encoder":
    """This process's encoder for a vocabulary file (default: the public 50k byte BPE)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder:
    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        #: Sorted hashes of chunks and where their ids are, in a large part and a recent one.
        self._parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64)) for _ in range(2)]
        self._n, self._first = 0, np.zeros(1 << 16, np.int64)
        self._ids = np.zeros(1 << 18, np.uint32)

    def _learn(self, hashes: np.ndarray, chunks: pa.Array) -> None:
        words, lengths, flat = chunks.to_pylist(), [], []
        for i in range(0, len(words), 8192):
            some = words[i : i + 8192]
            made = self._tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            flat.append(np.array(made.ids, np.uint32))
            lengths.append(np.bincount(np.array(made.word_ids, np.int64), minlength=len(some)))
        flat, lengths = np.concatenate(flat), np.concatenate(lengths)
        n, end = self._n, int(self._first[self._n])
        while len(self._first) <= n + len(words):
            self._first = np.concatenate([self._first, np.zeros_like(self._first)])
        while len(self._ids) < end + len(flat):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        self._first[n + 1 : n + 1 + len(words)] = end + np.cumsum(lengths)
        self._ids[end : end + len(flat)] = flat
        self._n = n + len(words)
        (large, place), recent = self._parts[0], self._merged(self._parts[1], (hashes, n + np.arange(len(words))))
        if 4 * len(recent[0]) > len(large):
            self._parts = [self._merged((large, place), recent), (np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        else:
            self._parts[1] = recent

    @staticmethod
    def _merged(a, b):
        known, place = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        order = np.argsort(known, kind="stable")
        return known[order], place[order]

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        """Where each chunk's ids are, -1 if it is not known."""
        out = np.full(len(hashes), -1, np.int64)
        for known, place in self._parts:
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                out = np.where(known[at] == hashes, place[at], out)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the offset of each text (one more than texts); null is empty."""
        data, offsets = text_bytes(texts)
        starts, ends, first = _chunks(data, offsets)
        hashes = hash_runs(data, starts, ends)
        if self._n > REMEMBERED:
            self._forget()
        distinct, example, each = np.unique(hashes, return_index=True, return_inverse=True)
        new = self._places(distinct) < 0
        if new.any():
            pick = example[new]
            lengths = ends[pick] - starts[pick]
            before = np.cumsum(lengths) - lengths
            body = data[np.repeat(starts[pick] - before, lengths) + np.arange(int(lengths.sum()))]
            chunks = pa.Array.from_buffers(
                pa.large_string(), len(pick), [None, pa.py_buffer(np.append(before, lengths.sum()).astype(np.int64)), pa.py_buffer(body)]
            )
            self._learn(distinct[new], chunks)
        if not len(hashes):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        slot = self._places(distinct)[each]
        n = self._first[slot + 1] - self._first[slot]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self._ids[np.repeat(self._first[slot] - total[:-1], n) + np.arange(int(total[-1]))]
        return ids, total[first]


def _chunks(data: np.ndarray, offsets: np.ndarray):
    """Chunks that begin at a text's start or at white space after a visible character."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    begin = np.zeros(len(data) + 1, bool)
    visible = ~SEPARATOR[data[:-1]] & (data[:-1] > 0x20) & (data[:-1] < 0x7F)
    if len(data) > 2:  # a letter of U+00C0-U+00FF also counts; other bytes may end a Unicode space
        visible[1:] |= (data[:-2] == 0xC3) & (data[1:-1] >= 0x80)
    begin[1:-1] = SEPARATOR[data[1:]] & visible
    begin[offsets[:-1]] = True
    begin[-1] = False
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(data))
    return starts, ends, np.searchsorted(starts, offsets)
