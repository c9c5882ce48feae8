"""Vectorised word hashing over Arrow string columns.

The near-duplicate and repeated-phrase operators need a hash of every word and of
every run of k words of very many texts.  Doing that a word at a time in Python is
slow, so the helpers here work on the UTF-8 bytes of a whole slice of an Arrow
batch at once.  A word is a maximal run of bytes other than space, tab, LF, VT, FF
and CR; in UTF-8 none of these bytes is ever part of a longer character.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_U = np.uint64
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: a bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def hash_keys(seed: int, n: int) -> np.ndarray:
    """n pseudo-random odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


_BYTE_VALUE = hash_keys(11, 256)
_BASE = int(0xD1342543DE82EF95)
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each; those of a usual slice are kept."""
    global _powers
    if _powers is not None and n <= len(_powers[0]):
        return _powers
    usual = SLICE_BYTES + (SLICE_BYTES >> 1)
    tables = []
    for step in (_BASE, _INVERSE):
        t = np.full(max(n, usual), step, _U)
        t[0] = 1
        tables.append(np.cumprod(t, dtype=_U))
    if n <= usual:
        _powers = (tables[0], tables[1])
    return tables[0], tables[1]


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Hands freed memory back to the machine; a Python worker outlives its task and keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


class Words:
    """The words of n texts: byte spans, hashes, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        n = len(offsets) - 1
        size = len(data)
        if size:
            word = ~_SEPARATOR[data]
            fresh = np.zeros(size + 1, bool)
            fresh[offsets] = True
            before = np.empty(size, bool)
            before[0] = False
            before[1:] = word[:-1]
            self.start = np.flatnonzero(word & (~before | fresh[:-1]))
            after = np.empty(size, bool)
            after[-1] = False
            after[:-1] = word[1:]
            self.end = np.flatnonzero(word & (~after | fresh[1:])) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        #: first[i]:first[i + 1] are the words of text i.
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)
        self.n = n
        if len(self.start):
            up, down = _power_table(size + 1)
            total = np.zeros(size + 1, _U)
            np.cumsum(_BYTE_VALUE[data] * up[:size], out=total[1:])
            self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(_U))
        else:
            self.hash = np.zeros(0, _U)

    def text_of_words(self) -> np.ndarray:
        """For each word the index of its text."""
        return np.repeat(np.arange(self.n), self.counts)

    def run_hash(self, k: int, seed: int = 0) -> np.ndarray:
        """Hash of the k words from each word on; only starts given by run_starts are meaningful."""
        m = len(self.hash)
        if m < k:
            return np.zeros(0, _U)
        keys = hash_keys(1000 + seed, k)
        out = np.zeros(m - k + 1, _U)
        for j in range(k):
            out += self.hash[j : m - k + 1 + j] * keys[j]
        return mix(out)

    def prefix(self, salt: int = 0) -> np.ndarray:
        """Prefix sums of a polynomial over the word hashes; another salt, another hash."""
        m = len(self.hash)
        total = np.zeros(m + 1, _U)
        np.cumsum((mix(self.hash ^ _U(salt)) if salt else self.hash) * _power_table(m + 1)[0][:m], out=total[1:])
        return total

    def span_hash(self, total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words start:end, the same wherever they stand."""
        return mix((total[end] - total[start]) * _power_table(len(total))[1][start])

    def rolling_hash(self, k: int, salt: int = 0) -> np.ndarray:
        """As run_hash, in time that does not grow with k."""
        m = len(self.hash)
        if m < k:
            return np.zeros(0, _U)
        total = self.prefix(salt)
        return mix((total[k:] - total[:-k]) * _power_table(m + 1)[1][: m - k + 1])

    def text_hash(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of each text's whole sequence of words."""
        down = _power_table(len(self.hash) + 1)[1]
        out = []
        for salt in (0, 0x2545F4914F6CDD1D):
            total = self.prefix(salt)
            out.append(mix((total[self.first[1:]] - total[self.first[:-1]]) * down[self.first[:-1]] + self.counts.astype(_U) * _U(0x9E3779B97F4A7C15)))
        return out[0], out[1]

    def run_starts(self, k: int) -> np.ndarray:
        """Mask over len(hash) - k + 1 starts: the k words lie in one text."""
        m = len(self.hash)
        if m < k:
            return np.zeros(0, bool)
        t = self.text_of_words()
        return t[: m - k + 1] == t[k - 1 :]


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a slice holds about limit bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        i = batch.schema.get_field_index(column)
        _, offsets = texts_of(batch.column(i))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
        del batch
        give_back()
