"""Words, windows and 64-bit hashes of Arrow text columns, computed with NumPy over whole batches.

Texts stay UTF-8 bytes. Both word classes used here are unions of byte classes (every byte of a
non-ASCII character is >= 0x80), so a table look-up per byte finds the same words as the regular
expressions of the contracts. Work is cut into slices of a few megabytes, so memory does not follow
the size of an Arrow batch; one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
SLICE_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection on 64-bit words."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_GOLDEN = 0x9E3779B97F4A7C15
#: A random 64-bit value for each byte, from the splitmix64 sequence.
BYTE_VALUES = mix(np.arange(1, 257, dtype=_U) * _U(_GOLDEN))
_BASE = _U(0xD6E8FEB86659FD93)
_STEP = _U(0xA24BAED4963EE407)
_powers = np.ones(1, _U)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base modulo 2^64."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 1 << 16), _BASE, _U)
        grown[0] = 1
        _powers = np.cumprod(grown, dtype=_U)
    return _powers[:n]


def _table(separator) -> np.ndarray:
    return np.array([not separator(b) for b in range(256)])


#: True for bytes that belong to words. space: `[^\x20\x09-\x0D]+`; alnum: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
CLASSES = {
    "space": _table(lambda b: b == 0x20 or 0x09 <= b <= 0x0D),
    "alnum": _table(lambda b: b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F),
}
#: Maps A-Z to a-z and keeps every other byte.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of the texts in them); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, ends, data = texts.buffers()
    at = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold about `most` bytes, or one text if that is longer."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, end - start)
        start = end
    pa.default_memory_pool().release_unused()


class Words:
    """Words of all texts of a column.

    starts, ends: byte positions of each word; rows: index of the first word of each text, and the
    number of words at the end; data: the bytes, lower-cased if asked for.
    """

    def __init__(self, texts: pa.Array, kind: str = "space", lower: bool = True):
        raw, at = text_bytes(texts)
        self.data = LOWER[raw] if lower else raw
        self.at = at
        n = len(raw)
        inside = np.zeros(n + 1, bool)
        inside[:n] = CLASSES[kind][self.data]
        edge = np.empty(n + 1, bool)
        edge[0] = inside[0]
        np.not_equal(inside[1:], inside[:-1], out=edge[1:])
        # a word also ends where its text ends
        inner = at[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        joined = inner[inside[inner] & inside[inner - 1]]
        flips = np.flatnonzero(edge)
        if len(joined):
            joined = np.unique(joined)
            flips = np.sort(np.concatenate([flips, joined, joined]), kind="stable")
        self.starts, self.ends = flips[0::2], flips[1::2]
        self.rows = np.searchsorted(self.starts, at, "left")
        self._inside = inside

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.starts):
            return np.zeros(0, _U)
        first = self.starts[0]
        gaps = np.diff(np.append(self.starts, len(self.data)))
        place = np.arange(first, len(self.data)) - np.repeat(self.starts, gaps)
        values = BYTE_VALUES[self.data[first:]]
        values *= powers(int(place.max()) + 1)[place]
        values[~self._inside[first:-1]] = 0
        sums = np.add.reduceat(values, self.starts - first)
        return mix(sums + (self.ends - self.starts).astype(_U) * _STEP)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def windows(self, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(first word, text) of each window of k words within a text; short: a text of fewer words, but not none, counts as one window."""
        counts = self.counts
        n = np.maximum(counts - k + 1, 0)
        if short:
            n = np.where((counts > 0) & (n == 0), 1, n)
        row = np.repeat(np.arange(len(counts)), n)
        within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        return self.rows[:-1][row] + within, row


def join_hashes(hashes: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k word hashes from each position of `first` on."""
    acc = np.full(len(first), k, _U)
    for j in range(k):
        acc *= _STEP
        acc += hashes[first + j]
        acc ^= acc >> _U(29)
        acc *= _BASE
    return mix(acc)


def shingles(words: Words, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets by text): the distinct shingles of k words of each text in ascending order of hash; fewer words are one shingle."""
    first, row = words.windows(k)
    out = join_hashes(hashes, first, k)
    counts = words.counts
    for n in range(1, k):
        few = np.flatnonzero(counts == n)
        if len(few):
            row = np.concatenate([row, few])
            out = np.concatenate([out, join_hashes(hashes, words.rows[:-1][few], n)])
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    out, row = out[keep], row[keep]
    return out, np.searchsorted(row, np.arange(len(counts) + 1))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
