"""Vectorised word and window hashes of many texts at once (numpy, inside Arrow tasks).

A word's hash is the sum of random table entries, one for each of its bytes and the byte's place in the word, so no Python code runs for each
word. Beyond PLACES bytes the entries are mixed with how often the table has been gone through. Equal hashes are not proof of equal words:
callers that need this compare the words.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Separators of the word pattern [^\x20\x09-\x0D]+
SPACES = bytes([0x20, *range(0x09, 0x0E)])
BLOCK = 1 << 20  # bytes hashed at once
SLICE = 8 << 20  # bytes of text in one table slice

PLACES = 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True


def _table(fold_ascii: bool, seed: int) -> np.ndarray:
    """An entry for each place and byte; separators have 0."""
    first = 1 + seed * PLACES * 256
    table = mix(np.arange(first, first + PLACES * 256, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)).reshape(PLACES, 256)
    if fold_ascii:
        table[:, 65:91] = table[:, 97:123]
    table[:, _IS_SPACE] = 0
    return table.reshape(-1)


_TABLES = {(fold, seed): _table(fold, seed) for fold in (False, True) for seed in (0, 1)}


def _word_hashes(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hashes of the words that start at these places of raw, which begins with the first of them and ends with the last."""
    place = np.arange(len(raw), dtype=np.int64) - np.repeat(starts, np.diff(starts, append=len(raw)))
    entries = table[((place % PLACES) << 8) | raw]
    if len(lengths) and lengths.max() > PLACES:
        far = np.flatnonzero((place >= PLACES) & (entries != 0))
        entries[far] = mix(entries[far] ^ mix((place[far] // PLACES).astype(np.uint64)))
    return mix(np.add.reduceat(entries, starts) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C55))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch that hold about `most` bytes of text each; a longer text comes alone."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    first = 0
    while first < batch.num_rows:
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(first, last - first)
        first = last


class Words:
    """Words of a column of texts. hashes: a uint64 for each word; doc: the row of each word; offsets: first word of each row, and the number of words.

    raw, starts, stops: the texts' bytes and where each word stands in them. second() gives an independent hash of each word.
    """

    def __init__(self, texts: pa.Array, fold_ascii: bool):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), texts.cast(pa.large_binary())), pa.scalar(b"\n", pa.large_binary()))[0] if n else None
        raw = np.frombuffer(joined.as_buffer(), dtype=np.uint8) if n and joined.as_buffer().size else np.zeros(0, np.uint8)
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        inside = ~_IS_SPACE[raw]
        edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
        starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.raw, self.starts, self.stops, self.fold_ascii = raw, starts, stops, fold_ascii
        self.hashes = self._hashes(0)
        self.offsets = np.concatenate(([0], np.searchsorted(starts, ends))) if n else np.zeros(1, np.int64)
        self.doc = np.repeat(np.arange(n), np.diff(self.offsets))

    def _hashes(self, seed: int) -> np.ndarray:
        out, at = np.empty(len(self.starts), np.uint64), 0
        while at < len(out):
            upto = max(at + 1, int(np.searchsorted(self.starts, self.starts[at] + BLOCK)))
            lo, hi = int(self.starts[at]), int(self.stops[upto - 1])
            first = self.starts[at:upto]
            out[at:upto] = _word_hashes(self.raw[lo:hi], first - lo, self.stops[at:upto] - first, _TABLES[self.fold_ascii, seed])
            at = upto
        return out

    def second(self) -> Words:
        """The same words under the second hash function."""
        other = copy.copy(self)
        other.hashes = self._hashes(1)
        return other

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of `size` words of one row, and the number of each window's first word."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        return self._combined(at, size), at

    def whole(self, rows: np.ndarray) -> np.ndarray:
        """One hash for each of these rows, of its whole word sequence; for rows with few words."""
        out = np.zeros(len(rows), np.uint64)
        sizes = self.offsets[rows + 1] - self.offsets[rows]
        for size in np.unique(sizes):
            mine = sizes == size
            out[mine] = self._combined(self.offsets[rows[mine]], int(size))
        return out

    def _combined(self, at: np.ndarray, size: int) -> np.ndarray:
        key = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
        total = np.full(len(at), mix(np.array([size], np.uint64))[0])
        for j in range(size):
            total += self.hashes[at + j] * key[j]
        return mix(total)
