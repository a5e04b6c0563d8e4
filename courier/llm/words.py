"""Words of whole Arrow text batches as numpy arrays: positions, rows, exact numbers and hashes, with no Python per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
BASE = np.uint64(0x9E3779B97F4A7C55)
#: Words hashed at once.
HASHED = 1 << 17
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the n + 1 offsets; a null row is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes together, or of one row."""
    lengths = pc.fill_null(pc.binary_length(column.cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def pieces(data: np.ndarray, kind: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of the bytes, of at most `limit` each where words allow it: a range ends behind a byte outside of `kind`, so in no word."""
    start = 0
    while len(data) - start > limit:
        outside = np.flatnonzero(~kind[data[start : start + limit]])
        at = start + limit
        while not len(outside) and at < len(data):
            outside = np.flatnonzero(~kind[data[at : at + limit]]) + (at - start)
            at += limit
        if not len(outside):
            break
        end = start + int(outside[-1 if at == start + limit else 0]) + 1
        yield start, end
        start = end
    if start < len(data):
        yield start, len(data)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Words:
    """Maximal runs of bytes of a class in each row. `first` has n + 1 entries: the words of row r are first[r]:first[r + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
        inside = kind[data]
        opens = np.zeros(len(data) + 1, bool)
        opens[offsets] = True
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        self.starts = np.flatnonzero(inside & (~before | opens[:-1]))
        self.ends = np.flatnonzero(inside & (~after | opens[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.data, self.inside = data, inside

    def __len__(self) -> int:
        return len(self.starts)

    def distinct(self, letters: np.ndarray = LOWER) -> tuple[np.ndarray, list[bytes]]:
        """The number of each word, and the distinct words by number. Words are one if their bytes are, by default with A-Z in lower case."""
        raw = letters[self.data[self.inside]]
        ends = np.append(0, np.cumsum(self.ends - self.starts)).astype(np.int64)
        array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
        found = array.dictionary_encode()
        _, ends, raw = found.dictionary.buffers()
        ends, raw = np.frombuffer(ends, np.int64)[: len(found.dictionary) + 1].tolist(), raw.to_pybytes() if raw else b""
        return found.indices.to_numpy(), [raw[a:b] for a, b in zip(ends, ends[1:])]

    def hashes(self, letters: np.ndarray = LOWER) -> np.ndarray:
        """A 64-bit hash of each word: for features only, as different words may share one."""
        size = self.ends - self.starts
        power = np.full(int(size.max(initial=0)) + 1, BASE, np.uint64)
        power[0] = 1
        power = np.cumprod(power, dtype=np.uint64)
        out = np.zeros(len(self), np.uint64)
        for a in range(0, len(self), HASHED):  # some tens of bytes for each byte of these words
            own = size[a : a + HASHED]
            stop = np.cumsum(own)
            first, last = self.starts[a], self.ends[a + len(own) - 1]
            raw = letters[self.data[first:last][self.inside[first:last]]].astype(np.uint64) + np.uint64(1)
            raw *= power[np.arange(len(raw)) - np.repeat(stop - own, own)]
            total = np.append(np.uint64(0), np.cumsum(raw, dtype=np.uint64))
            out[a : a + HASHED] = total[stop] - total[stop - own]
        return mix(out)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
