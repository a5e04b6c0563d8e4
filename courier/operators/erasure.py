"""Reed-Solomon shards over GF(2^8): any k of k + m restore a record."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Fixed value: the field's reducing polynomial.
POLYNOMIAL = 0x11D


def _products() -> np.ndarray:
    """The 256 x 256 multiplication table: carry-less products reduced by the polynomial, bit by bit."""
    a = np.arange(256, dtype=np.uint32)[:, None] + np.zeros((1, 256), np.uint32)
    b, out = a.T.copy(), np.zeros((256, 256), np.uint32)
    for _ in range(8):
        out ^= np.where(b & 1, a, 0)
        b >>= 1
        a = np.where(a & 0x80, (a << 1) ^ POLYNOMIAL, a << 1)
    return out.astype(np.uint8)


PRODUCT = _products()
INVERSE = np.append(np.uint8(0), np.argmax(PRODUCT[1:] == 1, axis=1).astype(np.uint8))


def times(matrix: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The matrix product over the field."""
    out = np.zeros((len(matrix), rows.shape[1]), np.uint8)
    for i, line in enumerate(matrix):
        for c, row in zip(line, rows):
            out[i] ^= PRODUCT[c][row]
    return out


def inverted(matrix: np.ndarray) -> np.ndarray:
    """By elimination on the matrix beside the identity."""
    n = len(matrix)
    work = np.concatenate([matrix, np.eye(n, dtype=np.uint8)], axis=1)
    for col in range(n):
        pivot = col + int(np.flatnonzero(work[col:, col])[0])
        work[[col, pivot]] = work[[pivot, col]]
        work[col] = PRODUCT[INVERSE[work[col, col]]][work[col]]
        for row in range(n):
            if row != col and work[row, col]:
                work[row] ^= PRODUCT[work[row, col]][work[col]]
    return work[:, n:]


class Code:
    """k data and m parity shards; parity rows are a Cauchy matrix 1 / (i xor (m + j))."""

    def __init__(self, k: int, m: int):
        if k < 1 or m < 1 or k + m > 255:
            raise ValueError("need k >= 1, m >= 1 and k + m <= 255")
        self.k, self.m = k, m
        self.parity = INVERSE[np.arange(m)[:, None] ^ (m + np.arange(k))[None, :]]
        self.rows = np.concatenate([np.eye(k, dtype=np.uint8), self.parity])

    @property
    def overhead(self) -> float:
        return (self.k + self.m) / self.k

    def encode(self, data: bytes) -> list[bytes]:
        """Equal shards, the last of the data ones padded with zeros; an empty record has shards of one zero byte."""
        size = max(1, -(-len(data) // self.k))
        rows = np.frombuffer(data.ljust(size * self.k, b"\0"), np.uint8).reshape(self.k, size)
        return [r.tobytes() for r in np.concatenate([rows, times(self.parity, rows)])]

    def restore(self, shards: dict[int, bytes], length: int) -> bytes | None:
        """The record from any k shards; None if fewer are left."""
        if len(shards) < self.k:
            return None
        use = tuple(sorted(shards)[: self.k])
        rows = np.stack([np.frombuffer(shards[i], np.uint8) for i in use])
        if use[-1] < self.k:  # all data shards are there
            return rows.tobytes()[:length]
        return times(_solver(self.k, self.m, use), rows).tobytes()[:length]


@lru_cache(4096)
def _solver(k: int, m: int, use: tuple[int, ...]) -> np.ndarray:
    return inverted(Code(k, m).rows[list(use)])


def encode(records: DataFrame, code: Code, key: str = "id", value: str = "value") -> DataFrame:
    """(id, idx, bytes, orig_len): the shards of each record."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for a in range(0, len(part), 256):
                own = part.iloc[a : a + 256]
                rows = [(i, n, s, len(v)) for i, v in zip(own[key], own[value]) if v is not None for n, s in enumerate(code.encode(bytes(v)))]
                yield pd.DataFrame(rows, columns=["id", "idx", "bytes", "orig_len"])

    kind = records.schema[key].dataType.simpleString()
    return records.select(key, records[value].cast("binary").alias(value)).mapInPandas(run, f"id {kind}, idx int, bytes binary, orig_len long")


def restore(shards: DataFrame, code: Code) -> DataFrame:
    """(id, value) of each record; value is null where too few shards are left. A record's shards are k + m at most."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            values = [code.restore({int(s["idx"]): bytes(s["bytes"]) for s in own}, int(n)) for own, n in zip(part["shards"], part["orig_len"])]
            yield pd.DataFrame({"id": part["id"], "value": values})

    together = shards.groupBy("id").agg(F.collect_set(F.struct("idx", "bytes")).alias("shards"), F.max("orig_len").alias("orig_len"))
    kind = shards.schema["id"].dataType.simpleString()
    return together.mapInPandas(run, f"id {kind}, value binary")
