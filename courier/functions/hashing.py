"""Hashes, checksums and byte codecs that Spark lacks, vectorised; and those that compose from built-ins."""

from __future__ import annotations

import hashlib
import hmac as _hmac
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# FNV-1a 64, the 64-bit finalizer, and the reversed Castagnoli polynomial.
FNV_OFFSET, FNV_PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)
MIX_A, MIX_B, MIX_SHIFT = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)
CASTAGNOLI = 0x82F63B78


def _bytes(value: object) -> bytes:
    return b"" if value is None else value.encode() if isinstance(value, str) else bytes(value)


def joined(values: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All values' bytes in one array, where each begins, and how long it is; nulls are empty."""
    raw = [_bytes(v) for v in values]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum(lengths) - lengths, lengths


def fnv1a(values: pd.Series) -> np.ndarray:
    """FNV-1a of each value's bytes: the next byte of all values that have one, at a time."""
    data, starts, lengths = joined(values)
    out = np.full(len(lengths), FNV_OFFSET, np.uint64)
    order = np.argsort(-lengths, kind="stable")
    left = len(lengths)
    for i in range(int(lengths.max(initial=0))):
        while lengths[order[left - 1]] <= i:
            left -= 1
        own = order[:left]
        out[own] = (out[own] ^ data[starts[own] + i].astype(np.uint64)) * FNV_PRIME
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        for factor in (MIX_A, MIX_B):
            x = (x ^ (x >> MIX_SHIFT)) * factor
        return x ^ (x >> MIX_SHIFT)


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(CASTAGNOLI), t >> np.uint32(1))
    return t


CRC_TABLE = _crc_table()


#: Bytes of a value that one lane takes; the lanes of all values go on together.
LANE = 256


def _skip_tables() -> np.ndarray:
    """What LANE zero bytes make of a checksum, for each of its four bytes."""
    c = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    for _ in range(LANE):
        c = CRC_TABLE[c & np.uint32(0xFF)] ^ (c >> np.uint32(8))
    return c


SKIP = _skip_tables()


def crc32c_values(values: pd.Series) -> np.ndarray:
    """CRC-32C of each value. Values are cut into lanes, which are summed side by side; a checksum is linear, so that of
    a value is put together from those of its lanes. Zeros before a value change nothing: the first lane is filled up with them."""
    data, starts, lengths = joined(values)
    lanes = np.maximum(1, -(-(lengths + 4) // LANE))  # with room for the initial value, four bytes before the value's own
    ends = np.cumsum(lanes)
    if not len(lengths):
        return np.zeros(0, np.uint32)
    padded = np.zeros(int(ends[-1]) * LANE + 4, np.uint8)
    stop = ends * LANE
    at = np.repeat(stop - lengths - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(data))
    padded[at] = data
    # the register begins with all ones: its bytes meet the value's first four, or what follows a shorter value
    first = (stop - lengths)[:, None] + np.arange(4)
    inside = first < stop[:, None]
    padded[first[inside]] ^= np.uint8(0xFF)
    rows = padded[:-4].reshape(-1, LANE)
    sums = np.zeros(len(rows), np.uint32)
    for i in range(LANE):
        sums = CRC_TABLE[(sums ^ rows[:, i]) & np.uint32(0xFF)] ^ (sums >> np.uint32(8))
    out, begin = np.zeros(len(lengths), np.uint32), ends - lanes
    order = np.argsort(-lanes, kind="stable")
    left = len(lanes)
    for k in range(int(lanes.max())):
        while lanes[order[left - 1]] <= k:
            left -= 1
        own = order[:left]
        c = out[own]
        c = SKIP[0][c & np.uint32(0xFF)] ^ SKIP[1][(c >> np.uint32(8)) & np.uint32(0xFF)] ^ SKIP[2][(c >> np.uint32(16)) & np.uint32(0xFF)] ^ SKIP[3][c >> np.uint32(24)]
        out[own] = c ^ sums[begin[own] + k]
    for n in range(4):  # ones that a short value leaves in the register
        short = lengths == n
        out[short] ^= np.uint32(0xFFFFFFFF) >> np.uint32(8 * n)
    return out ^ np.uint32(0xFFFFFFFF)


def crc32c_bytes(data: bytes) -> int:
    return int(crc32c_values(pd.Series([data]))[0])


@F.pandas_udf(T.LongType())
def crc32c(values: pd.Series) -> pd.Series:
    """CRC-32C of binary or string values; null for null."""
    return pd.Series(crc32c_values(values).astype(np.int64), dtype="Int64").mask(values.isna().to_numpy())


@F.pandas_udf(T.DecimalType(20, 0))
def fnv1a_64(values: pd.Series) -> pd.Series:
    from decimal import Decimal

    return pd.Series([Decimal(int(x)) for x in fnv1a(values)])


def sha256_hex(value: Column) -> Column:
    """The content address of a record."""
    return F.sha2(value.cast("binary"), 256)


def sha256_of(*parts: Column) -> Column:
    """SHA-256 of the concatenated parts, as binary."""
    return F.unhex(F.sha2(F.concat(*[p.cast("binary") for p in parts]), 256))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA-256 from two nested digests, as lower-case hex."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.unhex(F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in block)), message.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in block)), inner), 256)


def hmac_bytes(key: bytes, message: bytes) -> bytes:
    return _hmac.new(key, message, hashlib.sha256).digest()


def le64(number: Column) -> Column:
    """A long as eight little-endian bytes."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(number.cast("long"), 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(8)]))


def be(number: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(number.cast("long").bitwiseAND(F.lit((1 << (8 * size)) - 1 if size < 8 else -1))), 2 * size, "0"))


def copy_escape(text: Column) -> Column:
    """Backslash, tab, line feed and carriage return as COPY text writes them; the backslash first."""
    pairs = (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"))
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def strip_cr(text: Column) -> Column:
    return F.when(F.endswith(text, F.lit("\r")), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)


def zigzag(number: Column) -> Column:
    n = number.cast("long")
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def unzigzag(number: Column) -> Column:
    n = number.cast("long")
    return F.shiftrightunsigned(n, 1).bitwiseXOR(-(n.bitwiseAND(F.lit(1).cast("long"))))
