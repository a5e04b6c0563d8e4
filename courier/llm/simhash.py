"""SimHash near-duplicates: fingerprints of word shingles, linked by meet-in-the-middle ball hashing.

Two fingerprints differ in at most r bits if and only if some value lies within r/2 bits of both. So every distinct
fingerprint emits all variants within half the radius, variants meet, and those that meet are verified and linked.

A fingerprint has 2,081 variants at radius 4. They are not shuffled one by one: a variant's leading bits are its
bucket, and a fingerprint goes once to each bucket that holds some of its variants; the bucket's task writes them
out, sorts them and links what meets. Each bucket returns a spanning forest, never all pairs.

Nulls: a null text is empty; texts without words have fingerprint zero and are linked like any other. Rows with
equal ids each get a row. A null id keeps its row and takes no part in the smallest id (its component is that of its
fingerprint, null if only null ids are in it). Only the id and text columns are read; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import components, cut, partitions
from .words import LOWER, NOT_SPACE, Words, slices, utf8

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Variants of one bucket, on average; and those that a task writes out at once, beyond which it takes a bucket in parts.
BUCKET_VARIANTS = 2_000_000
MOST_VARIANTS = 8_000_000
#: Shingles whose bits are counted at once.
COUNTED = 1 << 17
#: Fingerprints with their buckets (16 bytes each) that one shuffle partition holds.
PART_ROWS = 16_000_000


def fingerprints_of(column: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """A 64-bit SimHash for each text of the column."""
    data, offsets = utf8(column)
    words = Words(data, offsets, NOT_SPACE)
    n = len(offsets) - 1
    counts = np.diff(words.first)
    out = np.zeros(n, np.uint64)
    if not len(words):
        return out
    keep = words.inside.copy()
    after = words.ends[words.ends < len(data)]
    keep[after] = True
    text = np.where(words.inside, LOWER[data], np.uint8(0x20))[keep].tobytes()
    place = np.cumsum(keep) - 1
    starts, ends = place[words.starts], place[words.ends - 1] + 1
    per_row = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    row_of = np.repeat(np.arange(n), per_row)
    head = np.cumsum(per_row) - per_row
    at = words.first[row_of] + np.arange(len(row_of)) - head[row_of]
    last = np.minimum(at + shingle, words.first[row_of + 1]) - 1
    digest = xxhash.xxh64_intdigest
    rows = np.flatnonzero(per_row)
    ones = np.zeros((len(rows), 64), np.int64)
    for i in range(0, len(at), COUNTED):
        a, b = starts[at[i : i + COUNTED]].tolist(), ends[last[i : i + COUNTED]].tolist()
        hashes = np.fromiter((digest(text[x:y], SEED) for x, y in zip(a, b)), np.uint64, len(a))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own, first = np.unique(row_of[i : i + COUNTED], return_index=True)
        ones[np.searchsorted(rows, own)] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    majority = ones * 2 > per_row[rows][:, None]
    out[rows] = np.packbits(majority, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 19):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints_of(part.column(1), shingle).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


@lru_cache(256)
def flips(bits: int, most: int, low: int = 0) -> np.ndarray:
    """Masks of up to `most` of the `bits` bits from bit `low` on, with the empty one first."""
    return np.array([sum(1 << (low + i) for i in c) for k in range(most + 1) for c in combinations(range(bits), k)], np.uint64)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            hop = new[new]
            if np.array_equal(hop, new):
                break
            new = hop
        if np.array_equal(new, label):
            return label
        label = new


def linked_in_bucket(bucket: int, found: np.ndarray, prefix: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints with variants in the bucket -> (fingerprint, smallest one of its group here) for all that aren't alone."""
    half, low_bits = (radius + 1) // 2, 64 - prefix
    found = np.unique(found)
    moved = np.bitwise_count((found >> np.uint64(low_bits)) ^ np.uint64(bucket)) if prefix else np.zeros(len(found), np.uint8)
    suffix_mask = np.uint64((1 << low_bits) - 1) if low_bits < 64 else np.uint64(0xFFFFFFFFFFFFFFFF)
    counts = np.bincount(moved, minlength=half + 1)
    if low_bits > 8 and sum(int(counts[j]) * len(flips(low_bits, half - j)) for j in range(half + 1)) > MOST_VARIANTS:
        # a dense neighbourhood: its buckets of a longer prefix, one after another
        parts = []
        for sub in range(bucket << 4, (bucket + 1) << 4):
            near = found[np.bitwise_count((found >> np.uint64(low_bits - 4)) ^ np.uint64(sub)) <= half]
            if len(near) > 1:
                parts.append(linked_in_bucket(sub, near, prefix + 4, radius))
        a, b = (np.searchsorted(found, np.concatenate(x)) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2
        root = forest(len(found), a, b)
        others = np.flatnonzero(root != np.arange(len(found)))
        return found[others], found[root[others]]
    values, owners = [], []
    for j in range(half + 1):
        own = np.flatnonzero(moved == j)
        if len(own):
            masks = flips(low_bits, half - j)
            values.append(((found[own] & suffix_mask)[:, None] ^ masks[None, :]).ravel())
            owners.append(np.repeat(own.astype(np.int32), len(masks)))
    values, owners = np.concatenate(values), np.concatenate(owners)
    order = np.argsort(values)
    values, owners = values[order], owners[order]
    same = values[1:] == values[:-1]
    a, b = owners[:-1][same], owners[1:][same]
    near = np.bitwise_count(found[a] ^ found[b]) <= radius
    pairs = np.unique(np.minimum(a, b)[near].astype(np.int64) << 32 | np.maximum(a, b)[near])
    root = forest(len(found), pairs >> 32, pairs & 0xFFFFFFFF)
    others = np.flatnonzero(root != np.arange(len(found)))
    return found[others], found[root[others]]


def links(fps: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints (column fp) -> (a, b): links whose components are those of all pairs within the radius.

    The bucket's prefix grows with the number of fingerprints n, so that a bucket's variants fit a task.
    """
    half = (radius + 1) // 2
    each = len(flips(64, half))
    prefix = min(24, max(8, int(np.ceil(np.log2(max(1, n * each / BUCKET_VARIANTS))))))
    masks = [int(m) for m in flips(prefix, half)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(bucket: int, parts: list[np.ndarray]) -> pa.RecordBatch:
            a, b = linked_in_bucket(bucket, np.concatenate(parts).view(np.uint64), prefix, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        now, parts = None, []
        for batch in batches:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for i, j in zip(edges, edges[1:]):
                if i == j:
                    continue
                if parts and keys[i] != now:
                    yield close(now, parts)
                    parts = []
                now = int(keys[i])
                parts.append(fps[i:j])
        if parts:
            yield close(now, parts)

    own = F.shiftrightunsigned("fp", 64 - prefix)
    spread = fps.select("fp", F.explode(F.transform(F.lit(masks).cast("array<long>"), lambda m: own.bitwiseXOR(m))).alias("bucket"))
    parts = partitions(fps.sparkSession, n * len(masks), PART_ROWS)
    dealt = spread.select("bucket", "fp").repartition(parts, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp long, component_id) for each row: its fingerprint and the smallest id that its links reach."""
    prints = cut(fingerprints(docs, id_col, text_col, shingle))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    n = distinct.count()
    roots = components(links(distinct.select("fp"), n, radius), "a", "b")
    member = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    member = cut(member)
    least = cut(member.groupBy("root").agg(F.min("least").alias("component_id")))
    of = cut(member.join(least, "root").select("fp", "component_id"))
    return prints.join(of, "fp", "left").select("doc_id", "fp", "component_id")


def hex16(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each group stays: that with the smallest id. Rows that repeat an id whole stay together."""
    found = near_duplicates(docs, id_col, text_col, shingle, radius)
    stay = cut(found.where("doc_id = component_id").select(F.col("doc_id").alias("__stay")).distinct())
    own = F.col(f"`{id_col}`")
    kept = docs.join(stay, own.cast("long") == F.col("__stay"), "left").where(F.col("__stay").isNotNull() | own.isNull())
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
