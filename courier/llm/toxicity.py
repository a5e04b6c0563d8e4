"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, word pairs and pairs with one word between them of a text (A-Z in lower case),
hashed to 2^22 places. Training takes a bounded sample of the labelled rows, `max_toxic` and `max_clean` of them, chosen
by a hash of the id. Features whose counts tell the two kinds apart are kept; the per-coordinate rates and the L1
penalty of FTRL leave few non-zero weights, which are broadcast: 2^22 at most. Scoring reads every whole text.

Nulls: a null text is empty; an empty text scores from the bias alone. A null id keeps its row, is never held out and
never trains. Null labels don't train; of a document's several labels the largest counts. Without labelled rows
of both kinds the score is that of the bias, 0 before any training: every score is then 0.5. Rows with equal ids each
get a row; other columns are neither read nor, in `score`, returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import cut
from .words import ALNUM, Words, mix, slices, utf8

BITS = 22
#: Rows of the training sample: toxic ones at most, and others at most.
MAX_TOXIC, MAX_CLEAN = 3000, 6000
THRESHOLD = 0.7
EPOCHS = 10
#: A feature trains if its chi-square and the ratio of its rates in the two kinds reach these.
CHI_SQUARE, RATIO = 20.0, 5.0
PAIR, SKIP = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all texts, and the row of each; a feature may repeat in its row."""
    data, offsets = utf8(column)
    words = Words(data, offsets, ALNUM)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, row = words.hashes(), words.rows()
    near, far = row[1:] == row[:-1], row[2:] == row[:-2]
    pairs = mix(h[:-1] * PAIR + h[1:])[near]
    skips = mix(h[:-2] * SKIP + h[2:])[far]
    shift = np.uint64(64 - bits)
    return np.concatenate([h >> shift, pairs >> shift, skips >> shift]).astype(np.int64), np.concatenate([row, row[1:][near], row[2:][far]])


@dataclass
class Model:
    """Sorted places of the non-zero weights, their weights, and the bias."""

    places: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int = BITS

    def score(self, column: pa.Array) -> np.ndarray:
        n = len(column)
        total = np.full(n, self.bias)
        if len(self.places):
            found, row = features(column, self.bits)
            known = np.zeros(1 << self.bits, bool)
            known[self.places] = True
            hit = known[found]
            keys = np.unique(row[hit] << self.bits | found[hit])
            np.add.at(total, keys >> self.bits, self.weights[np.searchsorted(self.places, keys & ((1 << self.bits) - 1))])
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def ftrl(rows: list[tuple[int, np.ndarray]], bits: int = BITS, epochs: int = EPOCHS, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.5, l2: float = 1.0) -> Model:
    """FTRL-proximal over rows of (label, distinct features). The bias is a coordinate without penalty.

    The rarer label's gradients weigh more, by the square root of the ratio of the two.
    """
    used = np.unique(np.concatenate([np.zeros(0, np.int64), *(x for _, x in rows)]))  # arrays over these alone: the driver has no room for many of 2^bits
    rows = [(y, np.searchsorted(used, x)) for y, x in rows]
    n = np.zeros(len(used))
    z = np.zeros(len(used))
    bias = bias_n = 0.0
    toxic = sum(y for y, _ in rows)
    both = 0 < toxic < len(rows)
    weight = (1.0, ((len(rows) - toxic) / toxic) ** 0.5 if both else 1.0)
    for _ in range(epochs if both else 0):
        for y, x in rows:
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) <= l1, 0.0, -(zx - np.sign(zx) * l1) / ((beta + root) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35)))
            g = (p - y) * weight[y]
            sigma = (np.sqrt(nx + g * g) - root) / alpha
            z[x] += g - sigma * w
            n[x] = nx + g * g
            bias_n += g * g
            bias -= alpha * g / (beta + np.sqrt(bias_n))
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    at = np.flatnonzero(w)
    return Model(used[at], w[at], float(bias), bits)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def per_row(column: pa.Array, bits: int) -> Iterator[np.ndarray]:
    """The distinct features of each text."""
    found, row = features(column, bits)
    keys = np.unique(row << bits | found)
    cuts = np.searchsorted(keys, np.arange(len(column) + 1) << bits).tolist()
    low = keys & ((1 << bits) - 1)
    return (low[a:b] for a, b in zip(cuts, cuts[1:]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, bits: int = BITS) -> Model:
    """Learn from labels of rows that aren't held out. The sample has max_toxic + max_clean ids at most."""
    spark = docs.sparkSession
    usable = labels.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(label_col) > 0).cast("int").alias("y")).where("doc_id is not null and y is not null").where(~held_out())
    usable = usable.groupBy("doc_id").agg(F.max("y").alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = [(r[0], r[1]) for y, most in ((0, max_clean), (1, max_toxic)) for r in usable.where(F.col("y") == y).orderBy(*order).limit(most).collect()]
    sample = spark.createDataFrame(ids, T.StructType([T.StructField("__id", T.LongType()), T.StructField("y", T.IntegerType())]))
    texts = docs.select(F.col(id_col).cast("long").alias("__doc"), F.col(text_col).cast("string").alias("text"))
    chosen = cut(texts.join(F.broadcast(sample), F.col("__doc") == F.col("__id")).select("__id", "y", "text").dropDuplicates())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << bits), np.int32)
        for batch in batches:
            for a, b in slices(batch.column(2), 1 << 19):
                part = batch.slice(a, b - a)
                for y, x in zip(part.column(1).to_pylist(), per_row(part.column(2), bits)):
                    seen[y, x] += 1
        places = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(seen[1, places].astype(np.int64)), pa.array(seen[0, places].astype(np.int64))], ["place", "a", "b"])

    n = {r["y"]: r["count"] for r in chosen.groupBy("y").count().collect()}
    places = np.zeros(0, np.int64)
    if len(n) == 2:
        rates = chosen.mapInArrow(count, "place long, a long, b long").groupBy("place").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a + b >= 2")
        both = F.lit(float(n[0] + n[1]))
        share = (F.col("a") + F.col("b")) / both
        gap = F.col("a") / F.lit(float(n[1])) - F.col("b") / F.lit(float(n[0]))
        chi = gap * gap / (share * (1 - share) * F.lit(1 / n[0] + 1 / n[1]))
        high, low = (F.col("a") + 0.5) / F.lit(n[1] + 1.0), (F.col("b") + 0.5) / F.lit(n[0] + 1.0)
        kept = rates.where(share < 1).where((chi >= CHI_SQUARE) & (F.greatest(high / low, low / high) >= RATIO))
        places = np.array(sorted(r[0] for r in kept.select("place").collect()), np.int64)  # 2^bits at most
    use = np.zeros(1 << bits, bool)
    use[places] = True

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(2), 1 << 19):
                part = batch.slice(a, b - a)
                packed = [x[use[x]].astype("<i4").tobytes() for x in per_row(part.column(2), bits)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(packed, pa.binary())], ["id", "y", "features"])

    rows = [(r["id"], r["y"], np.frombuffer(r["features"], "<i4")) for r in chosen.mapInArrow(pick, "id long, y int, features binary").collect()]
    rows.sort(key=lambda r: (int(mix(np.array([r[0]], np.int64).view(np.uint64))[0]), r[0], r[2].tobytes()))
    return ftrl([(y, x) for _, y, x in rows], bits)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 19):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sent.value.score(part.column(1)))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at, names = docs.columns.index(text_col), [f"c{i}" for i in range(len(docs.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(at), 1 << 19):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(sent.value.score(part.column(at)) < threshold))

    plain = docs.toDF(*names)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
