"""Exact nearest neighbours by cosine: a block matrix join of int8 tiles with error bounds.

Queries and candidates are dealt to tiles of bounded size, each query block with each candidate block once. A task
quantises both sides of its tile to int8, multiplies them (exactly, as the sums stay below 2^24 in float32), and
bounds each cosine by the quantisation residues. Pairs whose upper bound reaches the query's k-th best lower bound
survive and are computed again in double precision on the original vectors; bounded heaps merge the tiles' answers.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, and neither do null ids;
vectors meet only those of their own length. Rows that repeat an id are candidates of their own (a row is never a
neighbour of a row with the same id) and repeated queries are answered once. Ties go to the smaller id. Empty
tables give an empty result; other columns don't matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import partitions

K = 5
QUERY_BLOCK = 8192
#: Candidates of a block: enough blocks for a thousand tasks, within these sizes.
LEAST_BLOCK, MOST_BLOCK = 1024, 65536
#: Bytes of the longest vectors that either side of a tile holds at most, as doubles; a tile takes some four times that.
BLOCK_BYTES = 32 << 20
#: Tiles' answers (24 bytes each) that one shuffle partition holds.
PART_ROWS = 16_000_000
#: Pairs that one product holds at once.
PAIRS = 1 << 21


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows -> int8 values as float32, the scale of each row, and the length of what rounding leaves."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None])
    left = np.sqrt(((x - q * scale[:, None]) ** 2).sum(axis=1))
    return q.astype(np.float32), scale, left


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of row pairs in double precision, summed in the order of the components.

    Rows are scaled by powers of two first: this changes no digit, and squares neither overflow nor vanish.
    """
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None]) for x in (a, b))
    dot, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for i in range(a.shape[1]):
        dot += a[:, i] * b[:, i]
        aa += a[:, i] * a[:, i]
        bb += b[:, i] * b[:, i]
    return dot / (np.sqrt(aa) * np.sqrt(bb))


def tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query in one tile: (query id, candidate id, score)."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(q_ids[:0], c_ids[:0], np.zeros(0))]
    unit = lambda x: (y := x / np.abs(x).max(axis=1, keepdims=True)) / np.sqrt((y * y).sum(axis=1, keepdims=True))
    (cq, cs, cl), slack = quantise(unit(c)), 1e-9
    exact = c.shape[1] * 127 * 127 < 1 << 24
    step = max(1, PAIRS // len(c_ids))
    for a in range(0, len(q_ids), step):
        ids, raw = q_ids[a : a + step], q[a : a + step]
        qq, qs, ql = quantise(unit(raw))
        product = (qq @ cq.T).astype(np.float64) if exact else qq.astype(np.float64) @ cq.T.astype(np.float64)
        near = product * qs[:, None] * cs[None, :]
        # |qc - q'c'| <= |q - q'| |c| + |q'| |c - c'|, with |c| = 1 and |q'| <= 1 + |q - q'|
        error = ql[:, None] + (1 + ql[:, None]) * cl[None, :] + slack
        own = ids[:, None] == c_ids[None, :]
        near[own] = -np.inf
        low = near - error
        nth = min(k, near.shape[1])
        floor = np.partition(low, near.shape[1] - nth, axis=1)[:, near.shape[1] - nth]
        rows, cols = np.nonzero((near + error >= floor[:, None]) & ~own)
        scores = np.concatenate([cosine(raw[rows[i : i + 65536]], c[cols[i : i + 65536]]) for i in range(0, len(rows), 65536)] or [np.zeros(0)])
        order = np.lexsort((c_ids[cols], -scores, rows))
        rows, cols, scores = rows[order], cols[order], scores[order]
        head = np.searchsorted(rows, rows)
        best = np.arange(len(rows)) - head < k
        out.append((ids[rows[best]], c_ids[cols[best]], scores[best]))
    return tuple(np.concatenate(x) for x in zip(*out))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def nearest(queries: DataFrame, vectors: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of `vectors` to each row of `queries`."""

    def usable(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False))).withColumn("dim", F.size("v"))

    c, q = usable(vectors), usable(queries).dropDuplicates(["id", "v"])
    (n, wide), m = c.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first(), q.count()
    most = max(1, BLOCK_BYTES // (8 * wide))
    block = min(MOST_BLOCK, max(LEAST_BLOCK, n // 1000), most)
    rows, cols = max(1, -(-m // min(query_block, most))), max(1, -(-n // block))
    deal = lambda parts: F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = q.select("dim", deal(rows).alias("r"), every(cols).alias("c"), F.lit(True).alias("query"), "id", "v")
    right = c.select("dim", every(rows).alias("r"), deal(cols).alias("c"), F.lit(False).alias("query"), "id", "v")

    def product(table: pa.Table) -> pa.Table:
        query = table["query"].combine_chunks().to_numpy(zero_copy_only=False)
        ids, v = table["id"].to_numpy(), matrix(table["v"])
        found = tile(ids[query], v[query], ids[~query], v[~query], k) if query.any() and not query.all() else (ids[:0], ids[:0], np.zeros(0))
        return pa.table(list(map(pa.array, found)), ["query_id", "vec_id", "score"])

    tiles = left.unionAll(right).groupBy("dim", "r", "c").applyInArrow(product, "query_id long, vec_id long, score double")

    def heaps(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The tiles' answers, of each query together: a heap of its k best, whose worst stands on top."""
        now, heap, out = None, [], []

        def close() -> None:
            best = sorted(heap, reverse=True)
            out.extend((now, i + 1, -vec, score) for i, (score, vec) in enumerate(best))

        for batch in parts:
            for query, vec, score in zip(*(x.to_pylist() for x in batch.columns)):
                if query != now:
                    if now is not None:
                        close()
                    now, heap = query, []
                item = (score, -vec)
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
            if len(out) > 50_000:
                yield batch_of(out)
                out = []
        if now is not None:
            close()
        yield batch_of(out)

    def batch_of(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * 4
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], ["query_id", "rank", "vec_id", "score"])

    together = tiles.repartition(partitions(queries.sparkSession, m * k * cols, PART_ROWS), "query_id").sortWithinPartitions("query_id")
    return together.mapInArrow(heaps, "query_id long, rank int, vec_id long, score double")
