"""Shards along a Hilbert curve over several metadata dimensions, with DataFrame functions only.

Each dimension is quantised to 2^bits codes by quantiles over all rows that keep its order (strings by the six bytes
after the prefix that all but the empty ones share), so close codes mean close values and a file's minimum and maximum
prune. The curve's index of a cell orders the rows, ties are ordered by the text's hash (copies stay together) and the
id, and the order is cut into runs of equally many rows. `write` cuts the files by the same ranks as `place`.

Nulls: null metadata counts as the empty string, or as a size of no bytes; empty strings come first. A null text has 0
bytes, and size 1. Equal rows are interchangeable and each has a place. An empty table gives an empty result. Other
columns don't matter to `place` and pass through `write`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, cut_table, numbers, ordered_rank

SHARDS = 16
BITS = 5
DIMENSIONS = ("lang", "source", "size")


def curve_index(cell: tuple[int, ...], bits: int) -> int:
    """The place on the Hilbert curve of a cell with one coordinate of `bits` bits for each dimension.

    From the highest bit down: the cell's corner of the present cube, turned and mirrored as the path so far has it,
    is a Gray code; its rank is the next digit. `entry` and `axis` are the corner and the direction of the curve
    in the present cube.
    """
    n = len(cell)
    mask = (1 << n) - 1

    def turn(x: int, k: int) -> int:
        k %= n
        return ((x >> k) | (x << (n - k))) & mask

    place = entry = axis = 0
    for level in range(bits - 1, -1, -1):
        corner = sum(((x >> level) & 1) << i for i, x in enumerate(cell))
        digit = gray = turn(corner ^ entry, axis + 1)
        while gray := gray >> 1:
            digit ^= gray
        place = place << n | digit
        even = (digit - 1) // 2 * 2 if digit else 0
        start = even ^ even >> 1 if digit else 0
        entry ^= turn(start, -(axis + 1))
        odd = digit if digit % 2 else digit - 1 if digit else 0
        axis = (axis + (((odd + 1) & ~odd).bit_length() - 1 if digit else 0) + 1) % n
    return place


def cells(dimensions: int, bits: int) -> list[int]:
    """The curve's index of every cell; a cell's number has the first dimension in its lowest bits."""
    each = (1 << bits) - 1
    return [curve_index(tuple(c >> bits * i & each for i in range(dimensions)), bits) for c in range(1 << bits * dimensions)]


def order_key(column: Column, prefix: int) -> Column:
    """Six bytes of a string after a shared prefix, as a number that keeps their order and is exact as a double (quantiles are doubles); the empty string is below all."""
    tail = F.substring(F.encode(column, "UTF-8"), prefix + 1, 6)
    return F.when(F.coalesce(column, F.lit("")) == "", -1).otherwise(F.conv(F.rpad(F.hex(tail), 12, "0"), 16, 10).cast("long"))


def quantised(rows: DataFrame, keys: list[str], bits: int) -> list[Column]:
    """The code of each key column: how many of the quantiles of all rows lie below it."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = rows.agg(*[F.percentile_approx(k, shares, 10_000).alias(k) for k in keys]).first()
    return [below(F.col(k), found[k] or []) for k in keys]


def below(column: Column, limits: list[int]) -> Column:
    """How many of the limits are less than the column's value."""
    return F.size(F.filter(numbers(limits), lambda t: t < column)) if limits else F.lit(0)


def with_curve(rows: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """Rows (materialised) with `curve`, their place on the curve over string or number columns."""
    if len(dimensions) * bits > 15:
        raise ValueError("dimensions x bits may be 15 at most")
    kinds = dict(rows.dtypes)
    text = [d for d in dimensions if kinds[d] == "string"]
    filled = lambda d: F.when(F.col(d) != "", F.col(d))
    ends = rows.agg(*[f(filled(d)).alias(f"{f.__name__}_{d}") for d in text for f in (F.min, F.max)] or [F.count("*").alias("n")]).first()
    keyed = rows
    for i, d in enumerate(dimensions):
        if d in text:
            low, high = ((ends[f"{f}_{d}"] or "").encode() for f in ("min", "max"))
            same = next((j for j, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
            key = order_key(F.col(d), same)
        else:
            key = F.coalesce(F.col(d).cast("long"), F.lit(0).cast("long"))
        keyed = keyed.withColumn(f"__k{i}", key)
    cell = F.lit(1)
    for i, code in enumerate(quantised(keyed, [f"__k{i}" for i in range(len(dimensions))], bits)):
        cell = cell + code * F.lit(1 << bits * i)
    return keyed.withColumn("curve", F.element_at(numbers(cells(len(dimensions), bits)), cell)).drop(*[f"__k{i}" for i in range(len(dimensions))])


def runs(n: int, shards: int) -> tuple[Column, Column]:
    """Shard and slot of a rank among n: runs with counts at most one apart."""
    shard = F.expr(f"(rank * {shards}L) div {max(n, 1)}L")
    return shard.cast("int"), F.col("rank") - F.expr(f"((rank * {shards}L) div {max(n, 1)}L * {max(n, 1)}L + {shards - 1}L) div {shards}L")


def place(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): runs of the curve with counts at most one apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = cut(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("copy"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        )
    )
    ordered, n = ordered_rank(with_curve(rows).select("doc_id", "size", "text_crc32", "copy", "curve"), ["curve", "copy", "doc_id"])
    shard, slot = runs(n, shards)
    return ordered.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", lang: str = "lang", source: str = "source") -> None:
    """All columns in one Parquet file for each shard of `place`, in the order of its slots; shards without rows have none.

    The ranks are looked up by what they order: equal rows of that key follow one another on the curve, and each takes the
    next rank. The texts move once, by the shuffle to their files.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = dict(zip(docs.columns, names))
    text = F.coalesce(F.col(own[text_col]).cast("string"), F.lit(""))
    rows = docs.toDF(*names).select(
        F.struct(*names).alias("row"), F.col(own[id_col]).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.xxhash64(text).alias("copy"),
        F.coalesce(F.col(own[lang]).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(own[source]).cast("string"), F.lit("")).alias("source"),
    )
    keyed = cut_table(rows.withColumn("number", F.monotonically_increasing_id()))
    ordered, n = ordered_rank(with_curve(keyed.drop("row")).select("number", "doc_id", "copy", "curve"), ["curve", "copy", "doc_id"])
    shard, _ = runs(n, shards)
    placed = keyed.select("number", "row").join(ordered.select("number", "rank", shard.alias("shard")), "number")
    placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("rank").select("row.*").toDF(*docs.columns).write.mode("overwrite").parquet(path)
