"""Merkle logs, inclusion proofs, receipts and chunked blobs, from digests of the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import hmac_sha256, le64, sha256_of
from ..model import CHUNK
from .lineage import cut


def leaf(envelope_id: Column, route: Column, stream: Column, seq: Column, epoch: Column) -> Column:
    """Identity bound to route, stream and position."""
    return sha256_of(envelope_id, route, stream, le64(seq), le64(epoch))


def node(left: Column, right: Column) -> Column:
    return sha256_of(F.lit(b"\x01"), left, right)


def chunk_leaf(index: Column, data: Column) -> Column:
    return sha256_of(F.lit(b"\x02"), le64(index), data)


def next_level(level: DataFrame, log: str = "log_id") -> DataFrame:
    """(log, idx, hash) -> the level above: neighbours are hashed together, a last one without a neighbour moves up as it is."""
    pairs = level.groupBy(log, F.floor(F.col("idx") / 2).alias("up")).agg(F.min_by("hash", "idx").alias("l"), F.max_by("hash", "idx").alias("r"), F.count("*").alias("n"))
    return pairs.select(log, F.col("up").alias("idx"), F.when(F.col("n") == 2, node(F.col("l"), F.col("r"))).otherwise(F.col("l")).alias("hash"))


def levels(leaves: DataFrame, log: str = "log_id") -> list[DataFrame]:
    """All levels from the leaves to the roots, materialised: each is read by the next one and by its proofs.

    Their number is the logarithm of the largest log."""
    out = [cut(leaves.select(log, "idx", "hash"))]
    size = leaves.groupBy(log).count().agg(F.max("count")).first()[0] or 0
    while size > 1:
        out.append(cut(next_level(out[-1], log)))
        size = (size + 1) // 2
    return out


def folded(level: DataFrame, depth: int, log: str = "log_id") -> DataFrame:
    """The level `depth` levels up, by one shuffle: 2^depth neighbours meet and are hashed pairwise, level by level."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda x: x["hash"])
    up = (
        f"aggregate(sequence(1, {depth}), __h, (acc, k) -> transform(sequence(0, (size(acc) - 1) div 2), i -> if(get(acc, cast(2 * i + 1 as int)) is null,"
        " get(acc, cast(2 * i as int)), unhex(sha2(concat(X'01', get(acc, cast(2 * i as int)), get(acc, cast(2 * i + 1 as int))), 256)))))"
    )
    out = level.groupBy(log, F.shiftright("idx", depth).alias("idx")).agg(rows.cast("array<binary>").alias("__h"))
    return out.select(log, "idx", F.get(F.expr(up), F.lit(0)).alias("hash"))


def roots(leaves: DataFrame, log: str = "log_id", step: int = 8) -> DataFrame:
    """The root of each log. Levels are taken `step` at a time, so there are few shuffles and no large groups."""
    now, size = leaves.select(log, "idx", "hash"), leaves.groupBy(log).count().agg(F.max("count")).first()[0] or 0
    while size > 1:
        depth = min(step, (size - 1).bit_length())
        now, size = folded(now, depth, log), -(-size // (1 << depth))
    return now.select(log, F.lower(F.hex("hash")).alias("root"))


EMPTY_ROOT = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


NO_PATH = "cast(array() as array<struct<depth:int,sibling:binary,right:boolean>>)"
#: Heads up to which they are broadcast.
BROADCAST_HEADS = 100_000


def _paths(level: DataFrame, size: int, log: str, step: int, base: int = 0) -> DataFrame:
    """(log, idx, hash, path) for a level at height `base`, materialised: 2^depth neighbours meet and find their siblings among
    themselves; the rest of the way is that of their common node `depth` levels up."""
    if size <= 1:
        return level.select(log, "idx", "hash", F.expr(NO_PATH).alias("path"))
    depth = min(step, (size - 1).bit_length())
    blocks = level.groupBy(log, F.shiftright("idx", depth).alias("__block")).agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("__rows"))
    if size > 1 << depth:
        higher = _paths(cut(folded(level, depth, log)), -(-size // (1 << depth)), log, step, base + depth)
        # the paths are far larger than their estimate, so they aren't left to be broadcast
        blocks = blocks.join(higher.select(log, F.col("idx").alias("__block"), F.col("path").alias("__above")).hint("merge"), [log, "__block"])
    else:
        blocks = blocks.withColumn("__above", F.expr(NO_PATH))
    up = (
        "transform(sequence(0, (size(element_at(acc, -1)) - 1) div 2), n -> if(get(element_at(acc, -1), cast(2 * n + 1 as int)) is null, get(element_at(acc, -1), cast(2 * n as int)),"
        " unhex(sha2(concat(X'01', get(element_at(acc, -1), cast(2 * n as int)), get(element_at(acc, -1), cast(2 * n + 1 as int))), 256))))"
    )
    levels = "array(transform(__rows, r -> r.hash))"
    if depth > 1:
        levels = f"aggregate(sequence(1, {depth - 1}), {levels}, (acc, k) -> concat(acc, array({up})))"
    sibling = f"named_struct('depth', d + {base}, 'sibling', get(get(lv, d), shiftright(i, d) ^ 1), 'right', (shiftright(i, d) & 1) = 0)"
    own = f"filter(transform(sequence(0, {depth - 1}), d -> {sibling}), x -> x.sibling is not null)"
    # the levels are a lambda's variable, so that they are made once for a block and not once for a leaf
    rows = f"get(transform(array({levels}), lv -> transform(__rows, (r, i) -> named_struct('idx', r.idx, 'hash', r.hash, 'path', concat({own}, __above)))), 0)"
    return blocks.select(log, F.inline(F.expr(rows)))


def proved(leaves: DataFrame, log: str = "log_id", step: int = 8) -> DataFrame:
    """(log, idx, hash, path): each leaf with the siblings from it to the root and their sides; a level without a sibling adds
    none. Leaves are numbered from 0 without gaps; those without a log have no path and are left out."""
    level = cut(leaves.where(F.col(log).isNotNull()).select(log, "idx", "hash"))
    return _paths(level, level.groupBy(log).count().agg(F.max("count")).first()[0] or 0, log, step)


def inclusion_proofs(leaves: DataFrame, log: str = "log_id") -> DataFrame:
    return proved(leaves, log).select(log, "idx", "path")


def with_heads(rows: DataFrame, tops: DataFrame, log: str = "log_id") -> DataFrame:
    """Rows of leaves with what their log's head holds; few heads are broadcast, so that rows needn't meet by their log."""
    tops = cut(tops)
    return rows.join(F.broadcast(tops) if tops.count() <= BROADCAST_HEADS else tops, log)


def root_from_path(leaf_hash: Column, path: Column) -> Column:
    return F.aggregate(path, leaf_hash, lambda acc, s: F.when(s["right"], node(acc, s["sibling"])).otherwise(node(s["sibling"], acc)))


def included(leaf_hash: Column, idx: Column, size: Column, path: Column, root: Column) -> Column:
    return (idx < size) & (root_from_path(leaf_hash, path) == root)


def tree_head(key: bytes, log: Column, size: Column, root: Column) -> Column:
    """A keyed signature of a log's size and root."""
    return hmac_sha256(key, F.concat(F.lit(b"head"), log.cast("binary"), le64(size), root))


def acknowledgement(key: bytes, leaf_hash: Column, idx: Column, root: Column) -> Column:
    return hmac_sha256(key, F.concat(F.lit(b"ack"), leaf_hash, le64(idx), root))


def receipt_failure(content_ok: Column, head_ok: Column, size_ok: Column, included_ok: Column, ack_ok: Column, ack_position_ok: Column, ack_root_ok: Column) -> Column:
    """The first check that a receipt fails, in the fixed order; null if it holds."""
    names = ("content", "head", "tree_size", "inclusion", "ack", "ack_position", "ack_root")
    out = F.lit(None).cast("string")
    for name, ok in reversed(list(zip(names, (content_ok, head_ok, size_ok, included_ok, ack_ok, ack_position_ok, ack_root_ok)))):
        out = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(out)
    return out


def chunks(blobs: DataFrame, blob: str, data: str, size: int = CHUNK) -> DataFrame:
    """(blob, idx, total, bytes): pieces of `size` bytes; an empty blob is one empty piece."""
    b = F.col(data).cast("binary")
    total = F.greatest(F.ceil(F.octet_length(b) / F.lit(size)).cast("int"), F.lit(1))
    pieces = F.transform(F.sequence(F.lit(0), total - 1), lambda i: F.substring(b, i * size + 1, F.lit(size)))
    return blobs.where(F.col(data).isNotNull()).select(blob, total.alias("total"), F.posexplode(pieces).alias("idx", "bytes")).select(blob, F.col("idx").cast("long").alias("idx"), "total", "bytes")


def missing(present: DataFrame, totals: DataFrame, blob: str) -> DataFrame:
    """Indices of pieces that haven't come."""
    every = totals.select(blob, F.explode(F.sequence(F.lit(0).cast("long"), F.col("total").cast("long") - 1)).alias("idx"))
    return every.join(present.select(blob, "idx"), [blob, "idx"], "left_anti")


def reassemble(pieces: DataFrame, blob: str) -> DataFrame:
    """Blobs whose pieces are all there."""
    rows = F.array_sort(F.collect_set(F.struct("idx", "bytes")))
    whole = pieces.groupBy(blob).agg(rows.alias("r"), F.max("total").alias("total")).where(F.size("r") == F.col("total"))
    return whole.select(blob, F.unhex(F.array_join(F.transform("r", lambda x: F.hex(x["bytes"])), "")).alias("data"))


def heads(leaves: DataFrame, log: str = "log_id") -> DataFrame:
    return roots(leaves, log).join(leaves.groupBy(log).agg(F.count("*").alias("size")), log)


def head_ok(key: bytes, log: Column, size: Column, root: Column, signature: Column) -> Column:
    return tree_head(key, log, size, root) == F.lower(F.hex(signature))


def ack_ok(key: bytes, leaf_hash: Column, idx: Column, root: Column, signature: Column) -> Column:
    return acknowledgement(key, leaf_hash, idx, root) == F.lower(F.hex(signature))


def receipts(leaves: DataFrame, key: bytes, log: str = "log_id") -> DataFrame:
    """(log, idx, hash, size, root, head, path, ack_idx, ack_root, ack): what proves to the sender of each leaf that it is in its log."""
    signed = heads(leaves, log).withColumn("root", F.unhex("root")).withColumn("head", F.unhex(tree_head(key, F.col(log), F.col("size"), F.col("root"))))
    rows = with_heads(proved(leaves, log), signed, log)
    return rows.select("*", F.col("idx").alias("ack_idx"), F.col("root").alias("ack_root"), F.unhex(acknowledgement(key, F.col("hash"), F.col("idx"), F.col("root"))).alias("ack"))


def verified(found: DataFrame, key: bytes, content: Column, log: str = "log_id") -> DataFrame:
    """Receipts with `failure`, the first check that each fails, null if it holds. content: the leaf that the sender expects."""
    c = F.col
    in_size = c("idx") < c("size")
    checks = (
        c("hash") == content, head_ok(key, c(log), c("size"), c("root"), c("head")), in_size, root_from_path(c("hash"), c("path")) == c("root"),
        ack_ok(key, c("hash"), c("ack_idx"), c("ack_root"), c("ack")), c("ack_idx") == c("idx"), c("ack_root") == c("root"),
    )
    return found.withColumn("failure", receipt_failure(*checks))


def accepted_chunks(pieces: DataFrame, leaves: DataFrame, blob: str) -> DataFrame:
    """The pieces whose bytes give the leaf that the blob's list of leaves (blob, idx, leaf) has for them, each once."""
    fine = pieces.join(leaves.select(blob, "idx", F.col("leaf").alias("__leaf")), [blob, "idx"]).where(chunk_leaf(F.col("idx"), F.col("bytes")) == F.col("__leaf"))
    return fine.drop("__leaf").dropDuplicates([blob, "idx"])
