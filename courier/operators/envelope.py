"""Envelopes: framing, sealing, opening and checking, with digests and AES-GCM of the engine.

Functional, not byte-compatible with other implementations: SHA-256 names content, HMAC-SHA-256 stands in for
signatures, AES-256-GCM seals. The nonce is synthetic, from the key, the header and the plaintext, so that a task that
runs again writes the same bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.hashing import hmac_sha256, le64, sha256_of
from ..model import ENVELOPE, HEADER
from .contract import Contract, reason


def frame_values(values: list[bytes]) -> bytes:
    return struct.pack("<I", len(values)) + b"".join(struct.pack("<I", len(v)) + v for v in values)


def unframe_values(data: bytes) -> list[bytes] | None:
    """The values of a framed batch; None if it is malformed or has trailing bytes."""
    if data is None or len(data) < 4:
        return None
    (count,), at, out = struct.unpack_from("<I", data), 4, []
    for _ in range(count):
        if at + 4 > len(data):
            return None
        (size,) = struct.unpack_from("<I", data, at)
        at += 4
        if at + size > len(data):
            return None
        out.append(data[at : at + size])
        at += size
    return out if at == len(data) else None


def little32(number: Column) -> Column:
    return F.substring(le64(number), 1, 4)


def framed(records: DataFrame, batch: str = "batch_id", order: str = "ord", value: str = "value") -> DataFrame:
    """One framed payload for each batch, from built-in functions."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value).cast("binary").alias("v"))))
    parts = F.transform("r", lambda x: F.hex(F.concat(little32(F.octet_length(x["v"])), x["v"])))
    return records.groupBy(batch).agg(rows.alias("r")).select(batch, F.size("r").alias("records"), F.concat(little32(F.size("r")), F.unhex(F.array_join(parts, ""))).alias("payload"))


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def unframe(payloads: pd.Series) -> pd.Series:
    """Values of framed payloads; null for malformed ones."""
    return pd.Series([unframe_values(None if p is None else bytes(p)) for p in payloads])


def associated_data(h: str = "header") -> Column:
    """The header fields that sealing binds."""
    c = lambda n: F.coalesce(F.col(f"{h}.{n}"), F.lit(b""))
    return F.concat(c("route_id"), c("stream_id"), le64(F.col(f"{h}.seq")), c("idempotency_key"), c("contract_fp"), F.encode(F.col(f"{h}.cipher"), "UTF-8"), c("signer_key_id"), c("eph_pk"), F.when(F.col(f"{h}.sender_present"), F.lit(b"\1")).otherwise(F.lit(b"\0")), le64(F.col(f"{h}.ts")))


def seal(batches: DataFrame, contract: Contract, data_key: bytes, signing_key: bytes, route_id: bytes, stream_id: Column, seq: Column, record_key: Column, payload: Column) -> DataFrame:
    """Batches with a header, an encrypted payload and a seal over both."""
    empty = F.lit(b"")
    header = F.struct(
        F.lit(route_id).alias("route_id"), stream_id.cast("binary").alias("stream_id"), seq.cast("long").alias("seq"), empty.alias("envelope_id"), F.unhex(hmac_sha256(signing_key, record_key)).alias("idempotency_key"),
        F.unhex(F.lit(contract.fingerprint)).alias("contract_fp"), F.lit("aes-256-gcm").alias("cipher"), empty.alias("nonce"), F.unhex(F.sha2(F.lit(signing_key), 256)).alias("signer_key_id"), empty.alias("eph_pk"), F.lit(False).alias("sender_present"), F.lit(0).cast("long").alias("ts"),
    )
    out = batches.withColumn("header", header).withColumn("__plain", payload).withColumn("__aad", associated_data())
    out = out.withColumn("__nonce", F.substring(F.unhex(hmac_sha256(data_key, F.concat("__aad", "__plain"))), 1, 12))
    out = out.withColumn("payload", F.aes_encrypt("__plain", F.lit(data_key), F.lit("GCM"), F.lit("DEFAULT"), F.col("__nonce"), F.col("__aad")))
    out = out.withColumn("header", F.col("header").withField("nonce", F.col("__nonce")).withField("envelope_id", F.unhex(F.sha2("payload", 256))))
    return out.withColumn("seal", F.unhex(hmac_sha256(signing_key, F.concat("header.envelope_id", "header.nonce", "__aad")))).drop("__plain", "__aad", "__nonce")


def opened(envelopes: DataFrame, contract: Contract, data_key: bytes, signing_key: bytes, route_id: bytes, stream_id: Column | None = None) -> DataFrame:
    """Envelopes with `reason` (null if all is well) and, where it is, `values`."""
    out = envelopes.withColumn("__aad", associated_data()).withColumn("__plain", F.try_aes_decrypt("payload", F.lit(data_key), F.lit("GCM"), F.lit("DEFAULT"), F.col("__aad")))
    out = out.withColumn("values", unframe("__plain"))
    sealed = (F.sha2("payload", 256) == F.lower(F.hex("header.envelope_id"))) & (F.lower(F.hex("header.signer_key_id")) == F.sha2(F.lit(signing_key), 256)) & (F.lower(F.hex("seal")) == hmac_sha256(signing_key, F.concat("header.envelope_id", "header.nonce", "__aad")))
    route = F.col("header.route_id") == F.lit(route_id)
    checks = {
        "bad_seal": sealed, "wrong_route": route if stream_id is None else route & (F.col("header.stream_id") == stream_id.cast("binary")), "contract_mismatch": F.lower(F.hex("header.contract_fp")) == contract.fingerprint,
        "open_failed": F.col("__plain").isNotNull(), "bad_framing": F.col("values").isNotNull(), "contract_violation": F.forall("values", lambda v: contract.accepts(v)),
    }
    out = out.withColumn("reason", reason(checks))
    return out.withColumn("values", F.when(F.col("reason").isNull(), F.col("values"))).drop("__aad", "__plain")


#: The parts of an encoded envelope that have a length before them, in order; then come seq, ts and the sender's flag.
PARTS = ("route_id", "stream_id", "envelope_id", "idempotency_key", "contract_fp", "cipher", "nonce", "signer_key_id", "eph_pk")
VERSION = b"\x01"


def encoded(header: str = "header", payload: str = "payload", seal_: str = "seal") -> Column:
    """An envelope as bytes, from built-in functions; null parts are empty."""
    part = lambda c: F.concat(little32(F.octet_length(c)), c)
    empty = lambda name: F.coalesce(F.col(name).cast("binary"), F.lit(b""))
    tail = [le64(F.col(f"{header}.seq")), le64(F.col(f"{header}.ts")), F.when(F.col(f"{header}.sender_present"), F.lit(b"\1")).otherwise(F.lit(b"\0"))]
    return F.concat(F.lit(VERSION), *[part(empty(f"{header}.{n}")) for n in PARTS], part(empty(payload)), part(empty(seal_)), *tail)


def decode_envelope(data: bytes | None) -> dict | None:
    """The envelope of these bytes; None if they are cut off, of another version, flagged wrongly, or have bytes left over."""
    if data is None or data[:1] != VERSION:
        return None
    at, parts = 1, []
    for _ in range(len(PARTS) + 2):
        if at + 4 > len(data):
            return None
        (size,) = struct.unpack_from("<I", data, at)
        if at + 4 + size > len(data):
            return None
        parts.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    if at + 17 != len(data) or data[-1] > 1:
        return None
    seq, ts = struct.unpack_from("<qq", data, at)
    try:
        header = dict(zip(PARTS, parts)) | {"cipher": parts[PARTS.index("cipher")].decode(), "seq": seq, "ts": ts, "sender_present": bool(data[-1])}
    except UnicodeDecodeError:
        return None
    return {"header": {f.name: header[f.name] for f in HEADER.fields}, "payload": parts[-2], "seal": parts[-1]}


def decoded(wires: DataFrame, wire: str = "wire") -> DataFrame:
    """Rows of encoded envelopes with `envelope` (header, payload, seal) in the bytes' place, null where they are malformed."""
    names = [c for c in wires.columns if c != wire]
    schema = T.StructType([*[wires.schema[c] for c in names], T.StructField("envelope", ENVELOPE)])
    kind = pa.struct([("header", pa.struct([(f.name, {"binary": pa.binary(), "string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[f.dataType.simpleString()]) for f in HEADER.fields])), ("payload", pa.binary()), ("seal", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([decode_envelope(w) for w in batch.column(len(names)).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], found], [*names, "envelope"])

    return wires.select(*names, F.col(wire).cast("binary").alias(wire)).mapInArrow(run, schema)


def certificate(issuer_key: bytes, subject: Column, epoch: Column) -> Column:
    """A sender's certificate: version, epoch, the subject's digest, and the issuer's signature over them."""
    body = F.concat(F.lit(VERSION), le64(epoch), sha256_of(subject))
    return F.concat(body, F.unhex(hmac_sha256(issuer_key, body)))


def certificate_failure(cert: Column, issuer_key: bytes, subject: Column, least_epoch: int) -> Column:
    """Why a sender is refused, in this order: malformed, signature, subject, epoch; null if it is accepted."""
    body, epoch = F.substring(cert, 1, 41), F.substring(cert, 2, 8)
    number = F.conv(F.concat(*[F.hex(F.substring(epoch, 9 - i, 1)) for i in range(1, 9)]), 16, 10).cast("decimal(20,0)")
    fine = (F.octet_length(cert) == 73) & (F.substring(cert, 1, 1) == F.lit(VERSION))
    signed = F.unhex(hmac_sha256(issuer_key, body)) == F.substring(cert, 42, 32)
    same = F.substring(cert, 10, 32) == sha256_of(subject)
    return F.when(~F.coalesce(fine, F.lit(False)), "malformed").when(~signed, "signature").when(~same, "subject").when(number < least_epoch, "epoch")


def stream_identity(route: Column, topic: Column, partition: Column, producer: Column, epoch: Column) -> Column:
    """One key for an idempotent producer's range, without ambiguity between its parts."""
    return F.struct(route.alias("route"), topic.alias("topic"), partition.alias("partition"), producer.alias("producer"), epoch.alias("epoch"))


def encode_frames(values: Iterator[bytes]) -> bytes:
    """Log frames: u32 length, body, CRC-32 of both, little-endian."""
    import zlib

    out = []
    for v in values:
        head = struct.pack("<I", len(v)) + v
        out.append(head + struct.pack("<I", zlib.crc32(head)))
    return b"".join(out)


def decode_frames(data: bytes) -> list[tuple[int, bytes, bool]]:
    """(start, body, good) of each frame up to the first torn or corrupt one, which is included with good = False."""
    import zlib

    at, out = 0, []
    while at < len(data):
        if at + 8 > len(data):
            return [*out, (at, b"", False)]
        (size,) = struct.unpack_from("<I", data, at)
        end = at + 8 + size
        if end > len(data):
            return [*out, (at, b"", False)]
        good = zlib.crc32(data[at : end - 4]) == struct.unpack_from("<I", data, end - 4)[0]
        out.append((at, data[at + 4 : end - 4], good))
        if not good:
            return out
        at = end
    return out


def keyed_record(key: Column, payload: Column) -> Column:
    return F.concat(little32(F.octet_length(key.cast("binary"))), key.cast("binary"), payload.cast("binary"))


def split_keyed(record: str) -> tuple[Column, Column]:
    """(key, payload) of a length-prefixed keyed record; null for a record too short for its key."""
    r = f"`{record}`"
    n = F.expr(f"cast(conv(concat(hex(substring({r}, 4, 1)), hex(substring({r}, 3, 1)), hex(substring({r}, 2, 1)), hex(substring({r}, 1, 1))), 16, 10) as int)")
    ok = (F.octet_length(F.col(record)) >= 4) & (F.octet_length(F.col(record)) >= n + 4)
    return F.when(ok, F.substring(F.col(record), F.lit(5), n)), F.when(ok, F.substring(F.col(record), n + 5, F.octet_length(F.col(record))))

