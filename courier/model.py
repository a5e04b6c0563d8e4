"""Record, header, envelope and event schemas, and the constants of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {
    "binary": T.BinaryType(), "long": T.LongType(), "int": T.IntegerType(), "short": T.ShortType(), "string": T.StringType(),
    "boolean": T.BooleanType(), "double": T.DoubleType(), "binaries": T.ArrayType(T.BinaryType()),
}


def struct(fields: str) -> T.StructType:
    """A schema from "name kind, name kind"; needs no session, so that workers can import it."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (f.split() for f in fields.split(","))])


HEADER = struct(
    "route_id binary, stream_id binary, seq long, envelope_id binary, idempotency_key binary, contract_fp binary, cipher string, nonce binary,"
    " signer_key_id binary, eph_pk binary, sender_present boolean, ts long"
)
ENVELOPE = T.StructType([T.StructField("header", HEADER), T.StructField("payload", T.BinaryType()), T.StructField("seal", T.BinaryType())])
RECORD = struct("batch_id long, ord int, value binary")
ARRIVAL = struct("stream string, arrival long, seq long, key string")
PRODUCED = struct("topic string, partition int, values binaries, producer_id long, epoch short, base_sequence int, count int, transactional boolean")
DECODED = struct("values binaries, producer_id long, epoch int, base_sequence int, count int, transactional boolean, error int")

DELIVERED, DUPLICATE, DEAD = "Delivered", "Duplicate", "DeadLettered"
#: Rejection reasons, in the order in which they are looked for.
REASONS = ("bad_seal", "wrong_route", "contract_mismatch", "key_unwrap", "open_failed", "sender_rejected", "bad_framing", "contract_violation")
# Limits and protocol codes.
QUARANTINE_KEPT = 1024
REORDER_HORIZON = 1 << 20
GC_LAG = 1024
CHUNK = 64 * 1024
FRAME_LIMIT = 16 << 20
ENVELOPE_LIMIT = 64 << 20
BATCH_COUNT, BATCH_MICROS = 128, 1000
REBALANCE_MS = 3000
CORRUPT, TOO_LARGE, ILLEGAL_GENERATION, UNKNOWN_MEMBER, REBALANCE, INVALID_EPOCH, INVALID_STATE, CONCURRENT, RETRIABLE, INVALID_RECORD = 2, 10, 22, 25, 27, 47, 48, 51, 56, 87
