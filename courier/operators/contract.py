"""Contracts: what a record must be, what becomes of a batch, and why envelopes are quarantined."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..model import DEAD, DELIVERED, QUARANTINE_KEPT, REASONS
from .ranking import newest


@dataclass(frozen=True)
class Contract:
    max_len: int
    prefix: bytes

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(self.max_len.to_bytes(8, "little") + self.prefix).hexdigest()

    def accepts(self, value: Column) -> Column:
        """Non-empty, within the length, with the prefix. A null record is refused."""
        v = value.cast("binary")
        ok = (F.octet_length(v) > 0) & (F.octet_length(v) <= self.max_len) & F.startswith(v, F.lit(self.prefix))
        return F.coalesce(ok, F.lit(False))


def tally(records: DataFrame, contract: Contract, by: list[str], value: str = "value") -> DataFrame:
    ok = contract.accepts(F.col(value))
    return records.groupBy(*by).agg(F.count("*").alias("offered"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("quarantined"))


def batches(records: DataFrame, contract: Contract, batch: str = "batch_id", value: str = "value") -> DataFrame:
    """One bad record refuses its whole batch."""
    ok = contract.accepts(F.col(value))
    return records.groupBy(batch).agg(F.count("*").alias("records"), F.count_if(~ok).alias("bad"), F.every(ok).alias("accepted"))


def accepted_records(records: DataFrame, contract: Contract, batch: str = "batch_id", value: str = "value") -> DataFrame:
    good = batches(records, contract, batch, value).where("accepted").select(batch)
    return records.join(good, batch, "left_semi")


def reason(checks: dict[str, Column]) -> Column:
    """The first failed check, in the fixed order; null if all hold. checks: the condition that must hold for each reason."""
    out = F.lit(None).cast("string")
    for name in reversed(REASONS):
        if name in checks:
            out = F.when(~F.coalesce(checks[name], F.lit(False)), name).otherwise(out)
    return out


def disposition(reason_col: Column, duplicate: Column) -> Column:
    return F.when(reason_col.isNotNull(), DEAD).when(duplicate, "Duplicate").otherwise(DELIVERED)


def quarantine(envelopes: DataFrame, by: list[str], arrival: str, kept: int = QUARANTINE_KEPT) -> DataFrame:
    """The newest dead letters of each queue."""
    return newest(envelopes.where("reason is not null"), by, arrival, kept)


def quarantine_totals(envelopes: DataFrame, by: list[str], kept: int = QUARANTINE_KEPT) -> DataFrame:
    n = F.count("*")
    return envelopes.where("reason is not null").groupBy(*by).agg(n.alias("total"), F.least(n, F.lit(kept)).alias("retained"), F.greatest(n - kept, F.lit(0)).alias("evicted"))


def parse_error_code(kind: Column) -> Column:
    """The protocol's answer to a failed produce."""
    return F.when(kind == "contract", 87).when(kind == "too_large", 10).when(kind == "corrupt", 2).when(kind == "io", 56).otherwise(0)


def has_nul(value: Column) -> Column:
    return F.contains(value.cast("binary"), F.lit(b"\0"))


def within(value: Column, limit: int) -> Column:
    return F.octet_length(value.cast("binary")) <= limit


def identifier_ok(name: str) -> bool:
    """A plain SQL identifier: a letter or underscore, then letters, digits, underscores; 63 at most."""
    return name.isascii() and 0 < len(name) <= 63 and (name[0].isalpha() or name[0] == "_") and all(c.isalnum() or c == "_" for c in name)
