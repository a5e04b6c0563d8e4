"""Route files: parsing, checks, key references."""

from __future__ import annotations

import hmac
import os
import tomllib
from collections.abc import Callable
from dataclasses import dataclass

from ..operators.contract import Contract


@dataclass(frozen=True)
class Route:
    route_id: bytes
    stream_id: bytes
    cipher: str
    guarantee: str
    channel: str
    onboarding: Contract
    offloading: Contract
    keys: dict[str, str]


def _hex(text: str, size: int, name: str) -> bytes:
    raw = bytes.fromhex(text)
    if len(raw) != size:
        raise ValueError(f"{name} must have {size} bytes")
    return raw


def _contract(section: dict, name: str) -> Contract:
    most = section.get("max_record_len")
    if not isinstance(most, int) or most <= 0:
        raise ValueError(f"{name}.max_record_len must be a positive number")
    return Contract(most, str(section.get("required_prefix", "")).encode())


def parse(text: str) -> Route:
    """A route file. Both contracts must be the same, or every envelope would be quarantined. A key given twice is an error."""
    data = tomllib.loads(text)
    route = data["route"]
    out = Route(
        _hex(route["route_id"], 16, "route_id"), _hex(route["stream_id"], 16, "stream_id"), route.get("cipher", "aes-256-gcm"), route.get("guarantee", "exactly-once"), route.get("substrate", "loopback"),
        _contract(data["onboarding"], "onboarding"), _contract(data["offloading"], "offloading"), dict(data.get("keys", {})),
    )
    if out.onboarding.fingerprint != out.offloading.fingerprint:
        raise ValueError("onboarding and offloading contracts differ")
    if out.guarantee not in ("exactly-once", "at-least-once", "effectively-once"):
        raise ValueError(f"unknown guarantee {out.guarantee}")
    return out


def resolve_key(reference: str, size: int = 32, environment: dict[str, str] | None = None) -> bytes:
    """Key material of `env:NAME`, `file:PATH` (no step upwards) or plain hex; on the driver only, never in a column."""
    kind, _, rest = reference.partition(":")
    if kind == "env":
        text = (environment if environment is not None else os.environ)[rest]
    elif kind == "file":
        if ".." in rest.split("/"):
            raise ValueError("a key file's path may not step upwards")
        with open(rest) as f:
            text = f.read().strip()
    else:
        text = reference
    return _hex(text, size, "key")


class Providers:
    """Key providers by the first part of a reference, as in `vault:NAME`; the one added last is asked first, then `resolve_key`."""

    def __init__(self) -> None:
        self._chain: list[tuple[str, Callable[[str], str | None]]] = []

    def add(self, kind: str, provider: Callable[[str], str | None]) -> "Providers":
        self._chain.insert(0, (kind, provider))
        return self

    def resolve(self, reference: str, size: int = 32) -> bytes:
        kind, _, rest = reference.partition(":")
        for own, provider in self._chain:
            if own == kind and (text := provider(rest)) is not None:
                return _hex(text, size, "key")
        return resolve_key(reference, size)


def same_secret(a: bytes, b: bytes) -> bool:
    """Whether two secrets are equal, in a time that doesn't tell where they differ. For the driver; columns are compared as usual."""
    return hmac.compare_digest(a, b)
