"""Consumer groups: protocols, assignments, sessions, and the membership state machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..model import ILLEGAL_GENERATION, REBALANCE, REBALANCE_MS, UNKNOWN_MEMBER

EMPTY, PREPARING, COMPLETING, STABLE = "Empty", "PreparingRebalance", "CompletingRebalance", "Stable"


def protocol(members: DataFrame, group: str = "group", member: str = "member", protocols: str = "protocols") -> DataFrame:
    """The first protocol of the smallest member's list that all members have; if there is none, its first."""
    votes = members.select(group, member, F.explode(F.array_distinct(protocols)).alias("p")).groupBy(group, "p").agg(F.count("*").alias("n"))
    size = members.groupBy(group).agg(F.count("*").alias("size"), F.min_by(protocols, member).alias("first"))
    common = votes.join(size, group).where("n = size").groupBy(group).agg(F.collect_set("p").alias("common"))
    return size.join(common, group, "left").select(group, F.coalesce(F.get(F.filter("first", lambda p: F.array_contains("common", p)), F.lit(0)), F.get("first", F.lit(0))).alias("protocol"))


def assigned(assignments: DataFrame, members: DataFrame, keys: tuple[str, ...] = ("group", "member")) -> DataFrame:
    """The leader's assignments of members that exist; others are ignored."""
    return assignments.join(members.select(*keys).distinct(), list(keys))


def expired(heartbeats: DataFrame, now: Column, timeout: Column, keys: tuple[str, ...] = ("group", "member"), at: str = "at") -> DataFrame:
    return heartbeats.groupBy(*keys).agg(F.max(at).alias("last"), F.max(timeout).alias("__timeout")).where(now - F.col("last") >= F.col("__timeout")).drop("__timeout")


def heartbeat_code(member_known: Column, generation: Column, current: Column, state: Column) -> Column:
    """In this order: unknown member, wrong generation, rebalance under way, fine."""
    return F.when(~member_known, UNKNOWN_MEMBER).when(generation != current, ILLEGAL_GENERATION).when(state != STABLE, REBALANCE).otherwise(0)


class Coordinator:
    """One group. Events come with their time; a join opens a window, at whose end the generation's members are fixed."""

    def __init__(self, window_ms: int = REBALANCE_MS):
        self.window, self.state, self.generation, self.leader, self.deadline = window_ms, EMPTY, 0, None, None
        self.seen: dict[str, int] = {}
        self.session: dict[str, int] = {}

    def _finish(self, now: int) -> None:
        if self.state == PREPARING and self.deadline is not None and now >= self.deadline:
            self.state, self.leader, self.deadline = (COMPLETING, min(self.seen), None) if self.seen else (EMPTY, None, None)

    def _expire(self, now: int) -> None:
        for m in [m for m, at in self.seen.items() if now - at >= self.session[m]]:
            del self.seen[m], self.session[m]
        if not self.seen:
            self.state, self.leader = EMPTY, None
        elif self.leader is not None and self.leader not in self.seen:
            self.leader = min(self.seen)

    def _reopen(self, now: int) -> None:
        self.generation += 1
        self.state, self.deadline = PREPARING, now + self.window

    def tick(self, now: int) -> None:
        """What time alone does: a join window ends, members expire."""
        self._finish(now)
        before = len(self.seen)
        self._expire(now)
        if self.seen and len(self.seen) < before and self.state != PREPARING:
            self._reopen(now)

    def next_due(self) -> int | None:
        """When time alone next does something."""
        ends = [at + self.session[m] for m, at in self.seen.items()]
        return min([*ends, *([self.deadline] if self.deadline is not None else [])], default=None)

    def apply(self, now: int, kind: str, member: str, generation: int = -1, session_ms: int = 10_000) -> int:
        """The event's answer: 0, or an error code. Joins and heartbeats look for expired members first."""
        self._finish(now)
        if kind in ("join", "heartbeat"):
            self._expire(now)
        if kind == "join":
            self.seen[member], self.session[member] = now, session_ms
            if self.state != PREPARING:
                self._reopen(now)
            return 0
        if member not in self.seen:
            return UNKNOWN_MEMBER
        if kind == "leave":
            del self.seen[member], self.session[member]
            if self.seen:
                self._reopen(now)
                if self.leader == member:
                    self.leader = min(self.seen)
            else:
                self.state, self.leader, self.deadline = EMPTY, None, None
            return 0
        if kind == "heartbeat":
            self.seen[member] = now
        if generation != self.generation:
            return ILLEGAL_GENERATION
        if kind == "sync":
            if self.state == PREPARING:
                return REBALANCE
            if member == self.leader:
                self.state = STABLE
            return 0
        return 0 if self.state == STABLE else UNKNOWN_MEMBER if self.state == EMPTY else REBALANCE


def membership(events: DataFrame, window_ms: int = REBALANCE_MS) -> DataFrame:
    """Events (ord, now_ms, kind, group, member, generation, session_ms) -> the same with the group's answer and state after it."""
    schema = events.schema
    for name, kind in (("code", "integer"), ("state", "string"), ("current_generation", "integer"), ("leader", "string"), ("members", "integer")):
        schema = schema.add(name, kind)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, group = object(), Coordinator(window_ms)
        for part in parts:
            out = []
            for e in part.itertuples(index=False):
                if e.group != now:
                    now, group = e.group, Coordinator(window_ms)
                code = group.apply(int(e.now_ms), e.kind, e.member, int(e.generation), int(e.session_ms))
                out.append((code, group.state, group.generation, group.leader, len(group.seen)))
            columns = zip(*out) if out else ([], [], [], [], [])
            yield part.assign(**dict(zip(("code", "state", "current_generation", "leader", "members"), columns)))

    return events.repartition("group").sortWithinPartitions("group", "ord").mapInPandas(run, schema)
