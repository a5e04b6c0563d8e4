"""Consumer group membership as a stream.

A join window ends with the first event at or after its deadline; with timers, also when the stream's time has passed it,
and members expire when it has passed their sessions, though their group is silent.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..model import REBALANCE_MS
from ..operators.groups import Coordinator

OUT = "group string, ord long, kind string, member string, code int, state string, current_generation int, leader string, members int"
STATE = "state string, generation int, leader string, deadline long, members array<string>, seen array<long>, sessions array<int>"
COLUMNS = ["group", "ord", "kind", "member", "code", "state", "current_generation", "leader", "members"]


def membership_stream(events: DataFrame, window_ms: int = REBALANCE_MS, timers: bool = False, late: str = "0 seconds") -> DataFrame:
    """Streaming membership(): events (ord, now_ms, kind, group, member, generation, session_ms) -> the group's answers.

    The state of a group is its members and their sessions. Within a micro-batch events are taken in order of `ord`. With
    timers the stream's time is the greatest now_ms so far, less `late`; a timer's row has the kind `timer` and the time as `ord`.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        g = Coordinator(window_ms)
        if state.exists:
            g.state, g.generation, g.leader, g.deadline, members, seen, sessions = state.get
            g.seen, g.session = dict(zip(members, seen)), dict(zip(members, sessions))
        out = []
        if state.hasTimedOut:
            now = state.getCurrentWatermarkMs()
            g.tick(now)
            out.append((key[0], now, "timer", None, 0, g.state, g.generation, g.leader, len(g.seen)))
        else:
            for e in pd.concat(list(parts)).sort_values("ord", kind="stable").itertuples(index=False):
                code = g.apply(int(e.now_ms), e.kind, e.member, int(e.generation), int(e.session_ms))
                out.append((key[0], int(e.ord), e.kind, e.member, code, g.state, g.generation, g.leader, len(g.seen)))
        state.update((g.state, g.generation, g.leader, g.deadline, list(g.seen), list(g.seen.values()), list(g.session.values())))
        due = g.next_due()
        if timers and due is not None:
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=COLUMNS)

    if not timers:
        return events.groupBy("group").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
    timed = events.withColumn("at", F.timestamp_millis("now_ms")).withWatermark("at", late)
    return timed.groupBy("group").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
