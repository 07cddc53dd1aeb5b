"""The work list of wanted documents as a stateful stream: each (space, doc_id) goes from pending to requested to served. Requests that
aren't answered in time are pending again; after the list's time has run out, what is still requested counts as served."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quernstone.operators.maintain import EXPIRE_S, PENDING, REFETCH_S, REQUESTED, SERVED

OUT = "space string, doc_id string, state int, at double, reason string"
STATE = "state int, updated long, listed double, requested double"


def step(state: tuple | None, event: str, updated: int, at: float) -> tuple[tuple | None, str]:
    """(state, updated, listed, requested) after an event at a time, and why it changed ('' if it didn't). wanted: listed, if new or of another
    version once served; requested; served."""
    if event == "wanted" and (state is None or (state[0] == SERVED and updated != state[1])):
        return (PENDING, updated, at, at), "wanted"
    if state is None:
        return None, ""
    if event == "requested" and state[0] == PENDING:
        return (REQUESTED, state[1], state[2], at), "requested"
    if event == "served" and state[0] != SERVED:
        return (SERVED, *state[1:]), "served"
    return state, ""


def expired(state: tuple, at: float) -> tuple[tuple, str]:
    """What time does to a requested document."""
    if state[0] == REQUESTED and at - state[2] > EXPIRE_S:
        return (SERVED, *state[1:]), "given up"
    if state[0] == REQUESTED and at - state[3] >= REFETCH_S:
        return (PENDING, *state[1:]), "asked too long ago"
    return state, ""


def _group(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
    state = tuple(kept.get) if kept.exists else None
    out = []
    events = [] if kept.hasTimedOut else sorted(r for b in batches for r in zip(b["at"], b["n"], b["event"], b["updated"]))
    for at, _, event, updated in events:
        if state:
            state, why = expired(state, at)
            if why:
                out.append((*key, state[0], at, why))
        state, why = step(state, event, updated, at)
        if why:
            out.append((*key, state[0], at, why))
    if kept.hasTimedOut and state:
        at = kept.getCurrentWatermarkMs() / 1000
        state, why = expired(state, at)
        if why:
            out.append((*key, state[0], at, why))
    if state:
        kept.update(state)
        if state[0] == REQUESTED:
            due = min(state[3] + REFETCH_S, state[2] + EXPIRE_S + 0.001)
            kept.setTimeoutTimestamp(max(int(due * 1000) + 1, kept.getCurrentWatermarkMs() + 1))
    if out:
        yield pd.DataFrame(out, columns=["space", "doc_id", "state", "at", "reason"])


def transitions(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """events: space, doc_id, event (wanted, requested, served), updated, n (order within a time), ts. Each change of a document's state."""
    rows = events.withWatermark("ts", late).select("space", "doc_id", "event", "updated", "n", "ts", (F.unix_micros("ts") / 1e6).alias("at"))
    return rows.groupBy("space", "doc_id").applyInPandasWithState(_group, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
