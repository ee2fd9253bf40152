"""The ledger's keyed state machine over a stream of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veritally.operators.ledger import CAPS

STATE = "attempts long, status string, claims long"
OUTPUT = "key string, attempts long, status string, claims long, refused long"


def _step(attempts: int, status: str, event: str, cap: int) -> tuple[int, str]:
    if event == "claim" and status not in ("running", "complete") and attempts < cap:
        return attempts + 1, "running"
    if status == "running" and event in ("finish", "fail"):
        return attempts, "complete" if event == "finish" else "failed"
    return attempts, status


def replay(events: DataFrame) -> DataFrame:
    """The state of each key that a micro-batch touches; events of a batch are taken in order of time.

    State is a few numbers a key. The limit on keys in flight is global and stays with the batch replay.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempts, status, claims = state.get if state.exists else (0, "new", 0)
        cap = next((n for prefix, n in CAPS.items() if key[0].startswith(prefix)), 3)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        for event in rows["event"]:
            claims += event == "claim"
            attempts, status = _step(attempts, status, event, cap)
        state.update((attempts, status, claims))
        yield pd.DataFrame({"key": [key[0]], "attempts": [attempts], "status": [status], "claims": [claims], "refused": [claims - attempts]})

    return events.groupBy("key").applyInPandasWithState(update, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)
