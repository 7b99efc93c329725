"""Cooldowns over a stream (an extension): per provider, whether each event falls into a cooldown.

Keyed state holds one number a provider, the end of its cooldown, so state is bounded by the number
of providers. Events of a provider are taken in time order within a micro-batch; a limit event
sets a new end, the latest mark holding.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "provider string, event_id long, ts timestamp, blocked boolean"


def stream_cooldowns(events: DataFrame, seconds: float) -> DataFrame:
    """`events` has provider, event_id, ts and is_limit; append mode. Ends of cooldowns are whole microseconds, as
    timestamps are. An event that comes in a later micro-batch than its time is judged by the state it meets."""
    wait = round(seconds * 1e6)

    def step(key, batches, state: GroupState):
        until = state.get[0] if state.exists else None
        rows = pd.concat([b for b in batches if len(b)], ignore_index=True).sort_values(["ts", "event_id"])
        blocked = []
        for ts, limit in zip(rows["ts"], rows["is_limit"]):
            now = ts.value // 1000
            blocked.append(until is not None and until > now)
            if limit:
                until = now + wait
        if until is not None:
            state.update((until,))
        yield pd.DataFrame({"provider": key[0], "event_id": rows["event_id"], "ts": rows["ts"], "blocked": blocked})

    return events.groupBy("provider").applyInPandasWithState(step, OUT, "until long", "append", GroupStateTimeout.NoTimeout)
