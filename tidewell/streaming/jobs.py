"""The work queue as streams: politeness slots, job states and averages that outlive a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fixed value: how long an idle origin is remembered.
IDLE_MS = 45_000


def slots(requests: DataFrame, delay_ms: int) -> DataFrame:
    """Streaming form of ``schedule.politeness_slots``: (origin, seq, now_ms) -> slot_ms.

    State per origin is one number, when it may be asked next. Rows of a
    micro-batch are taken by seq; an origin idle for IDLE_MS of processing
    time is forgotten.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("seq")
        free = state.get[0] if state.exists else None
        out = []
        for now in rows["now_ms"]:
            slot = int(now) if delay_ms <= 0 or free is None else max(int(now), free)
            free = slot + delay_ms
            out.append(slot)
        state.update((free,))
        state.setTimeoutDuration(IDLE_MS)
        yield pd.DataFrame({"origin": key[0], "seq": rows["seq"].to_numpy(), "now_ms": rows["now_ms"].to_numpy(), "slot_ms": out})

    return requests.groupBy("origin").applyInPandasWithState(step, "origin string, seq long, now_ms long, slot_ms long", "free long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def states(events: DataFrame) -> DataFrame:
    """Latest state per job, as a streaming aggregate (update or complete mode)."""
    return events.groupBy("job_id").agg(F.max_by("type", "seq").alias("state"), F.count("*").alias("n_events"))


def fresh_links(links: DataFrame, late: str = "1 hour") -> DataFrame:
    """Links seen for the first time: (url, seen_at) without repeats, state bounded by the watermark."""
    return links.withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["url"])
