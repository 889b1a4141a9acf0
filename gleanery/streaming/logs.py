"""A step log that rewinds as it arrives: custom state per key with an event-time timer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rewinding_changes(rows: DataFrame, key: str, order: str, step: str, time: str | None = None, idle_ms: int | None = None) -> DataFrame:
    """Changes of each key's log on a stream: key, order, step and kept, true for a row that joins the log and false for
    one that a later row of the same or a lesser step takes back.

    Rows of a micro-batch are taken by order; between batches the order of arrival counts. The state of a key is its log
    as it stands: steps that rise, each with its order, so a row that is taken back is forgotten. With ``time`` (watermarked)
    and ``idle_ms`` a key's log is closed when the watermark passes its last row by that; a later row begins a new one.
    """

    def update(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        orders, steps = (list(x) for x in state.get) if state.exists else ([], [])
        new = pd.concat(list(frames)).sort_values(order)
        before, lost = len(orders), []  # of the log, so many rows are of earlier batches
        for o, s in zip(new[order].tolist(), new[step].tolist(), strict=True):
            while steps and steps[-1] >= s:
                back = orders.pop(), steps.pop()
                if len(orders) < before:
                    lost.append(back)
                    before = len(orders)
            orders.append(o)
            steps.append(s)
        state.update((orders, steps))
        if idle_ms is not None:
            last = int(new["_time"].max())
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_ms)
        told = [*((o, s, False) for o, s in lost), *((o, s, True) for o, s in zip(orders[before:], steps[before:], strict=True))]
        if told:
            yield pd.DataFrame({key: group[0], order: [x[0] for x in told], step: [x[1] for x in told], "kept": [x[2] for x in told]})

    kinds = [rows.schema[c].dataType.simpleString() for c in (key, order, step)]
    held = rows if time is None else rows.withColumn("_time", F.unix_millis(F.col(time)))
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.EventTimeTimeout
    return held.groupBy(key).applyInPandasWithState(update, f"{key} {kinds[0]}, {order} {kinds[1]}, {step} {kinds[2]}, kept boolean", f"orders array<{kinds[1]}>, steps array<{kinds[2]}>", "append", timeout)


def settled_log(changes: DataFrame, key: str, order: str, step: str) -> DataFrame:
    """The log that changes add up to: rows that joined and were not taken back."""
    return changes.groupBy(key, order, step).agg(F.bool_and("kept").alias("_kept")).filter("_kept").drop("_kept")
