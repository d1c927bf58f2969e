"""Confirmed byte ranges as keyed stream state: replays change nothing, and a session's state expires."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "session_id long, n_ranges int, covered_bytes long, n_receipts long"
STATE = "starts array<bigint>, ends array<bigint>, receipts bigint"


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ranges in order; those that overlap or touch are one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(r for r in ranges if r[0] < r[1]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def covered(receipts: DataFrame, ttl_ms: int = 3_600_000) -> DataFrame:
    """A row for each session and micro-batch with what its receipts (session_id, start_byte, end_byte) cover so far."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        starts, ends, n = state.get if state.exists else ([], [], 0)
        ranges = list(zip(starts, ends))
        for pdf in parts:
            ranges += zip(pdf["start_byte"].tolist(), pdf["end_byte"].tolist())
            n += len(pdf)
        ranges = merge(ranges)
        state.update(([r[0] for r in ranges], [r[1] for r in ranges], n))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"session_id": [key[0]], "n_ranges": [len(ranges)], "covered_bytes": [sum(e - s for s, e in ranges)], "n_receipts": [n]})

    return receipts.groupBy("session_id").applyInPandasWithState(update, OUTPUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)
