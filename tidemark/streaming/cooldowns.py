"""Provider cooldowns as a stream: failures put a provider to rest for a time, later calls report whether it rests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

OUT = "provider string, at timestamp, outcome string, resting boolean, reason string"
STATE = "until double, reason string"


def provider_cooldowns(calls: DataFrame, quota_seconds: float = 3600, failure_seconds: float = 300) -> DataFrame:
    """For each call (provider, at, outcome: ok, failure or quota): whether its provider was resting when it was made.

    State is kept by provider and given up after a day of event time without a call; calls of a batch are read in time order."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until, reason = state.get if state.exists else (0.0, "")
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        out = []
        for r in rows.itertuples():
            now = r.at.timestamp()
            resting = until > now
            if not resting:
                until, reason = 0.0, ""
            out.append((key[0], r.at, r.outcome, resting, reason))
            if r.outcome in ("quota", "failure"):
                until, reason = now + (quota_seconds if r.outcome == "quota" else failure_seconds), "quota_exhausted" if r.outcome == "quota" else "provider_failure"
        state.update((until, reason))
        state.setTimeoutTimestamp(int(rows["at"].max().timestamp() * 1000) + 86_400_000)
        yield pd.DataFrame(out, columns=["provider", "at", "outcome", "resting", "reason"])

    return calls.select("provider", "at", "outcome").withWatermark("at", "1 hour").groupBy("provider").applyInPandasWithState(step, OUT, STATE, "append", "EventTimeTimeout")
