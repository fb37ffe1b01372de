"""Admission limits on a stream: keyed state with a time-to-live."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from timberline.operators.series import Bucket, Sliding


def _timeout(expire: bool) -> str:
    """A run over what is there now (availableNow) never ends while processing-time timers are pending; it does without."""
    return GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout


def sliding(events: DataFrame, by: str, most: int, window: float, expire: bool = True) -> DataFrame:
    """T07, T09 on a stream of (by, id bigint, t double seconds): by, id, t, admitted. A key's state is the times of its
    admitted calls, at most `most`, and goes when the key is idle for longer than the window."""
    kind = dict(events.dtypes)[by]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rule = Sliding(most, window)
        if state.exists:
            rule.seen = deque(state.get[0])
        p = pd.concat(list(parts)).sort_values(["t", "id"])
        p["admitted"] = [rule.admit(t) for t in p["t"].tolist()]
        state.update((list(rule.seen),))
        if expire:
            state.setTimeoutDuration(max(1, int(window * 1000)))
        yield p[[by, "id", "t", "admitted"]]

    return events.groupBy(by).applyInPandasWithState(run, f"`{by}` {kind}, id bigint, t double, admitted boolean", "seen array<double>", "append", _timeout(expire))


def bucket(events: DataFrame, by: str, most: int, window: float, expire: bool = True) -> DataFrame:
    """T08 on a stream; a key's state is its tokens and the time of its last call."""
    kind = dict(events.dtypes)[by]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rule = Bucket(most, window)
        if state.exists:
            rule.tokens, rule.at = state.get[0]
        p = pd.concat(list(parts)).sort_values(["t", "id"])
        p["admitted"] = [rule.admit(t) for t in p["t"].tolist()]
        state.update(([rule.tokens, rule.at],))
        if expire:
            state.setTimeoutDuration(max(1, int(window * 1000)))
        yield p[[by, "id", "t", "admitted"]]

    return events.groupBy(by).applyInPandasWithState(run, f"`{by}` {kind}, id bigint, t double, admitted boolean", "bucket array<double>", "append", _timeout(expire))
