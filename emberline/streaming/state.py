"""Stateful processors by key: hysteresis of a reading, and a counter in windows that the first hit anchors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Seconds of trouble before demotion, and of calm before the better mode is offered again.
DEMOTE_AFTER_S, RESTORE_AFTER_S = 300, 1800


def demotion_step(state: tuple, at_s: int, bad: bool) -> tuple:
    """(mode, since) after a sample; since is when the run of samples against the mode began (-1: none)."""
    mode, since = state
    against = bad if mode == "full" else not bad
    if not against:
        return mode, -1
    since = at_s if since < 0 else since
    if at_s - since >= (DEMOTE_AFTER_S if mode == "full" else RESTORE_AFTER_S):
        return ("reduced" if mode == "full" else "full"), -1
    return mode, since


def demotions(samples: DataFrame) -> DataFrame:
    """key, at_s, mode after each sample (key, at_s, bad), a batch's samples in order of time; works on streams and tables."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else ("full", -1)
        rows = []
        for r in pd.concat(list(batches)).sort_values("at_s").itertuples(index=False):
            now = demotion_step(now, int(r.at_s), bool(r.bad))
            rows.append((key[0], int(r.at_s), now[0]))
        state.update(now)
        yield pd.DataFrame(rows, columns=["key", "at_s", "mode"])

    return samples.groupBy("key").applyInPandasWithState(run, "key string, at_s long, mode string", "mode string, since long", "append", GroupStateTimeout.NoTimeout)


def limiter_step(state: tuple, at_s: int, limit: int, window_s: int) -> tuple[tuple, bool]:
    """((window's first hit, hits), allowed) after a hit; a window ends window_s after its first hit."""
    first, n = state
    if first < 0 or at_s - first >= window_s:
        first, n = at_s, 0
    return (first, n + 1), n + 1 <= limit


def rate_limited(hits: DataFrame, limit: int, window_s: int) -> DataFrame:
    """key, at_s, allowed of each hit (key, at_s)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (-1, 0)
        rows = []
        for at_s in sorted(pd.concat(list(batches))["at_s"]):
            now, allowed = limiter_step(now, int(at_s), limit, window_s)
            rows.append((key[0], int(at_s), allowed))
        state.update(now)
        yield pd.DataFrame(rows, columns=["key", "at_s", "allowed"])

    return hits.groupBy("key").applyInPandasWithState(run, "key string, at_s long, allowed boolean", "first long, n long", "append", GroupStateTimeout.NoTimeout)
