"""Failure streaks of a stream of download results, as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STREAK = "feed string, ts long, failures long, failure_started long"
STATE = "ts long, failures long, failure_started long"


def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The streak of one feed after more results; those that aren't later than the last one are passed over."""
    last, failures, started = state.get if state.exists else (-1, 0, 0)
    rows = sorted({(int(t), p, bool(ok)) for frame in frames for t, p, ok in zip(frame["ts"], frame["pos"], frame["ok"], strict=True)}, key=lambda r: (r[1], r[0]))
    for ts, _, ok in rows:
        if ts <= last:
            continue
        last = ts
        if ok:
            failures, started = 0, 0
        else:
            failures, started = failures + 1, started if failures else ts
    state.update((last, failures, started))
    yield pd.DataFrame({"feed": [key[0]], "ts": [last], "failures": [failures], "failure_started": [started]})


def follow(results: DataFrame) -> DataFrame:
    """A stream of ``STREAK`` rows, one per feed and batch that has results ``feed, ts, ok, pos`` of it.

    ``pos`` is the order in which results arrived. Spark keeps the state in the query's checkpoint, so a
    restarted query goes on from there.
    """
    return results.select("feed", "ts", "ok", "pos").groupBy("feed").applyInPandasWithState(advance, STREAK, STATE, "update", GroupStateTimeout.NoTimeout)
