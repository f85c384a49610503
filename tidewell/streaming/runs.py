"""Runs of equal states on a stream: the streaming form of gaps and islands."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RUNS = "key string, run long, state string, n long, first timestamp, last timestamp"
_STATE = "times array<timestamp>, states array<string>, run long, state string, n long, first timestamp, last timestamp"


def stream_runs(events: DataFrame, key: str, time: str, state: str, late: str = "1 hour") -> DataFrame:
    """(key, run, state, n, first, last): runs of equal states of each key in the order of time, given once they are over.

    Rows wait until the watermark, `late` behind the latest time, has passed
    them: then no earlier row can come, and they are taken in order (ties by
    state). A run is over when a row of another state has been taken; a null
    state ends a run and makes none. Rows behind the watermark are dropped by
    the engine. A key's state is its waiting rows, as many as `late` lets in, and
    its open run; a timer at its earliest waiting row wakes it when no row comes.
    """
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("time"), F.col(state).cast("string").alias("state")).withWatermark("time", late)

    def step(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        times, states, run, now, n, first, last = held.get if held.exists else ([], [], 0, None, 0, None, None)
        waiting = [pd.DataFrame({"time": pd.to_datetime(pd.Series(list(times), dtype="datetime64[ns]")), "state": pd.Series(list(states), dtype=object)})]
        waiting += [f[["time", "state"]] for f in frames]
        rows_ = pd.concat(waiting, ignore_index=True)
        mark = pd.Timestamp(held.getCurrentWatermarkMs(), unit="ms")
        over = rows_[rows_["time"] < mark].sort_values(["time", "state"], kind="stable")
        rest = rows_[rows_["time"] >= mark]
        out = []
        for t, s in over.itertuples(index=False):
            s = None if s is None or s != s else s
            if n and s == now:
                n, last = n + 1, t
                continue
            if n and now is not None:
                out.append((k[0], run, now, n, first, last))
            run, now, n, first, last = run + 1, s, 1, t, t
        as_time = lambda x: None if x is None or pd.isna(x) else pd.Timestamp(x).to_pydatetime()
        held.update(([as_time(t) for t in rest["time"]], [None if s != s else s for s in rest["state"]], run, now, n, as_time(first), as_time(last)))
        if len(rest):
            held.setTimeoutTimestamp(max(int(rest["time"].min().value // 10**6) + 1, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "run", "state", "n", "first", "last"])

    return rows.groupBy("key").applyInPandasWithState(step, RUNS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
