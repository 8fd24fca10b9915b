"""Streams of series: event-time bins, frozen transforms, rolling windows, features from the last rows."""

from __future__ import annotations

import io
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.transforms import Fitted


def stream_resample(stream: DataFrame, key: str, ts: str, step: str, cols: list[str], delay: str = "1 hour") -> DataFrame:
    """Tumbling bins with the first non-NULL value of each column; rows later than ``delay`` are dropped. Append mode."""
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(c) for c in cols]
    bins = stream.withWatermark(ts, delay).groupBy(key, F.window(ts, step).alias("_w")).agg(*first)
    return bins.select(key, F.col("_w.start").alias(ts), *cols)


def stream_apply(stream: DataFrame, *fitted: Fitted) -> DataFrame:
    """Fitted transforms (clip, scale) with frozen statistics: no state."""
    for f in fitted:
        stream = f.transform(stream)
    return stream


def stream_rolling(stream: DataFrame, key: str, ts: str, col: str, size: str, slide: str, delay: str = "1 hour") -> DataFrame:
    """``key, start, end, n, mean, min, max`` of sliding windows."""
    w = stream.withWatermark(ts, delay).groupBy(key, F.window(ts, size, slide).alias("_w"))
    out = w.agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.min(col).alias("min"), F.max(col).alias("max"))
    return out.select(key, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n", "mean", "min", "max")


def stream_transform_tail(stream: DataFrame, key: str, ts: str, cols: list[str], need: int, change: Callable[[pd.DataFrame], pd.DataFrame], out_schema: str, delay: str = "1 hour", idle: str | None = None) -> DataFrame:
    """``change`` (a function of a series' rows in time order, adding columns) over a stream.

    The state of a key is its last ``need`` rows, so its size is bounded; each batch is put in time
    order after them, changed, and only its own rows are emitted. With ``idle`` a key that is silent
    that long (event time) is forgotten.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        new = pd.concat(list(batches)).sort_values(ts)
        if state.exists:
            old = pd.read_json(io.StringIO(state.get[0]), orient="split", convert_dates=[ts], dtype=False)
            old[ts] = old[ts].astype(new[ts].dtype)
        else:
            old = new.iloc[:0]
        rows = pd.concat([old, new]) if len(old) else new
        rows = rows.reset_index(drop=True)
        out = change(rows).iloc[len(old) :]
        if need:
            keep = rows[[key, ts, *cols]].iloc[-need:]
            state.update((keep.to_json(orient="split", date_format="iso", date_unit="us", index=False),))
        if idle:
            state.setTimeoutTimestamp(int(new[ts].max().timestamp() * 1000) + int(pd.Timedelta(idle).total_seconds() * 1000))
        yield out

    timeout = GroupStateTimeout.EventTimeTimeout if idle else GroupStateTimeout.NoTimeout
    rows = stream.withWatermark(ts, delay).select(key, ts, *cols) if idle else stream.select(key, ts, *cols)
    return rows.groupBy(key).applyInPandasWithState(step, out_schema, "rows string", "append", timeout)


def stream_in_event_time(stream: DataFrame, key: str, ts: str, cols: list[str], need: int, change: Callable[[pd.DataFrame], pd.DataFrame], out_schema: str, delay: str = "1 hour", idle: str | None = None) -> DataFrame:
    """``change`` (as for stream_transform_tail()) over the rows of each series in event time, however they arrive.

    A row waits in its key's state until the watermark, ``delay`` behind the newest time, has passed
    it: then no earlier row can come. A timer at the first waiting time wakes a key without new rows.
    What is emitted equals ``change`` over the whole series, in batches. The state is the last
    ``need`` rows that were emitted and those that wait. Rows that come after the watermark are left out and
    counted by Spark in the query's progress (``numRowsDroppedByWatermark``). Rows of equal times keep
    the order of arrival. With ``idle`` a key with no waiting row is forgotten that long after its last.
    """

    names = [key, ts, *cols]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # columns as arrays: a key's rows are few, and frames of them would cost more than the work
        old, waiting = map(pickle.loads, state.get) if state.exists else (None, None)
        parts = [x for x in (waiting, *([b[c].to_numpy() for c in names] for b in batches)) if x is not None and len(x[0])]
        mark = state.getCurrentWatermarkMs()
        if not parts:  # woken with nothing to do: silent for long
            state.remove()
            return
        rows = _stacked(parts)
        passed = rows[1] <= np.datetime64(mark, "ms")
        ready, left = ([c[some] for c in rows] for some in (passed, ~passed))
        n = len(ready[1])
        if n:
            order = np.argsort(ready[1], kind="stable")
            ready = [c[order] for c in ready]
            tail = _stacked([x for x in (old, ready) if x is not None and len(x[0])])
            old = [c[max(0, len(c) - need) :] for c in tail]
        state.update((pickle.dumps(old, 5), pickle.dumps(left, 5)))
        if len(left[1]):
            state.setTimeoutTimestamp(max(mark + 1, _milliseconds(np.fmin.reduce(left[1]))))
        elif idle:
            state.setTimeoutTimestamp(max(mark + 1, _milliseconds(rows[1].max()) + int(pd.Timedelta(idle).total_seconds() * 1000)))
        if n:
            yield change(pd.DataFrame(dict(zip(names, tail, strict=True)))).iloc[len(tail[0]) - n :]

    rows = stream.withWatermark(ts, delay).select(key, ts, *cols)
    return rows.groupBy(key).applyInPandasWithState(step, out_schema, "tail binary, waiting binary", "append", GroupStateTimeout.EventTimeTimeout)


def _stacked(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The columns of some rows after each other."""
    return parts[0] if len(parts) == 1 else [np.concatenate(c) for c in zip(*parts, strict=True)]


def _milliseconds(t: np.datetime64) -> int:
    """Since the epoch, rounded up."""
    return -(-int(t.astype("datetime64[ns]").astype(np.int64)) // 1_000_000)
