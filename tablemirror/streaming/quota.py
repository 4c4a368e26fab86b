"""Replaying a sliding-window quota over an access log.

A request is limited when ``previous * (1 - elapsed part of the window) + current + cost``
exceeds the limit, where previous and current are the accepted costs of the last and of
this window. Limited requests do not count, so each decision depends on all before it: the
work is sequential in a client and parallel over clients.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "client string, ts_us bigint, cost double, used double, limited boolean"
_STATE = "window bigint, current double, previous double"


def step(state: tuple[int, float, float], ts: int, cost: float, window: int, limit: float) -> tuple[tuple[int, float, float], float, bool]:
    """State after a request, the use it was judged by, and whether it is limited."""
    number, current, previous = state
    now = ts // window
    if now != number:
        previous, current, number = (current if now == number + 1 else 0.0), 0.0, now
    used = previous * (1 - (ts % window) / window) + current
    limited = used + cost > limit
    return (number, current if limited else current + cost, previous), used, limited


def replay(requests: Iterable[tuple[int, float]], window: int, limit: float, state: tuple[int, float, float] = (-1, 0.0, 0.0)) -> Iterator[tuple]:
    for ts, cost in requests:
        state, used, limited = step(state, ts, cost, window, limit)
        yield state, ts, cost, used, limited


def quota_replay(log: DataFrame, client: str, ts_us: str, cost: str, window_us: int, limit: float, tie: str) -> DataFrame:
    """Decision for every request of a log.

    Rows are dealt by client and sorted, and each task streams through its clients with
    one client's three numbers in hand, so a client with a third of all requests needs
    time but no memory. Requests at one time are taken in order of ``tie``.
    """
    rows = log.select(F.col(client).cast("string").alias("client"), F.col(ts_us).alias("ts_us"), F.col(cost).cast("double").alias("cost"), F.col(tie).alias("__tie"))
    sorted_rows = rows.repartition("client").sortWithinPartitions("client", "ts_us", "__tie")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, last = (-1, 0.0, 0.0), None
        for frame in batches:
            used, limited = [], []
            for who, ts, price in zip(frame["client"], frame["ts_us"], frame["cost"], strict=True):
                if who != last:
                    state, last = (-1, 0.0, 0.0), who
                state, u, out = step(state, ts, price, window_us, limit)
                used.append(u)
                limited.append(out)
            yield frame[["client", "ts_us", "cost"]].assign(used=used, limited=limited)

    return sorted_rows.mapInPandas(run, _OUT)


def quota_stream(
    stream: DataFrame, client: str, ts_us: str, cost: str, window_us: int, limit: float, idle_ms: int = 3_600_000, tie: str | None = None
) -> DataFrame:
    """The same over a stream.

    Time is the requests' own, never the clock's: a client's state is dropped when the
    newest request of all is ``idle_ms`` past its last one, by which time both windows are
    empty if ``idle_ms`` is at least two windows (else it is refused). In a batch requests
    are taken in order of time and ``tie``; between batches in order of arrival. A request
    that comes more than ``idle_ms`` late is dropped by the watermark.
    """
    if idle_ms * 1000 < 2 * window_us:
        raise ValueError("a client's state has to be kept for two windows at least")
    ahead = idle_ms + 1  # the first watermark is the epoch, and a log may begin there
    rows = stream.select(
        F.col(client).cast("string").alias("client"), F.col(ts_us).cast("long").alias("ts_us"), F.col(cost).cast("double").alias("cost"),
        (F.col(tie) if tie else F.lit(0)).alias("tie"), F.timestamp_micros(F.col(ts_us).cast("long") + 1000 * ahead).alias("at"),
    ).withWatermark("at", f"{idle_ms} milliseconds")

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else (-1, 0.0, 0.0)
        requests = pd.concat(list(frames)).sort_values(["ts_us", "tie"], kind="stable")
        out = list(replay(zip(requests["ts_us"], requests["cost"], strict=True), window_us, limit, held))
        held, last = out[-1][0], int(requests["ts_us"].max())
        yield pd.DataFrame([(key[0], ts, c, u, lim) for _, ts, c, u, lim in out], columns=["client", "ts_us", "cost", "used", "limited"])
        state.update(held)
        state.setTimeoutTimestamp(max(last // 1000 + ahead + idle_ms, state.getCurrentWatermarkMs()) + 1)

    return rows.groupBy("client").applyInPandasWithState(run, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
