"""Forward outcomes of live entries, equal to the batch form for any cut into micro-batches.

Rows of a (symbol, session) wait in a list state until the watermark passes them; timers at their times release them in
time order, so the order of arrival inside the watermark does not matter. Open entries are a second list state; timers
at their horizon (capped at the session close) end them even when no further bar comes. Spark drops rows that arrive
behind the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTCOME = "symbol string, session string, entry_ts timestamp, barrier string, ttr double, realized_return double"
_BAR = "u bigint, high double, low double, close double, atr double, until bigint"
#: Time of the entry, its last moment, reference and ATR, and the newest bar of its path (0: none yet).
_ENTRY = "u bigint, until bigint, ref double, atr double, last bigint, last_close double"
_MINUTE = 60_000_000


class ForwardOutcomes(StatefulProcessor):
    def __init__(self, k: float, horizon_minutes: int):
        self.k, self.horizon = k, horizon_minutes * _MINUTE

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _BAR)
        self.open = handle.getListState("open", _ENTRY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = set()
        for part in rows:
            u = part["ts"].astype("datetime64[us]").astype("int64")
            close = part["session_close"].astype("datetime64[us]").astype("int64")
            self.waiting.appendList(list(zip(u.tolist(), part["high"].tolist(), part["low"].tolist(), part["close"].tolist(),
                                             part["atr"].fillna(0.0).tolist(), np.minimum(u + self.horizon, close).tolist())))
            due.update((-(-u // 1000)).tolist())
        for at in due:
            self.handle.registerTimer(int(at))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for r in self.waiting.get())
        ready = [r for r in rows if r[0] <= now]
        if len(ready) < len(rows):
            self.waiting.put(rows[len(ready):])
        elif rows:
            self.waiting.clear()
        fresh = [(u, until, close, atr, 0, 0.0) for u, _, _, close, atr, until in ready if atr > 0]
        done, still = self._advance([*(tuple(r) for r in self.open.get()), *fresh], ready, now)
        if still:
            self.open.put(still)
        else:
            self.open.clear()
        for e in fresh:
            self.handle.registerTimer(int(-(-e[1] // 1000)))
        if done:
            frame = pd.DataFrame(done, columns=["entry_ts", "barrier", "ttr", "realized_return"])
            frame["entry_ts"] = pd.to_datetime(frame["entry_ts"], unit="us")
            frame.insert(0, "session", key[1])
            frame.insert(0, "symbol", key[0])
            yield frame

    def _advance(self, entries, bars, now):
        """Outcomes of the entries that end with these bars or by `now`, and the entries that stay open."""
        u, high, low, close = (np.array([b[i] for b in bars]) for i in range(4))
        done, still = [], []
        for start, until, ref, atr, last, last_close in entries:
            path = slice(int(np.searchsorted(u, start, "right")), int(np.searchsorted(u, until, "right"))) if len(u) else slice(0, 0)
            stop = np.flatnonzero(-(low[path] - ref) / atr >= self.k)[:1] if len(u) else []
            profit = np.flatnonzero((high[path] - ref) / atr >= self.k)[:1] if len(u) else []
            move = self.k * atr / ref
            # The same bar touching both sides is a stop.
            if len(stop) and (not len(profit) or stop[0] <= profit[0]):
                done.append((start, "STOP", (u[path][stop[0]] - start) / _MINUTE, -move))
                continue
            if len(profit):
                done.append((start, "PROFIT", (u[path][profit[0]] - start) / _MINUTE, move))
                continue
            if path.stop > path.start:
                last, last_close = int(u[path][-1]), float(close[path][-1])
            if now >= until:
                # As in the batch form, an entry without a path has no outcome.
                if last:
                    done.append((start, "TIME", (last - start) / _MINUTE, (last_close - ref) / ref))
            else:
                still.append((start, until, ref, atr, last, last_close))
        return done, still

    def close(self) -> None:
        pass


def forward_outcomes(feed: DataFrame, k: float, horizon_minutes: int, watermark: str = "5 minutes") -> DataFrame:
    """Resolve live entries against the following bars of their session.

    `feed` carries both kinds of rows: symbol, session, session_close, ts, close, high, low, atr (set on entry bars, NULL
    elsewhere). The path of an entry ends at its horizon or the session close. State needs the RocksDB store, which is
    set for the session here.
    """
    feed.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass",
                               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = feed.select("symbol", "session", "session_close", "ts", "close", "high", "low", "atr").withWatermark("ts", watermark)
    return rows.groupBy("symbol", "session").transformWithStateInPandas(
        ForwardOutcomes(k, horizon_minutes), OUTCOME, "append", "EventTime")
