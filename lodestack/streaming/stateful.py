"""Keyed state of the change feed: debounced batches of scopes and counters that expire.

Times are the events' own and timers follow the watermark, so a stream that is read again gives the same rows. Pass
mode="ProcessingTime" to take the machine's clock instead, as a live watch does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestack.operators.incremental import MOST_PENDING

DELAY_MS, HORIZON_MS = 2_000, 90 * 86_400_000
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NANOS = 1_000_000


def ready(spark: SparkSession) -> None:
    """Keyed timers and maps need the store on disk; it is set where the session has no choice of its own."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)


def _millis(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[us]").astype("int64") // 1000


class Debounce(StatefulProcessor):
    """The first event of a stream opens a batch that is handed on ``delay`` ms later, whatever comes meanwhile: a busy
    stream is never put off. State: when the batch is due, and its scopes with their newest ids, or only '' once there are
    more than ``most`` of them."""

    def __init__(self, delay: int, most: int, timed: bool):
        self.delay, self.most, self.timed = delay, most, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "opened long, due long, last long, n long")
        self.scopes = handle.getMapState("scopes", "scope string", "id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # One micro-batch's events of one stream; the source's limits bound them.
        events = pd.concat(list(rows))
        clock = None if self.timed else timerValues.getCurrentProcessingTimeInMs()
        events = events.assign(at=_millis(events["ts"]) if self.timed else clock).sort_values(["at", "event_id"])
        while len(events):
            held = self.due.get()
            due = held[1] if held else int(events["at"].iloc[0]) + self.delay
            own = events[events["at"] < due]
            if len(own):
                self._add(own, due)
            if len(own) < len(events):
                yield self._handed(key)
            events = events[len(own) :]

    def _add(self, own: pd.DataFrame, due: int) -> None:
        held = self.due.get()
        if held is None:
            self.handle.registerTimer(due)
        opened, _, last, n = held or (due - self.delay, due, -1, 0)
        full = n > 0 and self.scopes.containsKey(("",)) and n > self.most
        latest = own.groupby("scope")["event_id"].max()
        if not full:
            for scope, i in latest.items():
                old = self.scopes.getValue((scope,)) if self.scopes.containsKey((scope,)) else None
                n += old is None
                self.scopes.updateValue((scope,), (max(int(i), old[0] if old else -1),))
            if n > self.most:
                self.scopes.clear()
                full = True
        last = max(last, int(latest.max()))
        if full:
            self.scopes.updateValue(("",), (last,))
            n = self.most + 1
        self.due.update((opened, due, last, n))

    def _handed(self, key) -> pd.DataFrame:
        opened, due, last, _ = self.due.get()
        rows = sorted((s[0], i[0]) for s, i in self.scopes.iterator())
        self.scopes.clear()
        self.due.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t if isinstance(t, int) else t[0])
        return pd.DataFrame({"stream": key[0], "opened": opened, "due": due, "last": last, "scope": [s for s, _ in rows], "id": [i for _, i in rows]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.due.exists():
            yield self._handed(key)

    def close(self) -> None:
        pass


def debounced(events: DataFrame, delay_ms: int = DELAY_MS, most: int = MOST_PENDING, mode: str = "EventTime", late: str = "0 seconds") -> DataFrame:
    """(stream, opened, due, last, scope, id): the batches of a stream of (stream, event_id, ts, scope), a row for each scope.

    opened and due are ms since 1970, last is the batch's newest id, up to which it may be acknowledged. By event time, an
    event later than the watermark ("late" behind) is dropped.
    """
    ready(events.sparkSession)
    timed = mode == "EventTime"
    own = events.select("stream", "event_id", "ts", "scope")
    own = own.withWatermark("ts", late) if timed else own
    return own.groupBy("stream").transformWithStateInPandas(Debounce(delay_ms, most, timed), "stream string, opened long, due long, last long, scope string, id long", "Append", mode)


class OpenCounter(StatefulProcessor):
    """How often a path was opened for a query, and when last; the counter goes ``horizon`` ms after the last open, and each
    open puts that off. A key opened again afterwards starts from 1."""

    def __init__(self, horizon: int, timed: bool):
        self.horizon, self.timed = horizon, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "count long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = pd.concat([r["ts"] for r in rows]).astype("datetime64[us]").astype("int64").sort_values()
        count, last = self.held.get() or (0, 0)
        before = last
        for at in times:  # the opens of one key in one micro-batch
            count = 1 if count and at - last >= self.horizon * 1000 else count + 1
            last = max(last, int(at))
        if last != before:
            if before:
                self.handle.deleteTimer(self._end(before))
            self.handle.registerTimer(self._end(last) if self.timed else timerValues.getCurrentProcessingTimeInMs() + self.horizon)
        self.held.update((count, last))
        yield self._row(key, count, last)

    def _end(self, last: int) -> int:
        return last // 1000 + self.horizon

    @staticmethod
    def _row(key, count: int, last: int) -> pd.DataFrame:
        return pd.DataFrame({"query": [key[0]], "path": [key[1]], "count": [count], "last_open_us": [last]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.held.get()
        if held and (not self.timed or expiredTimerInfo.getExpiryTimeInMs() >= self._end(held[1])):
            self.held.clear()
            yield self._row(key, 0, held[1])

    def close(self) -> None:
        pass


def open_counters(opens: DataFrame, horizon_ms: int = HORIZON_MS, mode: str = "EventTime", late: str = "0 seconds") -> DataFrame:
    """(query, path, count, last_open_us): a key's counter whenever it changes, count 0 when it expires.

    opens is a stream of (query, path, ts); blank queries don't count. latest() makes a table of counters of the rows.
    """
    ready(opens.sparkSession)
    timed = mode == "EventTime"
    q = F.substring(F.lower(F.trim("query")), 1, 512)
    own = opens.select(q.alias("query"), "path", "ts").filter("query <> ''")
    own = own.withWatermark("ts", late) if timed else own
    return own.groupBy("query", "path").transformWithStateInPandas(OpenCounter(horizon_ms, timed), "query string, path string, count long, last_open_us long", "Update", mode)


def latest(changes: DataFrame, batch: str = "batch") -> DataFrame:
    """(query, path, count, last_open_us) of the counters that stand, from all rows of open_counters() and their batch.

    A key has one row a batch, or its expiry and a later open's: the open stands.
    """
    newest = changes.groupBy("query", "path").agg(F.max_by(F.struct("count", "last_open_us"), F.struct(batch, "last_open_us", "count")).alias("r"))
    return newest.select("query", "path", "r.*").filter("count > 0")
