"""State of typing sessions over a stream whose events come late and out of order: keyed state with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .sessions import CAPITALISE, LAST, SELECTING, transitions

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "session_id long, seq long, ts timestamp, capitalise_next boolean, selecting boolean, last_text string"


def _given(x):
    return None if x is None or (not isinstance(x, str) and pd.isna(x)) else x


class Sessions(StatefulProcessor):
    """Events wait in a list until the watermark has passed them, so all that were no later than it allows are there; then they go in order of time and seq through the session's state. A session without events for `idle` milliseconds of event time is forgotten, and begins anew with its next event."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, seq long, caps boolean, mode boolean, last string")
        self.state = handle.getValueState("state", "ms long, caps boolean, mode boolean, last string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for part in rows:
            times = part["ts"].astype("datetime64[ms]").astype("int64")
            new += [(int(ms), int(seq), _given(c), _given(m), _given(x)) for ms, seq, c, m, x in zip(times, part["seq"], part["set_caps"], part["set_mode"], part["set_last"], strict=True)]
        if new:
            self.waiting.appendList(new)
            self._wake(min(r[0] for r in new))
        return iter(())

    def _wake(self, ms: int) -> None:
        """A timer fires once the watermark has passed it; one at the earliest waiting event will do."""
        timers = list(self.handle.listTimers())
        times = [t[0] if isinstance(t, tuple) else t for t in timers]
        if ms not in times:
            self.handle.registerTimer(ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get(), key=lambda r: (r[0], r[1])) if self.waiting.exists() else []
        due, later = [r for r in rows if r[0] <= now], [tuple(r) for r in rows if r[0] > now]
        held = tuple(self.state.get()) if self.state.exists() else None
        out = []
        for ms, seq, set_caps, set_mode, set_last in due:
            if held is None or ms - held[0] > self.idle:
                held = (ms, CAPITALISE, SELECTING, LAST)
            _, caps, mode, last = held
            caps, mode = (old if (new := _given(x)) is None else bool(new) for old, x in ((caps, set_caps), (mode, set_mode)))
            last = last if (text := _given(set_last)) is None else text or None
            held = (ms, caps, mode, last)
            out.append((key[0], seq, pd.Timestamp(ms, unit="ms"), caps, mode, last))
        if due:
            self.waiting.clear()
            if later:
                self.waiting.put(later)
        if held is not None and held[0] + self.idle < now and not later:
            self.state.clear()
        elif held is not None:
            self.state.update(held)
            self._wake(later[0][0] if later else held[0] + self.idle)
        elif later:
            self._wake(later[0][0])
        if out:
            yield pd.DataFrame(out, columns=["session_id", "seq", "ts", "capitalise_next", "selecting", "last_text"])

    def close(self) -> None:
        pass


def session_stream(events: DataFrame, delay: str = "10 minutes", idle: str = "1 hour") -> DataFrame:
    """(session_id, seq, ts, capitalise_next, selecting, last_text) of a stream of events with a time `ts`, which may come up to `delay` late and in any order: each event once, when the watermark has passed it.

    Within sessions the result is that of session_states over the same events, if their seq follows their time; a session that was idle for longer than `idle` begins anew. State is one row for each waiting event and one for each session that isn't idle; it lies in the RocksDB store, which this sets.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    slim = transitions(events).select("session_id", "seq", F.col("ts").cast("timestamp").alias("ts"), "set_caps", "set_mode", "set_last").withWatermark("ts", delay)
    milliseconds = int(pd.Timedelta(idle).total_seconds() * 1000)
    return slim.groupBy("session_id").transformWithStateInPandas(statefulProcessor=Sessions(milliseconds), outputStructType=_OUT, outputMode="Append", timeMode="eventTime")
