"""Cadence of sources as keyed state with timers: the counters of a source, from a batch if there is one, and an alarm when it is due."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "fail_count long, unchanged long, last_changed long, gap long, run_id long"
#: kind is "run" (the state after a batch of a source's runs) or "due" (the time of its next poll has come); due is in seconds of the epoch.
OUT = "source_key string, kind string, run_id long, fail_count long, unchanged long, poll long, due long"
#: The state store that this needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Cadence(StatefulProcessor):
    """Folds a source's runs, in order, into its counters, says when it is due, and says so again when event time has come there."""

    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.counters = handle, handle.getValueState("counters", STATE)

    def held(self) -> tuple:
        return tuple(self.counters.get()) if self.counters.exists() else (0, 0, -1, -1, -1)

    def clamped(self, poll: float) -> int:
        return int(min(max(int(poll + 0.5), self.low), self.high))

    def row(self, key: tuple, kind: str, state: tuple, poll: int, due: int) -> pd.DataFrame:
        return pd.DataFrame([(key[0], kind, state[4], state[0], state[1], poll, due)], columns=["source_key", "kind", "run_id", "fail_count", "unchanged", "poll", "due"])

    def set_alarm(self, due: int) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(due * 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fails, same, last, gap, _ = self.held()
        every = pd.concat(list(rows)).sort_values(["started_at", "run_id"])
        poll, at = self.low, 0
        for status, new, started in zip(every["status"], every["new_items"], every["started_at"], strict=True):
            at = started.value // 1000
            if status == "error":
                fails += 1
                poll = self.low * 2.0 ** min(fails, 60)
            elif not new > 0:
                fails, same = 0, same + 1
                poll = self.low * 1.5 ** min(same, 60)
            else:
                if last >= 0 and round((at - last) / 1e6) > 0:
                    gap = round((at - last) / 1e6)
                fails, same, last = 0, 0, at
                poll = gap * 0.33 if gap > 0 else self.low
        state = (fails, same, last, gap, int(every["run_id"].iloc[-1]))
        self.counters.update(state)
        due = at // 1_000_000 + self.clamped(poll)
        self.set_alarm(due)
        yield self.row(key, "run", state, self.clamped(poll), due)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self.row(key, "due", self.held(), 0, expiredTimerInfo.getExpiryTimeInMs() // 1000)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        row = initialState.iloc[0]
        whole = lambda c: -1 if pd.isna(row[c]) else int(row[c])
        self.counters.update((whole("fail_count"), whole("unchanged"), whole("last_changed"), whole("gap"), whole("run_id")))
        if not pd.isna(row["due"]):
            self.set_alarm(int(row["due"]))

    def close(self) -> None:
        pass


def initial(cadence: DataFrame) -> DataFrame:
    """The state to begin with, of a batch's cadence (source_key, fail_count, unchanged, last_changed_at, observed_gap, next_due; perhaps run_id)."""
    run = F.col("run_id") if "run_id" in cadence.columns else F.lit(-1)
    return cadence.select("source_key", F.col("fail_count").cast("long").alias("fail_count"), F.col("unchanged").cast("long").alias("unchanged"), F.unix_micros("last_changed_at").alias("last_changed"),
        F.col("observed_gap").cast("long").alias("gap"), run.cast("long").alias("run_id"), F.unix_seconds("next_due").alias("due"))


def cadence_and_due(runs: DataFrame, start: DataFrame | None = None, *, low: int = 3600, high: int = 86400, late: str = "2 hours") -> DataFrame:
    """A row for each source with runs in a batch, with its counters and next time, and one for each whose next time the watermark has passed without a run. runs: source_key, run_id, started_at, status, new_items.

    start (as initial makes it) is the state before the first batch; after a restart the checkpoint's state counts. Only the last alarm of a source stands. The session's state store must be PROVIDER."""
    grouped = runs.withWatermark("started_at", late).groupBy("source_key")
    return grouped.transformWithStateInPandas(Cadence(low, high), OUT, "Update", "EventTime", initialState=None if start is None else start.groupBy("source_key"))
