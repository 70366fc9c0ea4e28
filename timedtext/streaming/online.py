"""T-a to T-d: the ordered operators over unbounded input.

The reference works on closed files only; these are extensions with the same meaning on each closed stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.frames import INTERVAL, THRESHOLD


#: What keeps lists, values and timers for a stream's keys; transformWithStateInPandas works with no other.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEPT = ["video_id", "ordinal", "ts"]


def _fold(samples: DataFrame, step, state: str) -> DataFrame:
    """Keeps the samples for which step(row, state) says so; samples of a stream must come in order from batch to batch."""
    names = [f.split()[0] for f in state.split(", ")]

    def task(key: Any, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        values = dict(zip(names, held.get)) if held.exists else dict.fromkeys(names)
        for frame in frames:
            frame = frame.sort_values(["ts", "ordinal"], kind="stable")
            kept = [step(row, values) for row in frame.itertuples()]
            yield frame[kept][KEPT]
        held.update(tuple(values[n] for n in names))

    schema = ", ".join(f"{n} {t}" for n, t in samples.select(KEPT).dtypes)
    return samples.groupBy("video_id").applyInPandasWithState(task, schema, state, "append", GroupStateTimeout.NoTimeout)


class _Reordered(StatefulProcessor):
    """Holds a key's samples until the watermark has passed them, then folds them in the order of ts and ordinal.

    One timer stands for each key, at its earliest sample that is held.  A batch that brings samples before the watermark has
    had them dropped by Spark, and one that lets the watermark pass releases after it has taken in its own: so no sample is
    folded before an earlier one that is not dropped.
    """

    def __init__(self, step, state: str, held: list[tuple[str, str]]):
        self.step, self.state, self.held = step, state, held
        self.names = [f.split()[0] for f in state.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", ", ".join(f"{n} {t}" for n, t in [("due", "bigint"), *self.held]))
        self.fold = handle.getValueState("fold", self.state)
        self.timer = handle.getValueState("timer", "due bigint")

    def _set_timer(self, due: int | None) -> None:
        old = self.timer.get()[0] if self.timer.exists() else None
        if old == due:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        if due is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(due)
            self.timer.update((due,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = self.timer.get()[0] if self.timer.exists() else None
        for frame in rows:
            # A timer has whole milliseconds: the first at which the watermark is not before the sample.
            due = (-(-frame["at"].astype("datetime64[us]").astype("int64") // 1000)).tolist()
            self.buffer.appendList([(d, *r) for d, r in zip(due, zip(*(frame[n].tolist() for n, _ in self.held)))])
            earliest = min(due if earliest is None else [earliest, *due])
        self._set_timer(earliest)
        yield pd.DataFrame({n: [] for n in KEPT})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()  # the timer that stood is the one that went off
        samples = list(self.buffer.get())
        later = [x for x in samples if x[0] > now]
        passed = pd.DataFrame([tuple(x)[1:] for x in samples if x[0] <= now], columns=[n for n, _ in self.held])
        if later:
            self.buffer.put([tuple(x) for x in later])
        else:
            self.buffer.clear()
        self._set_timer(min((x[0] for x in later), default=None))
        values = dict(zip(self.names, self.fold.get())) if self.fold.exists() else dict.fromkeys(self.names)
        passed = passed.sort_values(["ts", "ordinal"], kind="stable")
        kept = [self.step(row, values) for row in passed.itertuples()]
        if len(passed):
            self.fold.update(tuple(values[n] for n in self.names))
        yield passed[kept].assign(video_id=key[0])[KEPT] if any(kept) else pd.DataFrame({n: [] for n in KEPT})

    def close(self) -> None:
        pass


def _reordered(samples: DataFrame, step, state: str, late: str) -> DataFrame:
    conf = samples.sparkSession.conf
    if conf.get("spark.sql.streaming.stateStore.providerClass", "") != STATE_STORE:
        raise ValueError(f"samples out of order need spark.sql.streaming.stateStore.providerClass={STATE_STORE}")
    held = [(n, t) for n, t in samples.dtypes if n not in ("video_id", "at")]
    schema = ", ".join(f"{n} {t}" for n, t in samples.select(KEPT).dtypes)
    timed = samples.withWatermark("at", late).groupBy("video_id")
    return timed.transformWithStateInPandas(_Reordered(step, state, held), schema, "append", "eventTime")


def online_changes(samples: DataFrame, threshold: float = THRESHOLD, late: str | None = None) -> DataFrame:
    """T-b, W07 on a stream of video_id, ordinal, ts, value.

    late: how long after the newest sample's `at` (a timestamp that grows with ts) one may still come.  Samples may then come in
    any order, and are given out once the watermark has passed them; without it they must come in order.  Rows without `at` go.
    """

    def step(row, s: dict) -> bool:
        keep = s["anchor"] is None or abs(row.value - s["before"]) > threshold or abs(row.value - s["anchor"]) > threshold
        s["before"] = float(row.value)
        if keep:
            s["anchor"] = float(row.value)
        return bool(keep)

    return _unbounded(samples, ["value"], step, "anchor double, before double", late)


def online_interval(samples: DataFrame, interval: float = INTERVAL, late: str | None = None) -> DataFrame:
    """T-b, S14 on a stream of video_id, ordinal, ts; late: as for online_changes."""

    def step(row, s: dict) -> bool:
        keep = s["last"] is None or row.ts - s["last"] >= interval
        if keep:
            s["last"] = float(row.ts)
        return bool(keep)

    return _unbounded(samples, [], step, "last double", late)


def _unbounded(samples: DataFrame, read: list[str], step, state: str, late: str | None) -> DataFrame:
    if late is None:
        return _fold(samples.select(*KEPT, *read), step, state)
    return _reordered(samples.select(*KEPT, *read, "at").where("at IS NOT NULL"), step, state, late)


def speech_sessions(cues: DataFrame, gap: str = "100 milliseconds", late: str = "10 seconds") -> DataFrame:
    """T-a: runs of speech without a silence longer than gap, from a stream with `at` (a timestamp), video_id and words."""
    window = F.session_window("at", gap)
    counted = cues.withWatermark("at", late).groupBy("video_id", window).agg(F.count("*").alias("cues"), F.sum("words").alias("words"))
    return counted.select("video_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "cues", "words")


def write_once(stream: DataFrame, path: str, checkpoint: str):
    """T-c: each batch lands under its own number, so a batch that is run again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
