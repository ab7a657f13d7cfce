"""Keyframe selection and coverage over a stream of frames."""

from __future__ import annotations

from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.keyframes import Pair, decide, value_pair
from ..schemas import KeyframeConfig

OUT = "video_id long, sequence long, timestamp_s double, selected boolean, reason string"


def in_order(batches) -> list[dict]:
    """A group's frames by time and sequence, missing ones last, as records. Groups are many and small, and for a few rows pandas' own sort and records cost more than the rows."""
    rows = [dict(zip(pdf.columns, r, strict=True)) for pdf in batches for r in zip(*(pdf[c].tolist() for c in pdf.columns), strict=True)]
    place = lambda x: (x is None or x != x, x)
    return sorted(rows, key=lambda r: (*place(r["timestamp_s"]), *place(r["sequence"])))


def select_stream(frames: DataFrame, cfg: KeyframeConfig, blur: float, pair: Pair | None = None) -> DataFrame:
    """Decisions as frames arrive, in time order inside each batch. State is the last selected frame alone.

    A stream has no global percentile and no last frame: the blur threshold is given, and no frame is taken for being last.
    """
    pair = pair or value_pair()

    def fold(key, batches, state: GroupState):
        last = None
        if state.exists:
            t, s, f = state.get
            last = {"timestamp_s": t, "sharpness": s, "feature_count": f}
        out = []
        for r in in_order(batches):
            selected, reason, *_ = decide(r, last, False, blur, cfg, pair)
            out.append((key[0], r["sequence"], r["timestamp_s"], selected, reason))
            last = r if selected else last
        state.update((float(last["timestamp_s"]), float(last["sharpness"]), int(last["feature_count"])))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return frames.groupBy("video_id").applyInPandasWithState(fold, OUT, "t double, s double, f long", "append", GroupStateTimeout.NoTimeout)


#: The state of a video: its last selected frame.
STATE = "timestamp_s double, sharpness double, feature_count long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class KeyframeProcessor(StatefulProcessor):
    """The same decisions by a stateful processor, whose state a store on disk holds."""

    def __init__(self, cfg: KeyframeConfig, blur: float, pair: Pair):
        self.cfg, self.blur, self.pair = cfg, blur, pair

    def init(self, handle):
        self.last = handle.getValueState("last", STATE)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  the interface's names
        held = self.last.get() if self.last.exists() else None
        last = dict(zip(("timestamp_s", "sharpness", "feature_count"), held, strict=True)) if held else None
        out = []
        for r in in_order(rows):
            selected, reason, *_ = decide(r, last, False, self.blur, self.cfg, self.pair)
            out.append((key[0], r["sequence"], r["timestamp_s"], selected, reason))
            last = r if selected else last
        self.last.update((float(last["timestamp_s"]), float(last["sharpness"]), int(last["feature_count"])))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self):
        pass


def process_stream(frames: DataFrame, cfg: KeyframeConfig, blur: float, pair: Pair | None = None) -> DataFrame:
    """select_stream() for streams with more videos than memory holds: their state is in RocksDB (see rocks())."""
    processor = KeyframeProcessor(cfg, blur, pair or value_pair())
    return frames.groupBy("video_id").transformWithStateInPandas(processor, OUT, "append", "None")


class OrderedKeyframes(StatefulProcessor):
    """Frames that may arrive in any order inside the watermark's delay, decided in the order of their times.

    A video's frames wait until the watermark has passed them. The newest of those waits on, as it may be the last: it is, once the
    watermark stands ``idle_s`` beyond it. Then the video ends; a frame after that starts a new one. Rows, not pandas, as a video has
    few in a batch; a timer for that wait is only set once a newest frame waits alone, as calls to the state cost the most.
    """

    def __init__(self, cfg: KeyframeConfig, blur: float, pair: Pair, idle_s: float):
        self.cfg, self.blur, self.pair, self.idle = cfg, blur, pair, round(idle_s * 1000)

    def init(self, handle):
        self.handle = handle
        self.last = handle.getValueState("last", STATE)
        self.waiting = handle.getListState("waiting", f"at long, sequence long, {STATE}")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  the interface's names
        new = [(int(r["at"]), int(r["sequence"]), float(r["timestamp_s"]), float(r["sharpness"]), int(r["feature_count"])) for r in rows]
        self.waiting.appendList(new)
        self.handle.registerTimer(max(r[0] for r in new) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get(), key=lambda r: (r[2], r[1]))
        ready = [r for r in rows if r[0] <= passed]
        ends = bool(ready) and len(ready) == len(rows) and passed >= ready[-1][0] + self.idle
        if ready and len(ready) == len(rows) and not ends:
            self.handle.registerTimer(ready.pop()[0] + self.idle)
        if not ready:
            return
        held = self.last.get()
        last = dict(zip(("timestamp_s", "sharpness", "feature_count"), held, strict=True)) if held else None
        out = []
        for i, (_, sequence, time, sharpness, features) in enumerate(ready):
            r = {"timestamp_s": time, "sharpness": sharpness, "feature_count": features}
            selected, reason, *_ = decide(r, last, ends and i == len(ready) - 1, self.blur, self.cfg, self.pair)
            out.append(Row(video_id=key[0], sequence=sequence, timestamp_s=time, selected=selected, reason=reason))
            last = r if selected else last
        if ends:
            self.last.clear()
            self.waiting.clear()
        else:
            self.last.update((last["timestamp_s"], last["sharpness"], last["feature_count"]))
            self.waiting.put(rows[len(ready) :])
        yield from out

    def close(self):
        pass


def ordered_stream(frames: DataFrame, cfg: KeyframeConfig, blur: float, time: str = "ts", late: str = "1 minute", idle_s: float = 60.0, pair: Pair | None = None) -> DataFrame:
    """Decisions of the batch rules, the last frame's included, for frames that come late and out of order by up to ``late`` of event time; later ones are dropped.

    The blur threshold is given, as a stream has no global percentile. State is in RocksDB (see rocks()).
    """
    f = frames.withWatermark(time, late).withColumn("at", F.unix_millis(time))
    return f.groupBy("video_id").transformWithState(OrderedKeyframes(cfg, blur, pair or value_pair(), idle_s), OUT, "append", "EventTime")


@contextmanager
def rocks(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def coverage_stream(frames: DataFrame, time: str = "ts", size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Frames in each tumbling window of each video; windows are half open, unlike the closed bins of the batch report."""
    w = frames.withWatermark(time, late).groupBy(F.window(time, size), "video_id").agg(F.count("*").alias("candidate_count"))
    return w.select("video_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "candidate_count")
