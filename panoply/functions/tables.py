"""Table functions: what a stride keeps of a video, and index runs, for SQL and lateral joins."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class KeptFrames:
    """sequence, source_frame, timestamp_s of the frames that a rate and an interval keep of a video with this many frames."""

    def eval(self, frames: int, fps: float, target_fps: float, start_s: float, end_s: float):
        if frames is None or not fps or not target_fps:
            return
        stride = max(1, round(fps / target_fps))
        first, last = round((start_s or 0.0) * fps), frames if end_s is None else min(frames, round(end_s * fps))
        for k, i in enumerate(range(first, last, stride)):
            yield k, i, i / fps


kept_frames = udtf(KeptFrames, returnType="sequence: bigint, source_frame: bigint, timestamp_s: double")


def register(spark: SparkSession) -> SparkSession:
    """Makes kept_frames(frames, fps, target_fps, start_s, end_s) callable from SQL."""
    spark.udtf.register("kept_frames", kept_frames)
    return spark
