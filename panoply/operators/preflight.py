"""Checks of a capture before it is reconstructed: coverage in time, overlap of neighbouring frames, lasting blur; track lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import PreflightConfig
from ..session import written
from .sequence import before, coverage_bins, islands, quantiles, same

ORDER = ["timestamp_s", "sequence"]


def with_tracks(frames: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """Adds track_ratio, the overlap with the frame before in time: 1 for equal sharpness, 0 from a change of ``reach`` on; null for a
    first frame. For tables without pixels."""
    d = before(frames, keys, ORDER, _was=F.col("sharpness"))
    return d.withColumn("track_ratio", F.when(F.col("_was").isNotNull(), F.greatest(F.lit(0.0), 1 - F.abs(F.col("sharpness") - F.col("_was")) / reach))).drop("_was")


def report(frames: DataFrame, keys: list[str], cfg: PreflightConfig) -> DataFrame:
    """One row a capture, from frames (keys, timestamp_s, sequence, sharpness, track_ratio), with the four gates that need no eye.

    A low-track interval runs from the last frame with enough overlap to the last one of those that follow it without. A blurred
    frame counts as lastingly blurred if its run of blurred frames spans ``lasting_s`` or more.
    """
    frames = written(frames.select(*keys, *ORDER, "sharpness", "track_ratio"), "preflight")  # four branches read it
    low = islands(frames, keys, ORDER, F.col("track_ratio") < cfg.low_track, "timestamp_s")
    low = low.groupBy(*keys).agg(F.max(F.col("end") - F.coalesce("since", "start")).alias("longest_low_track_s"))
    blur = islands(frames, keys, ORDER, F.col("sharpness") < cfg.blur_below, "timestamp_s").where(F.col("end") - F.col("start") >= cfg.lasting_s)
    blur = blur.groupBy(*keys).agg(F.sum("rows").alias("blurred_frames"))
    bins = coverage_bins(frames.withColumn("_in", F.lit(True)), keys, "timestamp_s", "_in", cfg.bin_s).groupBy(*keys).agg(F.count("*").alias("total_bins"), F.count_if("covered").alias("covered_bins"))
    tracks = quantiles(frames, keys, "track_ratio", {"median_track_ratio": 0.5})
    out = frames.groupBy(*keys).agg(F.count("*").alias("frames"), (F.max("timestamp_s") - F.min("timestamp_s")).alias("duration_s"))
    for part in (bins, tracks, low, blur):
        right = part.withColumnsRenamed({k: f"_{k}" for k in keys})
        out = out.join(right, same(keys), "left").drop(*[f"_{k}" for k in keys])
    out = out.fillna({"longest_low_track_s": 0.0, "blurred_frames": 0}).withColumn("blurred_fraction", F.col("blurred_frames") / F.col("frames"))
    return out.withColumns({
        "bins_gate": F.col("covered_bins") == F.col("total_bins"),
        "track_gate": F.coalesce(F.col("median_track_ratio") >= cfg.least_median_track, F.lit(False)),
        "low_track_gate": F.col("longest_low_track_s") <= cfg.longest_low_track_s,
        "blur_gate": F.col("blurred_fraction") < cfg.most_blurred,
    })


def track_lengths(observations: DataFrame, keys: list[str], point: str, image: str) -> DataFrame:
    """keys, length, points: how many points are seen by how many different images."""
    seen = observations.select(*keys, point, image).where(F.col(point).isNotNull() & (F.col(point) != -1)).distinct()
    lengths = seen.groupBy(*keys, point).agg(F.count(image).alias("length"))
    return lengths.groupBy(*keys, "length").agg(F.count("*").alias("points"))


def track_summary(observations: DataFrame, keys: list[str], point: str, image: str) -> DataFrame:
    """keys, points, observations, mean and longest track, and the median and 90th percentile of their lengths."""
    seen = observations.select(*keys, point, image).where(F.col(point).isNotNull() & (F.col(point) != -1)).distinct()
    lengths = written(seen.groupBy(*keys, point).agg(F.count(image).alias("length")), "tracks")
    g = lengths.groupBy(*keys).agg(F.count("*").alias("points"), F.sum("length").alias("observations"), F.avg("length").alias("mean_length"), F.max("length").alias("longest"))
    q = quantiles(lengths, keys, "length", {"median_length": 0.5, "p90_length": 0.9}).withColumnsRenamed({k: f"_{k}" for k in keys})
    return g.join(q, same(keys), "left").drop(*[f"_{k}" for k in keys]) if keys else g.join(F.broadcast(q))  # one row each


def dimension_gates(results: DataFrame, key: str, median: float = 5.0, worst: float = 10.0) -> DataFrame:
    """key, checks, median and worst percent error of its dimensions, and the gate on both; null without any error known."""
    g = results.groupBy(key).agg(F.count("*").alias("checks"), F.max("percent_error").alias("worst_percent_error"))
    q = quantiles(results, [key], "percent_error", {"median_percent_error": 0.5}).withColumnRenamed(key, f"_{key}")
    g = g.join(q, same([key]), "left")
    return g.select(key, "checks", "median_percent_error", "worst_percent_error", ((F.col("median_percent_error") <= median) & (F.col("worst_percent_error") <= worst)).alias("dimensions_gate"))
