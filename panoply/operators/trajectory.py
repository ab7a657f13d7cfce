"""Trajectory diagnostics for each model: steps, closure, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..session import written
from .sequence import before, quantiles

XYZ = ["cx", "cy", "cz"]


def with_centers(poses: DataFrame) -> DataFrame:
    """Adds cx, cy, cz from arrays q and t."""
    c = X.camera_center([F.col("q")[i] for i in range(4)], [F.col("t")[i] for i in range(3)])
    return poses.withColumns(dict(zip(XYZ, c, strict=True)))


def _stepped(poses: DataFrame, key: str) -> DataFrame:
    """Poses with centres, the distance from the pose before by name (step), the frame index and the last known one before it (was)."""
    c = with_centers(poses).withColumn("idx", X.frame_index_loose(F.col("image_name")))
    c = before(c, [key], ["image_name"], at=F.struct(*XYZ), was=F.col("idx"))
    return c.withColumn("step", X.distance([F.col(n) for n in XYZ], [F.col("at")[n] for n in XYZ]))


def steps(poses: DataFrame, key: str = "model_id") -> DataFrame:
    """Each pose after the first by name with its distance from the one before."""
    return _stepped(poses, key).where(F.col("step").isNotNull()).drop("idx", "at", "was")


def report(poses: DataFrame, key: str = "model_id", expected: DataFrame | None = None) -> DataFrame:
    """One row a model. Models need two poses and a path; ``expected`` (key, expected_images) adds the registration rate."""
    c = written(_stepped(poses, key), "steps")  # the aggregate and the quantiles read it
    end = F.struct(*XYZ, "q")
    g = c.groupBy(key).agg(F.count("*").alias("registered_images"), F.sum("step").alias("path_length_units"), F.max("step").alias("max_step_units"), F.max(F.col("idx") - F.col("was")).alias("largest_frame_index_gap"), F.min_by(end, "image_name").alias("a"), F.max_by(end, "image_name").alias("z"))
    g = g.join(quantiles(c, [key], "step", {"median_step_units": 0.5, "p95_step_units": 0.95}), key, "left")
    g = g.join(expected, key, "left") if expected is not None else g.withColumn("expected_images", F.lit(None).cast("long"))
    wrong = F.when(F.col("registered_images") < 2, F.lit("a trajectory needs two poses or more")).when(F.col("path_length_units") == 0, F.lit("all poses stand at one place")).when(F.col("expected_images") < F.col("registered_images"), F.lit("fewer images are expected than have a pose"))
    g = g.withColumn("registered_images", F.when(wrong.isNotNull(), F.raise_error(wrong).cast("long")).otherwise(F.col("registered_images")))
    g = g.withColumn("start_end_distance_units", X.distance([F.col(f"a.{n}") for n in XYZ], [F.col(f"z.{n}") for n in XYZ]))
    angle = X.quaternion_angle([F.col("a.q")[i] for i in range(4)], [F.col("z.q")[i] for i in range(4)])
    return g.select(key, "registered_images", "expected_images", (F.col("registered_images") / F.nullif("expected_images", F.lit(0))).alias("registration_rate"), "path_length_units", "start_end_distance_units", (F.col("start_end_distance_units") / F.col("path_length_units") * 100).alias("position_closure_error_percent"), angle.alias("orientation_closure_error_deg"), "median_step_units", "p95_step_units", "max_step_units", (F.col("max_step_units") / F.nullif("median_step_units", F.lit(0.0))).alias("max_step_to_median_ratio"), "largest_frame_index_gap")


def gates(reports: DataFrame) -> DataFrame:
    """The report with its gates as a map; a gate that can't be computed is null."""
    g = {
        "registration_rate_at_least_80_percent": F.col("registration_rate") >= 0.80,
        "position_closure_error_at_most_5_percent": F.col("position_closure_error_percent") <= 5.0,
        "orientation_closure_error_at_most_15_deg": F.col("orientation_closure_error_deg") <= 15.0,
        "max_step_at_most_10x_median": F.col("max_step_to_median_ratio") <= 10.0,
    }
    return reports.withColumn("gates", F.create_map(*[x for k, v in g.items() for x in (F.lit(k), v)]))
