"""Metric stitching of two sparse models: tape calibration, seam constraint, merged map and its report."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calibration
from ..functions import exprs as X
from ..operators import clouds, sequence
from ..schemas import need
from ..session import written
from ..sources import files


@dataclass(frozen=True)
class Calibration:
    frame_index: int
    image_name: str
    endpoints_px: tuple
    reconstructed_distance_units: float
    known_distance_m: float
    meters_per_unit: float
    floor_candidate_points: int
    floor_inliers: int
    floor_inlier_fraction: float
    floor_rmse_units: float


def rotation(q) -> np.ndarray:
    """The rotation matrix of a quaternion (w, x, y, z)."""
    w, *v = np.asarray(q, float) / np.linalg.norm(q)
    v = np.array(v)
    skew = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    return (w * w - v @ v) * np.eye(3) + 2 * np.outer(v, v) + 2 * w * skew


def by_frame(poses: DataFrame) -> DataFrame:
    """One pose a frame index, the last by name; a name without an index is an error."""
    p = poses.withColumn("frame", X.frame_index_strict(F.col("image_name")))
    return p.groupBy("frame").agg(F.max_by(F.struct("image_name", "q", "t", "cx", "cy", "cz"), "image_name").alias("p")).select("frame", "p.*")


def observed(spark: SparkSession, model: str, first: int, last: int, points: DataFrame) -> DataFrame:
    """Matched observations of the frames in a closed interval with their points' places."""
    o = files.observations(spark, f"{model}/images.txt").withColumn("frame", X.frame_index_strict(F.col("image_name")))
    return o.where(F.col("frame").between(first, last) & (F.col("point3d_id") != -1)).join(points, "point3d_id")


def calibrate(spark: SparkSession, model: str, images: str, frame: int, known_m: float = 1.2192, floor_v: float = 850.0) -> Calibration:
    """Metres for each unit of a model, from a tape of known length on the floor of one frame.

    Only that one frame's rows come to the driver, so their number is bounded by the features of an image.
    """
    seen = observed(spark, model, frame, frame, files.points3d(spark, f"{model}/points3D.txt"))
    floor = seen.where(F.col("v") >= floor_v).orderBy("image_name", "ordinal").select("x", "y", "z").toPandas().to_numpy()
    normal, offset, inside, rmse = calibration.floor_plane(floor)
    found = by_frame(files.poses(spark, f"{model}/images.txt")).where(F.col("frame") == frame).take(1)
    need(bool(found), f"frame {frame} has no pose")
    pose, camera = found[0], tuple(files.cameras(spark, f"{model}/cameras.txt").first()["params"])
    px = spark.read.format("image").load(f"{images}/{pose['image_name']}").select("image.*").first()
    ends = calibration.tape_endpoints(np.frombuffer(px["data"], np.uint8).reshape(px["height"], px["width"], px["nChannels"])[..., :3])
    r, c = rotation(pose["q"]), np.array([pose["cx"], pose["cy"], pose["cz"]])
    a, b = (calibration.ray_on_plane(r, c, camera, e, normal, offset) for e in ends)
    units = float(np.linalg.norm(a - b))
    need(units > 0, "the tape has no length in the model")
    return Calibration(frame, pose["image_name"], tuple(tuple(map(float, e)) for e in ends), units, known_m, known_m / units, len(floor), int(inside.sum()), float(inside.mean()), rmse)


def stitch(spark: SparkSession, main: str, secondary: str, images: str, main_tape: int = 750, secondary_tape: int = 660, main_seam: int = 706, secondary_seam: int = 705, known_m: float = 1.2192, calibrations: tuple[Calibration, Calibration] | None = None) -> tuple[dict, DataFrame, DataFrame]:
    """The report, the merged points and the merged cameras, both in metres.

    The secondary model is scaled by the two calibrations' ratio, and its seam camera is laid on the main
    model's. Clouds and cameras stay distributed; the driver sees a handful of poses.
    """
    ca, cb = calibrations or (calibrate(spark, main, images, main_tape, known_m), calibrate(spark, secondary, images, secondary_tape, known_m))
    m, scale = ca.meters_per_unit, cb.meters_per_unit / ca.meters_per_unit
    once = {d: written(by_frame(files.poses(spark, f"{d}/images.txt")), "poses") for d in {main, secondary}}  # read by six plans below: the text is parsed once
    pa, pb = once[main], once[secondary]

    def places(p: DataFrame, wanted: list[int]) -> dict:
        got = {x["frame"]: (np.array([x["cx"], x["cy"], x["cz"]]), rotation(x["q"])) for x in p.where(F.col("frame").isin(wanted)).collect()}
        need(len(got) == len(wanted), f"frames {sorted(set(wanted) - set(got))} have no pose")
        return got

    a, b = places(pa, [main_seam, main_seam + 1]), places(pb, [secondary_seam, secondary_seam - 1])
    (center_a, turn_a), (center_b, turn_b) = a[main_seam], b[secondary_seam]
    world = turn_a.T @ turn_b
    shift = center_a - scale * world @ center_b
    move = scale, world.tolist(), shift.tolist()
    cloud_a, cloud_b = (files.points3d(spark, f"{d}/points3D.txt") for d in (main, secondary))
    points = clouds.merged(cloud_a, clouds.moved(cloud_b, *move), m)
    camera = lambda p: p.select("frame", "image_name", *[F.col(f"c{x}").alias(x) for x in "xyz"])
    cameras = clouds.merged(camera(pa), clouds.moved(camera(pb), *move), m)
    metric = lambda d: d.select("point3d_id", "x", "y", "z").distinct().withColumns({x: F.col(x) * m for x in "xyz"})
    near_b = metric(clouds.moved(observed(spark, secondary, max(0, secondary_seam - 10), secondary_seam, cloud_b), *move))
    near_a = metric(observed(spark, main, main_seam, main_seam + 10, cloud_a))
    seam = clouds.seam_gate(clouds.nearest(near_b, near_a, "point3d_id")).first()
    gap = sequence.missing_ranges(cameras, [], "frame").orderBy("first").collect()
    turn = turn_a @ (turn_b @ world.T).T
    report = {
        "main_calibration": asdict(ca),
        "secondary_calibration": asdict(cb),
        "secondary_to_main_scale": scale,
        "seam_main_frame": main_seam,
        "seam_secondary_frame": secondary_seam,
        "seam_position_gap_m": float(np.linalg.norm(scale * world @ center_b + shift - center_a)) * m,
        "seam_orientation_gap_deg": math.degrees(math.acos(min(1.0, max(-1.0, (np.trace(turn) - 1) / 2)))),
        "seam_geometry_median_nearest_m": seam["seam_median_m"],
        "seam_geometry_within_0_25m_fraction": seam["seam_within_fraction"],
        "seam_geometry_gate_passed": seam["seam_geometry_gate_passed"],
        "incoming_step_m": float(np.linalg.norm(scale * world @ (center_b - b[secondary_seam - 1][0]))) * m,
        "outgoing_step_m": float(np.linalg.norm(a[main_seam + 1][0] - center_a)) * m,
        "merged_points": points.count(),
        "merged_cameras": cameras.count(),
        "missing_frame_ranges": [[r["first"], r["last"]] for r in gap],
    }
    return report, points, cameras
