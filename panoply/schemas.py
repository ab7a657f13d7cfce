"""Table schemas, and configurations that validate themselves."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import types as T

#: Fixed value: the least width that frames are analysed at.
LEAST_WIDTH = 64
L, D, S, B, I = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.IntegerType()  # noqa: E741


def struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


# Names and order of the tables' columns, and below the settings' names and defaults.
FRAMES = struct(sequence=L, source_frame=L, timestamp_s=D, sharpness=D, brightness_mean=D, filename=S)
POSES = struct(image_id=L, image_name=S, quaternion_wxyz=T.ArrayType(D), translation_xyz=T.ArrayType(D), center_xyz=T.ArrayType(D))
POINTS3D = struct(point3d_id=L, x=D, y=D, z=D, red=I, green=I, blue=I)
OBSERVATIONS = struct(image_id=L, image_name=S, ordinal=I, u=D, v=D, point3d_id=L)
CAMERAS = struct(camera_id=L, model=S, width=I, height=I, params=T.ArrayType(D))
IMAGES = struct(image_id=L, name=S)
VERTICES = struct(vid=L, x=D, y=D, z=D)
TRIANGLES = struct(fid=L, a=L, b=L, c=L)
REFERENCE = struct(name=S, distance_m=D, description=S)
MANIFEST = struct(schema_version=I, dataset_id=S, video_path=S, capture_device=S, environment=S, route_description=S, metric_references=T.ArrayType(REFERENCE))
CHECK = struct(name=S, actual_m=D, reconstructed_units=D)


def need(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class ExtractionConfig:
    target_fps: float = 3.0
    jpeg_quality: int = 95
    analysis_width: int = 640
    start_s: float = 0.0
    end_s: float | None = None

    def __post_init__(self):
        need(math.isfinite(self.target_fps) and self.target_fps > 0, "target_fps must be positive and finite")
        need(1 <= self.jpeg_quality <= 100, "jpeg_quality must lie in 1..100")
        need(self.analysis_width >= LEAST_WIDTH, f"analysis_width must be {LEAST_WIDTH} or more")
        need(self.start_s >= 0, "start_s must not be negative")
        need(self.end_s is None or self.end_s > self.start_s, "end_s must lie after start_s")


@dataclass(frozen=True)
class KeyframeConfig:
    analysis_width: int = 480
    min_interval_s: float = 0.4
    max_interval_s: float = 1.2
    motion_threshold: float = 0.012
    min_track_ratio: float = 0.35
    min_features: int = 80
    blur_percentile: float = 20.0
    max_corners: int = 600
    coverage_bin_s: float = 5.0

    def __post_init__(self):
        need(self.analysis_width >= LEAST_WIDTH, f"analysis_width must be {LEAST_WIDTH} or more")
        need(0 < self.min_interval_s <= self.max_interval_s, "intervals must be positive and ordered")
        need(self.motion_threshold > 0, "motion_threshold must be positive")
        need(0 <= self.min_track_ratio <= 1, "min_track_ratio must lie in 0..1")
        need(1 <= self.min_features <= self.max_corners, "min_features must lie in 1..max_corners")
        need(0 <= self.blur_percentile <= 100, "blur_percentile must lie in 0..100")
        need(self.coverage_bin_s > 0, "coverage_bin_s must be positive")


@dataclass(frozen=True)
class PreflightConfig:
    low_track: float = 0.5
    least_median_track: float = 0.5
    longest_low_track_s: float = 1.5
    blur_below: float = 50.0
    lasting_s: float = 1.0
    most_blurred: float = 0.1
    bin_s: float = 5.0

    def __post_init__(self):
        need(0 <= self.low_track <= 1 and 0 <= self.least_median_track <= 1 and 0 <= self.most_blurred <= 1, "ratios lie in 0..1")
        need(self.bin_s > 0 and self.lasting_s >= 0 and self.longest_low_track_s >= 0, "times must not be negative, bins have a length")


@dataclass(frozen=True)
class MetricReference:
    name: str
    distance_m: float
    description: str

    def __post_init__(self):
        need(bool(self.name.strip()) and bool(self.description.strip()), "a reference needs a name and a description")
        need(math.isfinite(self.distance_m) and self.distance_m > 0, "a reference distance must be positive")


@dataclass(frozen=True)
class Manifest:
    dataset_id: str
    video_path: str
    capture_device: str
    environment: str
    route_description: str
    metric_references: tuple[MetricReference, ...] = field(default_factory=tuple)
    schema_version: int = 1

    def __post_init__(self):
        need(self.schema_version == 1, "only schema version 1 is known")
        for name in ("dataset_id", "video_path", "capture_device", "environment", "route_description"):
            need(bool(str(getattr(self, name)).strip()), f"{name} must not be blank")
        need(len(self.metric_references) > 0, "at least one metric reference is needed")
