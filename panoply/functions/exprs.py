"""Column builders: frame indices, pair keys, poses, distances, gates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The grammar of frame names, and the image-pair key's base.
FRAME = r"(?:^|[/\\])frame_(\d+)(?:_|\.)"
LAST_DIGITS = r"(\d+)\.[^.]+$"
CANDIDATE = r"(?i)^frame_(\d+)_t(\d+(?:\.\d+)?)\.(jpg|jpeg|png)$"
PAIR_BASE = 2147483647


def _number(name: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).cast("long")


def frame_index_drop(name: Column) -> Column:
    """The index after frame_, or null."""
    return _number(name, FRAME)


def frame_index_loose(name: Column) -> Column:
    """The index after frame_, else the last digits before the extension, else null."""
    return F.coalesce(_number(name, FRAME), _number(name, LAST_DIGITS))


def frame_index_strict(name: Column) -> Column:
    """The index after frame_; a name without one is an error."""
    return F.coalesce(_number(name, FRAME), F.raise_error(F.concat(F.lit("no frame index in "), name)).cast("long"))


def pair_key(a: Column, b: Column) -> Column:
    """The key of an undirected pair of ids known to be positive and different. Safe wherever the optimizer moves it."""
    return F.lit(PAIR_BASE).cast("long") * F.least(a, b) + F.greatest(a, b)


def pair_id(a: Column, b: Column) -> Column:
    """The key of an undirected pair. Equal or non-positive ids are an error."""
    return F.when((a <= 0) | (b <= 0) | (a == b), F.raise_error(F.lit("a pair needs two different positive ids")).cast("long")).otherwise(pair_key(a, b))


def unit(q: list[Column]) -> list[Column]:
    norm = F.sqrt(sum((c * c for c in q[1:]), q[0] * q[0]))
    return [c / norm for c in q]


def rotation(q: list[Column]) -> list[list[Column]]:
    """The rotation matrix of a quaternion (w, x, y, z), normalised first."""
    w, x, y, z = unit(q)
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def camera_center(q: list[Column], t: list[Column]) -> list[Column]:
    """-R^T t. A zero quaternion is an error."""
    r = rotation(q)
    zero = sum((c * c for c in q[1:]), q[0] * q[0]) == 0
    return [F.when(zero, F.raise_error(F.lit("zero quaternion")).cast("double")).otherwise(-(r[0][i] * t[0] + r[1][i] * t[1] + r[2][i] * t[2])) for i in range(3)]


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def quaternion_angle(p: list[Column], q: list[Column]) -> Column:
    """Degrees between two orientations, whatever the quaternions' signs."""
    dot = sum((a * b for a, b in zip(unit(p)[1:], unit(q)[1:], strict=True)), unit(p)[0] * unit(q)[0])
    return F.degrees(2 * F.acos(clip(F.abs(dot), 0.0, 1.0)))


def trace_angle(r: list[list[Column]], s: list[list[Column]]) -> Column:
    """Degrees between two rotation matrices by the trace of R S^T."""
    trace = sum((r[i][k] * s[i][k] for i in range(3) for k in range(3)), F.lit(0.0))
    return F.degrees(F.acos(clip((trace - 1) / 2, -1.0, 1.0)))


def distance(p: list[Column], q: list[Column]) -> Column:
    return F.sqrt(sum(((a - b) * (a - b) for a, b in zip(p, q, strict=True)), F.lit(0.0)))


def transform_point(p: list[Column], scale: float, matrix: list[list[float]], shift: list[float]) -> list[Column]:
    return [sum((F.lit(scale * matrix[i][k]) * p[k] for k in range(3)), F.lit(0.0)) + F.lit(shift[i]) for i in range(3)]


def wsl_path(path: Column) -> Column:
    """C:\\a\\b as /mnt/c/a/b."""
    slashes = F.regexp_replace(path, r"\\", "/")
    drive = F.regexp_extract(slashes, "^([A-Za-z]):", 1)
    return F.when(drive == "", slashes).otherwise(F.concat(F.lit("/mnt/"), F.lower(drive), F.regexp_replace(slashes, "^[A-Za-z]:", "")))
