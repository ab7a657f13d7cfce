"""Python data sources that read large binary files by byte ranges: triangle meshes and motion-JPEG videos."""

from __future__ import annotations

import bisect
import math
import operator
import re
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

# The record layouts of the binary mesh format.
VERTEX = np.dtype([("xyz", "<f8", 3), ("normal", "<f8", 3), ("rgb", "u1", 3)])
FACE = np.dtype([("n", "u1"), ("abc", "<u4", 3)])
PROPERTIES = [*(f"property double {a}" for a in ("x", "y", "z", "nx", "ny", "nz")), *(f"property uchar {c}" for c in ("red", "green", "blue")), "property list uchar uint vertex_indices"]
#: Bytes of a partition, of a read inside it, and of the window in which a mesh's header has to end.
PART, READ, HEADER = 64_000_000, 4_000_000, 65_536
#: Parts of a mesh from which on they grow, up to a read's size: a task for each few kilobytes of a large file is mostly overhead.
PARTS = 256


def opened(uri: str):
    """A random-access file: a local one for file URIs and plain paths, else in the store that the scheme names."""
    from pyarrow import fs

    if uri.startswith(("file:", "/")):
        return fs.LocalFileSystem().open_input_file("/" + uri.removeprefix("file:").lstrip("/"))
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def ply_header(content: bytes) -> tuple[dict[str, int], int]:
    """Element counts and where the body starts."""
    end = content.find(b"end_header\n")
    if end < 0 or not content.startswith(b"ply\n") or b"format binary_little_endian 1.0\n" not in content[:end]:
        raise ValueError("not a binary little-endian PLY file")
    lines = content[:end].decode("ascii").splitlines()
    if [x for x in PROPERTIES if x not in lines]:
        raise ValueError("the file's vertex or face layout is unknown")
    counts = {m[1].decode(): int(m[2]) for m in re.finditer(rb"^element (\w+) (\d+)$", content[:end], re.M)}
    if not {"vertex", "face"} <= counts.keys():
        raise ValueError("vertex and face elements are needed")
    return counts, end + len(b"end_header\n")


@dataclass
class Records(InputPartition):
    """Records first to first + count of a fixed-size kind that starts at this byte."""

    path: str
    start: int
    first: int
    count: int
    limit: int


class _PlyReader(DataSourceReader):
    def __init__(self, path: str, element: str, part: int):
        self.path, self.element, self.part = path, element, part
        self.kind = VERTEX if element == "vertex" else FACE

    def partitions(self):
        with opened(self.path) as f:
            counts, at = ply_header(f.read_at(min(HEADER, f.size()), 0))
            faces = at + counts["vertex"] * VERTEX.itemsize
            if f.size() < faces + counts["face"] * FACE.itemsize:
                raise ValueError("the file ends early")
        most = counts[self.element] * self.kind.itemsize // PARTS
        step = max(1, max(self.part, min(most, READ)) // self.kind.itemsize)
        start = at if self.element == "vertex" else faces
        return [Records(self.path, start, i, min(step, counts[self.element] - i), counts["vertex"]) for i in range(0, counts[self.element], step)] or [Records(self.path, start, 0, 0, 0)]

    def read(self, p: Records):
        size, step = self.kind.itemsize, max(1, READ // self.kind.itemsize)
        with opened(p.path) as f:
            for i in range(p.first, p.first + p.count, step):
                n = min(step, p.first + p.count - i)
                held = np.frombuffer(f.read_at(n * size, p.start + i * size), self.kind)
                ids = pa.array(np.arange(i, i + n))
                if self.element == "vertex":
                    if not np.isfinite(held["xyz"]).all():
                        raise ValueError("vertices must be finite")
                    yield pa.RecordBatch.from_arrays([ids, *[pa.array(np.ascontiguousarray(held["xyz"][:, k])) for k in range(3)]], names=["vid", "x", "y", "z"])
                    continue
                if (held["n"] != 3).any():
                    raise ValueError("faces must be triangles")
                if held["abc"].max(initial=0) >= p.limit:
                    raise ValueError("a face names an absent vertex")
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(held["abc"][:, k].astype(np.int64)) for k in range(3)]], names=["fid", "a", "b", "c"])


class PlySource(DataSource):
    """Format panoply_ply: vertices (vid, x, y, z) or, with option element = face, triangles (fid, a, b, c) of one binary mesh."""

    @classmethod
    def name(cls) -> str:
        return "panoply_ply"

    def schema(self) -> str:
        return "vid long, x double, y double, z double" if self.options.get("element", "vertex") == "vertex" else "fid long, a long, b long, c long"

    def reader(self, schema):
        return _PlyReader(self.options["path"], self.options.get("element", "vertex"), int(self.options.get("part", PART)))


# Entries of the two kinds of a video's index, and what a frame's chunk is called behind its stream's number.
OLD_INDEX = np.dtype([("stream", "S2"), ("kind", "S2"), ("flags", "<u4"), ("offset", "<u4"), ("size", "<u4")])
NEW_INDEX = np.dtype([("offset", "<u4"), ("size", "<u4")])
SUPER_INDEX = np.dtype([("offset", "<u8"), ("size", "<u4"), ("ticks", "<u4")])
FRAME_KINDS = (b"dc", b"db")


def _chunks(f, at: int, end: int):
    """(kind, where its body starts, length) of the chunks of at..end; what lists hold comes after the list itself. Only headers are read."""
    todo = [(at, end)]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            kind, length = struct.unpack("<4sI", f.read_at(8, at))
            body = at + 8
            at = body + length + length % 2
            if kind in (b"RIFF", b"LIST"):
                name = f.read_at(4, body)
                yield name, body, min(length, end - body)
                if name != b"movi":
                    todo.append((min(at, end), end))
                    at, end = body + 4, min(body + length, end)
            else:
                yield kind, body, length


def _walked(f, at: int, end: int) -> list[tuple[int, int]]:
    """Frames of at..end by their chunks' headers, record lists included."""
    return [(body, length) for kind, body, length in _chunks(f, at, end) if kind[2:] in FRAME_KINDS and length]


def _is_frame(f, body: int, length: int, end: int) -> bool:
    """Whether the body of a frame's chunk of this length, that ends by ``end``, starts there."""
    head = f.read_at(8, body - 8) if body + length <= end else b""
    return head[2:4] in FRAME_KINDS and struct.unpack("<I", head[4:])[0] == length


def _old_index(f, body: int, length: int, movi: int) -> list[tuple[int, int]]:
    """Frames by the index behind a file's first frames. Its offsets count from the frame list's name or from the file's start: the first entry's chunk tells."""
    held = f.read_at(length, body)
    held = np.frombuffer(held, OLD_INDEX, len(held) // OLD_INDEX.itemsize)
    held = held[np.isin(held["kind"], FRAME_KINDS) & (held["size"] > 0)]
    places, sizes = held["offset"].astype(np.int64) + 8, held["size"].tolist()
    for base in (movi, 0):
        if sizes and _is_frame(f, base + int(places[0]), sizes[0], f.size()):
            return list(zip((places + base).tolist(), sizes, strict=True))
    return []


def _new_index(f, content: bytes) -> list[tuple[int, int]]:
    """Frames by a stream's index of indexes, or none where it is no such index."""
    out = []
    if len(content) < 24 or struct.unpack_from("<HBB", content) != (4, 0, 0) or content[10:12] not in FRAME_KINDS:
        return out
    for offset, _, _ in np.frombuffer(content, SUPER_INDEX, min(struct.unpack_from("<I", content, 4)[0], (len(content) - 24) // 16), 24).tolist():
        head = f.read_at(32, offset) if offset + 32 <= f.size() else b""
        if len(head) < 32 or head[:2] != b"ix" or struct.unpack_from("<HBB", head, 8) != (2, 0, 1):
            continue
        n, base = struct.unpack_from("<I", head, 12)[0], struct.unpack_from("<Q", head, 20)[0]
        held = f.read_at(8 * n, offset + 32)
        held = np.frombuffer(held, NEW_INDEX, len(held) // 8)
        sizes = held["size"] & 0x7FFFFFFF  # the highest bit marks frames that need others
        out += [x for x in zip((held["offset"].astype(np.int64) + base).tolist(), sizes.tolist(), strict=True) if x[1]]
    return out


def avi_frames(f) -> tuple[dict, list[tuple[int, int]]]:
    """From an open AVI file: width, height, fps and declared frames, and each frame's (offset, size).

    Frames are taken from the file's index (of either kind), in a few reads; chunk headers are read one by one only where a frame list
    has no index, or one whose first and last entry aren't found in the list, and before and behind what the index names. Files over
    2 GB go on in further RIFF segments. Frames without bytes are none.
    """
    size, info, movis, indexed, streams, stream = f.size(), {}, [], [], 0, None
    if size < 12 or f.read_at(4, 0) != b"RIFF" or f.read_at(4, 8) != b"AVI ":
        raise ValueError("not an AVI file")
    for kind, body, length in _chunks(f, 0, size):
        if kind == b"avih":
            head = f.read_at(40, body)
            per, declared = struct.unpack_from("<I", head)[0], struct.unpack_from("<I", head, 16)[0]
            info.update(fps=1e6 / per if per else 0.0, declared_frames=declared, width=struct.unpack_from("<I", head, 32)[0], height=struct.unpack_from("<I", head, 36)[0])
        elif kind == b"strh":
            stream = f.read_at(4, body)
            streams += stream == b"vids"
            scale, rate = struct.unpack("<2I", f.read_at(8, body + 20)) if stream == b"vids" else (0, 0)
            if scale and rate:
                info["fps"] = rate / scale
        elif kind == b"indx" and stream == b"vids":
            indexed += _new_index(f, f.read_at(length, body))
        elif kind == b"movi":
            movis.append((body, body + length))
        elif kind == b"idx1" and movis and not indexed:
            indexed += _old_index(f, body, length, movis[0][0])
    if not info or info["width"] <= 0 or info["height"] <= 0 or not info["fps"] > 0:
        raise ValueError("the video has no usable width, height or frame rate")
    frames, indexed = [], sorted(set(indexed)) if streams == 1 else []
    for at, end in movis:
        inside = indexed[bisect.bisect_left(indexed, (at + 4, 0)) : bisect.bisect_left(indexed, (end, 0))]
        if inside and _is_frame(f, *inside[0], end) and _is_frame(f, *inside[-1], end):
            (first, _), (last, length) = inside[0], inside[-1]
            frames += _walked(f, at + 4, first - 8) + inside + _walked(f, last + length + length % 2, end)
        else:
            frames += _walked(f, at + 4, end)
    return info, frames


def whole_jpeg(data: bytes) -> bool:
    """Whether the bytes are a whole JPEG picture by its markers: start, segments by their lengths, a frame header, a scan and the end."""
    if data[:2] != b"\xff\xd8" or data.rstrip(b"\0")[-2:] != b"\xff\xd9":
        return False
    at, framed = 2, False
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, length = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        framed |= 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC)
        if marker == 0xDA:
            return framed
        at += 2 + length
    return False


@dataclass
class Frames(InputPartition):
    """Frames of a file as (number in the video, place among the kept ones, offset, size)."""

    path: str
    fps: float
    frames: list


class _AviReader(DataSourceReader):
    #: Comparisons that planning applies, on these columns of a kept frame (number in the video, place among the kept ones, seconds).
    COMPARED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, In: lambda a, b: a in b, IsNotNull: lambda a, b: True}
    COLUMNS = {("source_frame",): 0, ("sequence",): 1, ("timestamp_s",): 2}

    def __init__(self, options: dict):
        self.o, self.tests = options, []

    def pushFilters(self, filters):
        """Comparisons of a frame's number, place and time with numbers choose frames before any is read; Spark applies the others."""
        for x in filters:
            value = getattr(x, "value", None)
            values = value if isinstance(x, In) else () if isinstance(x, IsNotNull) else (value,)
            if type(x) in self.COMPARED and x.attribute in self.COLUMNS and all(isinstance(v, (int, float)) and not math.isnan(v) for v in values):
                self.tests.append((type(x), self.COLUMNS[x.attribute], value))
            else:
                yield x

    def partitions(self):
        path = self.o["path"]
        with opened(path) as f:
            info, frames = avi_frames(f)
        fps, start, end = info["fps"], float(self.o.get("start_s", 0)), self.o.get("end_s")
        stride = max(1, round(fps / float(self.o["target_fps"]))) if "target_fps" in self.o else 1
        first, last = round(start * fps), info["declared_frames"] if end is None else round(float(end) * fps)
        kept = [(i, k, *frames[i]) for k, i in enumerate(range(first, min(last, len(frames)), stride))]
        if not kept:
            raise ValueError(f"no frames extracted from {path}")
        kept = [x for x in kept if all(self.COMPARED[kind]((x[0], x[1], x[0] / fps)[c], value) for kind, c, value in self.tests)]
        parts, size = [[]], 0
        for x in kept:
            if size + x[3] > int(self.o.get("part", PART)) and parts[-1]:
                parts.append([])
                size = 0
            parts[-1].append(x)
            size += x[3]
        return [Frames(path, fps, p) for p in parts]

    def read(self, p: Frames):
        with opened(p.path) as f:
            for source, sequence, offset, size in p.frames:
                time = source / p.fps
                yield p.path, sequence, source, time, f"frame_{sequence:05d}_t{time:09.3f}.jpg", bytes(f.read_at(size, offset))


class AviSource(DataSource):
    """Format panoply_avi: the frames of one motion-JPEG video at a rate (target_fps) in an interval (start_s, end_s).

    Filters on source_frame, sequence and timestamp_s choose the byte ranges that are read.
    """

    @classmethod
    def name(cls) -> str:
        return "panoply_avi"

    def schema(self) -> str:
        return "path string, sequence long, source_frame long, timestamp_s double, filename string, jpeg binary"

    def reader(self, schema):
        return _AviReader(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    """Makes both formats known, and lets Python sources take filters: Spark refuses to read a source that does while that is off."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    for source in (PlySource, AviSource):
        spark.dataSource.register(source)
    return spark
