"""File sinks: reports, lists, clouds, meshes, pictures, and the match database's transaction.

Rows are written side by side into the shared folder and then joined in order into the one file that readers expect; the joining
streams bytes through Spark's file system and holds none of them.
"""

from __future__ import annotations

import json
import sqlite3
import struct
import tempfile
import uuid
import zlib
from itertools import batched
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequence import before, numbered, running
from ..session import discard, shared_path, written
from .ranges import FACE, PROPERTIES, VERTEX

#: Pair ids that are deleted at once.
DELETED_AT_ONCE = 10_000


def _fs(spark: SparkSession, uri: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def refuse_non_empty(spark: SparkSession, folder: str) -> None:
    """Commands that extract or select write into absent or empty folders only."""
    fs, p = _fs(spark, folder)
    if fs.exists(p) and len(fs.listStatus(p)):
        raise FileExistsError(f"{folder} is not empty")


def write_bytes(spark: SparkSession, uri: str, data: bytes) -> None:
    """A small file from the driver, through Spark's file system."""
    fs, p = _fs(spark, uri)
    out = fs.create(p, True)
    out.write(bytearray(data))
    out.close()


def joined(spark: SparkSession, uri: str, *parts: bytes | str) -> None:
    """One file of these bytes and, in order of their names, the files of these folders. It appears whole, under its name, at the end."""
    fs, target = _fs(spark, uri)
    temporary = f"{uri}.{uuid.uuid4().hex[:8]}"
    _, path = _fs(spark, temporary)
    out = fs.create(path, True)
    for part in parts:
        if isinstance(part, bytes):
            out.write(bytearray(part))
            continue
        source, folder = _fs(spark, part)
        for name in sorted(s.getPath().toString() for s in source.listStatus(folder) if s.getPath().getName().startswith("part-")):
            held = source.open(_fs(spark, name)[1])
            spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(held, out, 65536, False)
            held.close()
        source.delete(folder, True)
    out.close()
    fs.delete(target, True)
    if not fs.rename(path, target):
        raise OSError(f"{temporary} can't be renamed to {uri}")


def _lines(df: DataFrame, order: list, line) -> str:
    """A folder with one line a row, in order over its files."""
    folder = shared_path(df.sparkSession, "lines")
    df.orderBy(*order).select(line.alias("value")).write.text(folder)
    return folder


def _packed(df: DataFrame, order: list[str], pack) -> str:
    """A folder with the bytes that ``pack(pandas rows)`` makes of ordered rows."""
    from pyarrow import fs

    folder = shared_path(df.sparkSession, "packed")
    store, root = (fs.LocalFileSystem(), folder.removeprefix("file://")) if folder.startswith("file:") else fs.FileSystem.from_uri(folder)

    def run(batches):
        store.create_dir(root, recursive=True)
        name, n = f"{root}/part-{TaskContext.get().partitionId():06d}", 0
        with store.open_output_stream(part := f"{root}/.{uuid.uuid4().hex}") as out:
            for pdf in batches:
                out.write(pack(pdf))
                n += len(pdf)
        store.move(part, name)
        yield pd.DataFrame({"n": [n]})

    made, path = _fs(df.sparkSession, folder)
    made.mkdirs(path)  # no rows, no tasks: the folder is there all the same
    df.orderBy(*order).mapInPandas(run, "n long").write.format("noop").mode("overwrite").save()
    return folder


def image_files(df: DataFrame, folder: str, name: str, content: str) -> None:
    """One file a row, written where the row is, under a name of the attempt first: a repeated task leaves whole files."""
    from pyarrow import fs

    store, root = (fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")) if folder.startswith(("/", "file:")) else fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)

    def put(rows):
        for r in rows:
            part = f"{root}/.{r[name]}.{uuid.uuid4().hex[:8]}"
            with store.open_output_stream(part) as out:
                out.write(bytes(r[content]))
            store.move(part, f"{root}/{r[name]}")

    df.select(name, content).foreachPartition(put)


def csv(df: DataFrame, uri: str, order: list[str]) -> None:
    """One file with a header line, rows in order."""
    spark = df.sparkSession
    folder = shared_path(spark, "csv")
    df.orderBy(*order).write.csv(folder)
    joined(spark, uri, (",".join(df.columns) + "\n").encode(), folder)


def image_list(df: DataFrame, uri: str, name: str = "filename", order: list[str] | None = None) -> None:
    """One name a line, in order."""
    joined(df.sparkSession, uri, _lines(df, order or [name], F.col(name)))


def pair_list(df: DataFrame, uri: str, a: str = "a", b: str = "b", order: list[str] | None = None) -> None:
    joined(df.sparkSession, uri, _lines(df, order or [a, b], F.concat_ws(" ", a, b)))


def json_report(spark: SparkSession, report: DataFrame, uri: str) -> dict:
    """A one-row report as indented, strict JSON with a final newline."""
    row = json.loads(report.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).first()["j"])
    write_bytes(spark, uri, (json.dumps(row, indent=2, allow_nan=False) + "\n").encode())
    return row


def ascii_ply(points: DataFrame, uri: str, order: list[str]) -> None:
    """x, y, z, red, green, blue as ASCII PLY."""
    head = ["ply", "format ascii 1.0", f"element vertex {points.count()}", *[f"property float {a}" for a in "xyz"], *[f"property uchar {c}" for c in ("red", "green", "blue")], "end_header"]
    line = F.format_string("%.9f %.9f %.9f %d %d %d", "x", "y", "z", "red", "green", "blue")
    joined(points.sparkSession, uri, ("\n".join(head) + "\n").encode(), _lines(points, order, line))


def _placed(vertices: DataFrame, triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices with their place from 0 in the order of vid, and triangles that name places."""
    v = numbered(vertices.select("vid", "x", "y", "z"), [], ["vid"], "place")
    t = triangles.select("fid", "a", "b", "c")
    for k in "abc":
        t = t.join(v.select(F.col("vid").alias(k), F.col("place").alias(f"_{k}")), k)
    return v, t.select("fid", *[F.col(f"_{k}").alias(k) for k in "abc"])


def mesh_ply(vertices: DataFrame, triangles: DataFrame, uri: str) -> None:
    """The binary little-endian mesh that files.ply_vertices() and ply_triangles() read: double places, zero normals, grey."""
    v, t = _placed(vertices, triangles)

    def points(pdf):
        out = np.zeros(len(pdf), VERTEX)
        out["xyz"], out["rgb"] = pdf[["x", "y", "z"]].to_numpy(), 128
        return out.tobytes()

    def faces(pdf):
        out = np.full(len(pdf), 3, FACE)
        out["abc"] = pdf[["a", "b", "c"]].to_numpy()
        return out.tobytes()

    head = ["ply", "format binary_little_endian 1.0", f"element vertex {v.count()}", *PROPERTIES[:-1], f"element face {t.count()}", PROPERTIES[-1], "end_header"]
    joined(v.sparkSession, uri, ("\n".join(head) + "\n").encode("ascii"), _packed(v, ["place"], points), _packed(t, ["fid"], faces))


def mesh_obj(vertices: DataFrame, triangles: DataFrame, uri: str) -> None:
    """Wavefront OBJ: vertex lines, then face lines that count vertices from 1."""
    v, t = _placed(vertices, triangles)
    corners = _lines(v, ["place"], F.format_string("v %.9f %.9f %.9f", "x", "y", "z"))
    joined(v.sparkSession, uri, corners, _lines(t, ["fid"], F.format_string("f %d %d %d", *[F.col(k) + 1 for k in "abc"])))


def mesh_glb(vertices: DataFrame, triangles: DataFrame, uri: str) -> None:
    """Binary glTF 2.0: one mesh of single-precision places and 32-bit indices."""
    v, t = _placed(vertices, triangles)
    n, m = v.count(), 3 * t.count()
    box = v.agg(*[f(a).alias(f"{k}{a}") for k, f in (("low", F.min), ("high", F.max)) for a in "xyz"]).first()
    edge = lambda k: [float(np.float32(box[f"{k}{a}"])) for a in "xyz"]
    # Fixed values of the format: component types (5126 single, 5125 unsigned), buffer targets (34962 vertices, 34963 indices), chunk names.
    scene = {
        "asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0}], "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}]}],
        "buffers": [{"byteLength": 12 * n + 4 * m}], "bufferViews": [{"buffer": 0, "byteOffset": 0, "byteLength": 12 * n, "target": 34962}, {"buffer": 0, "byteOffset": 12 * n, "byteLength": 4 * m, "target": 34963}],
        "accessors": [{"bufferView": 0, "componentType": 5126, "count": n, "type": "VEC3", "min": edge("low"), "max": edge("high")}, {"bufferView": 1, "componentType": 5125, "count": m, "type": "SCALAR"}],
    }
    text = json.dumps(scene, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 4)
    head = b"glTF" + struct.pack("<2I", 2, 12 + 8 + len(text) + 8 + 12 * n + 4 * m) + struct.pack("<I", len(text)) + b"JSON" + text + struct.pack("<I", 12 * n + 4 * m) + b"BIN\0"
    places = _packed(v, ["place"], lambda pdf: pdf[["x", "y", "z"]].to_numpy().astype("<f4").tobytes())
    joined(v.sparkSession, uri, head, places, _packed(t, ["fid"], lambda pdf: pdf[["a", "b", "c"]].to_numpy().astype("<u4").tobytes()))


def avi(frames: DataFrame, uri: str, order: list[str], jpeg: str, fps: int, width: int, height: int) -> None:
    """A motion-JPEG AVI of the rows' pictures in order, with its index behind them. Null pictures are frames without bytes."""
    riff = lambda kind, *body: kind + struct.pack("<I", sum(map(len, body))) + b"".join(body)
    picture = F.coalesce(jpeg, F.lit(b"")).alias("_jpeg")
    long = F.octet_length("_jpeg").cast("long")
    placed = written(running(frames.select(*order, picture), [], order, long + long % 2 + 8, "_at").select("_at", "_jpeg"), "video-frames")
    sums = placed.agg(F.count("*").alias("n"), F.max(F.col("_at") + long + long % 2 + 8).alias("size")).first()
    main = struct.pack("<10I", round(1e6 / fps), 0, 0, 0, sums["n"], 0, 1, 0, width, height) + b"\0" * 16
    video = b"vidsMJPG" + b"\0" * 12 + struct.pack("<2I", 1, fps) + b"\0" * 28
    head = riff(b"LIST", b"hdrl", riff(b"avih", main), riff(b"LIST", b"strl", riff(b"strh", video)))
    movi, index = 4 + (sums["size"] or 0), 16 * sums["n"]
    start = b"RIFF" + struct.pack("<I", 4 + len(head) + 8 + movi + 8 + index) + b"AVI " + head + b"LIST" + struct.pack("<I", movi) + b"movi"
    chunk = lambda data: riff(b"00dc", bytes(data)) + b"\0" * (len(data) % 2)
    entry = lambda at, size: b"00dc" + struct.pack("<3I", 0x10, 4 + at, size)  # noqa: E731  # every picture stands alone; offsets count from the list's name
    body = _packed(placed, ["_at"], lambda pdf: b"".join(map(chunk, pdf["_jpeg"])))
    entries = _packed(placed.select("_at", long.alias("_size")), ["_at"], lambda pdf: b"".join(map(entry, pdf["_at"], pdf["_size"])))
    joined(frames.sparkSession, uri, start, body, b"idx1" + struct.pack("<I", index), entries)
    discard(placed)


def lines(df: DataFrame, uri: str, order: list[str], line, head: str = "") -> None:
    """A text file of a column expression, one line (or more) a row, in order."""
    joined(df.sparkSession, uri, head.encode(), _lines(df, order, line))


def sqlite_file(spark: SparkSession, uri: str, tables: dict[str, DataFrame]) -> None:
    """A SQLite database of these tables, written on the driver row by row and then put under its name: a local file format, so as large as one machine takes."""
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "string": "TEXT"}
    with tempfile.TemporaryDirectory() as folder:
        db = sqlite3.connect(f"{folder}/db")
        with db:
            for name, df in tables.items():
                db.execute(f"CREATE TABLE {name} ({', '.join(f'{c} {kinds[t]}' for c, t in df.dtypes)})")
                db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(df.columns))})", (tuple(r) for r in df.toLocalIterator()))
        db.close()
        fs, path = _fs(spark, uri)
        fs.copyFromLocalFile(_fs(spark, f"file://{folder}/db")[1], path)


def png(rgb: np.ndarray) -> bytes:
    """An 8-bit RGB picture."""
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[y].astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def projected(points: DataFrame, columns: list[str], width: int, height: int, margin: int = 80) -> DataFrame:
    """px, py and the columns of every point (x, y, z): its pixel on the plane of the cloud's first two principal axes, to one scale.

    Axes come from the second moments and the frame from the projected box, so the points stay where they are.
    """
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    m = points.agg(*[F.avg(a).alias(a) for a in "xyz"], *[F.covar_pop(a, b).alias(a + b) for a, b in pairs], F.count("*").alias("n")).first()
    if not m["n"]:
        return points.select(F.lit(0).alias("px"), F.lit(0).alias("py"), *columns)
    square = np.array([[m["".join(sorted(a + b))] for b in "xyz"] for a in "xyz"])
    axes = np.linalg.eigh(square)[1][:, ::-1]
    along = lambda k: sum((F.lit(float(axes[i, k])) * (F.col(a) - m[a]) for i, a in enumerate("xyz")), F.lit(0.0))
    flat = points.select(along(0).alias("_u"), along(1).alias("_v"), *columns)
    b = flat.agg(F.min("_u").alias("u0"), F.max("_u").alias("u1"), F.min("_v").alias("v0"), F.max("_v").alias("v1")).first()
    scale = min((width - 2 * margin) / max(b["u1"] - b["u0"], 1e-12), (height - 2 * margin) / max(b["v1"] - b["v0"], 1e-12))
    pixel = lambda c, start, most: F.greatest(F.lit(0), F.least(F.lit(most - 1), F.rint(start + c * scale))).cast("int")
    px, py = pixel(F.col("_u") - b["u0"], F.lit(float(margin)), width), pixel(-(F.col("_v") - b["v0"]), F.lit(float(height - margin)), height)
    return flat.select(px.alias("px"), py.alias("py"), *columns)


def raster(points: DataFrame, colours: list[str], order: str, width: int, height: int, margin: int = 80) -> DataFrame:
    """px, py and the colours of a picture's pixels: projected() points; of several on a pixel the last in order stays, as it would be painted over the others.

    So at most width x height rows come out. A path needs every point: see canvas().
    """
    flat = projected(points, [*colours, order], width, height, margin)
    return flat.groupBy("px", "py").agg(F.max_by(F.struct(*colours), order).alias("_c"), F.max(order).alias("_o")).select("px", "py", *[F.col(f"_c.{c}").alias(c) for c in colours], F.col("_o").alias("order"))


#: Pixels of lines that are drawn at once.
DRAWN_AT_ONCE = 1_000_000


def line_pixels(ends: np.ndarray, width: int, height: int) -> np.ndarray:
    """A picture's mask of lines (x0, y0, x1, y1), three pixels thick."""
    mask = np.zeros((height, width), bool)
    steps = np.maximum(np.abs(ends[:, 2:] - ends[:, :2]).max(1, initial=0), 1)
    upto = np.cumsum(steps + 1)
    cuts = np.searchsorted(upto, np.arange(DRAWN_AT_ONCE, upto[-1] if len(upto) else 0, DRAWN_AT_ONCE))
    for own, n in zip(np.split(ends, cuts), np.split(steps, cuts), strict=True):
        first = np.cumsum(n + 1) - (n + 1)
        at = np.arange((n + 1).sum()) - np.repeat(first, n + 1)
        xs, ys = (np.rint(np.repeat(own[:, i], n + 1) + at * np.repeat((own[:, i + 2] - own[:, i]) / n, n + 1)).astype(int) for i in (0, 1))
        for d in (-1, 0, 1):
            mask[np.clip(ys + d, 0, height - 1), xs] = mask[ys, np.clip(xs + d, 0, width - 1)] = True
    return mask


def canvas(pixels: DataFrame, width: int, height: int, background: int, path: tuple | None = None) -> np.ndarray:
    """The picture of raster()'s pixels on a plain ground; with ``path``, (line colour, start colour, end colour), all points are joined in order and the ends marked.

    A path's points (px, py, order) may be any number: each pair of successive pixels is drawn once, by the task that has it, and the driver takes the pixels that are on a line.
    """
    out = np.full((height, width, 3), background, np.uint8)
    if not path:
        rows = pixels.orderBy("order").toPandas()
        out[rows["py"].to_numpy(), rows["px"].to_numpy()] = rows[["red", "green", "blue"]].to_numpy()
        return out
    line, *marks = path
    pixels = pixels.select("px", "py", "order")
    steps = before(pixels, [], ["order"], _was=F.struct("px", "py")).where("_was is not null").select("_was.px", "_was.py", F.col("px").alias("x1"), F.col("py").alias("y1")).distinct()

    def draw(batches):
        mask = np.zeros((height, width), bool)
        for pdf in batches:
            mask |= line_pixels(pdf.to_numpy(np.int64), width, height)
        yield pd.DataFrame({"at": np.flatnonzero(mask)})

    out.reshape(-1, 3)[steps.mapInPandas(draw, "at long").distinct().toArrow()["at"].to_numpy()] = line
    ends = pixels.agg(*[f(F.struct("px", "py"), "order") for f in (F.min_by, F.max_by)]).first()
    rows_at, columns_at = np.mgrid[:height, :width]
    for at, colour in zip(ends, marks, strict=True):
        if at:
            out[(columns_at - at["px"]) ** 2 + (rows_at - at["py"]) ** 2 <= 100] = colour
    return out


def delete_pairs(database: str | Path, pairs: DataFrame) -> dict:
    """Deletes planned pairs from a local match database in one transaction. The plan streams through the driver, a partition at a time."""
    ids = pairs.select("pair_id").distinct().orderBy("pair_id")
    tables, planned = {"matches": 0, "two_view_geometries": 0}, 0
    db = sqlite3.connect(database)
    with db:
        for some in batched((r["pair_id"] for r in ids.toLocalIterator()), DELETED_AT_ONCE):
            planned += len(some)
            for t in tables:
                before = db.total_changes
                db.executemany(f"DELETE FROM {t} WHERE pair_id = ?", [(i,) for i in some])
                tables[t] += db.total_changes - before
    check = db.execute("PRAGMA integrity_check").fetchone()[0]
    db.close()
    return {"planned": planned, "matches_removed": tables["matches"], "geometries_removed": tables["two_view_geometries"], "integrity": check}
