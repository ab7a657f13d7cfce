"""The stitch plan, cloud neighbourhoods and the command line on synthetic captures."""

import json
import sqlite3
import struct

import numpy as np
import pytest

from panoply import cli
from panoply.functions import kernels as K
from panoply.operators import clouds, keyframes, sequence
from panoply.plans.stitch import calibrate, rotation, stitch
from panoply.schemas import KeyframeConfig
from panoply.sources import files, ranges, sinks

F, CX, CY = 400.0, 300.0, 200.0


def tape_picture():
    image = np.zeros((400, 600, 3), np.uint8)
    for x in range(80, 521):
        y = 310 + round((x - 80) * 20 / 440)
        image[y - 6 : y + 6, x] = (255, 220, 0)
    return image


def write_model(folder, frames, scale, places):
    """A camera row that looks along z at a plane five units away; all lengths are multiplied by scale."""
    folder.mkdir(parents=True)
    (folder / "cameras.txt").write_text(f"# one\n1 SIMPLE_RADIAL 600 400 {F} {CX} {CY} 0\n")
    (folder / "points3D.txt").write_text("".join(f"{i} {x * scale} {y * scale} {5 * scale} 10 20 30 0.1\n" for i, (x, y) in enumerate(places)))
    lines = []
    for k, frame in enumerate(frames):
        c = (frame - 706) * 0.1
        lines.append(f"{k + 1} 1 0 0 0 {-c * scale} 0 0 1 frame_{frame:05d}_t{frame / 5:09.3f}.png")
        lines.append(" ".join(f"{F * (x - c) / 5 + CX} {F * y / 5 + CY} {i}" for i, (x, y) in enumerate(places)) + " 1.0 2.0 -1")
    (folder / "images.txt").write_text("\n".join(lines) + "\n")


def test_calibration_and_stitch(spark, tmp_path):
    places = np.random.default_rng(2).uniform(0.1, 2, (40, 2))
    write_model(tmp_path / "a", [706, 707, 709], 1.0, places)
    write_model(tmp_path / "b", [703, 704, 705, 706], 2.0, places)
    (tmp_path / "img").mkdir()
    for frame in (705, 706, 707):
        (tmp_path / "img" / f"frame_{frame:05d}_t{frame / 5:09.3f}.png").write_bytes(sinks.png(tape_picture()))
    a, b = (calibrate(spark, str(tmp_path / m), str(tmp_path / "img"), f, 1.2192, floor_v=150.0) for m, f in (("a", 707), ("b", 705)))
    assert a.reconstructed_distance_units == pytest.approx(np.hypot(5.5, 0.25), rel=0.03) and b.meters_per_unit == pytest.approx(a.meters_per_unit / 2, rel=1e-6)
    assert a.floor_candidate_points == 40 and a.floor_inlier_fraction == 1.0 and a.floor_rmse_units < 1e-6
    report, points, cameras = stitch(spark, str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "img"), main_seam=706, secondary_seam=706, calibrations=(a, b))
    assert report["secondary_to_main_scale"] == pytest.approx(0.5) and report["seam_position_gap_m"] == pytest.approx(0, abs=1e-9)
    assert report["seam_geometry_gate_passed"] and report["seam_geometry_within_0_25m_fraction"] == 1.0 and report["seam_orientation_gap_deg"] == pytest.approx(0, abs=1e-5)
    assert report["incoming_step_m"] == pytest.approx(0.1 * a.meters_per_unit) == report["outgoing_step_m"]
    assert (points.count(), cameras.count(), report["missing_frame_ranges"]) == (80, 7, [[708, 708]])
    with pytest.raises(ValueError, match="no pose"):
        stitch(spark, str(tmp_path / "a"), str(tmp_path / "b"), "", main_seam=709, secondary_seam=706, calibrations=(a, b))
    turn = rotation([np.cos(0.3), 0, 0, np.sin(0.3)])
    assert np.allclose(turn @ turn.T, np.eye(3)) and turn[1, 0] == pytest.approx(np.sin(0.6))


def test_neighbours_far_and_near(spark):
    rng = np.random.default_rng(5)
    p = np.vstack([rng.uniform(0, 1, (150, 3)), [[40.0, 0, 0], [0.5, 0.5, 0.5], [0.5, 0.5, 0.5]]])
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double")
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    got = {r.id: r.nearest for r in clouds.nearest(df.where("id >= 140"), df.where("id < 140"), "id").collect()}
    assert got == pytest.approx({i: d[i, :140].min() for i in range(140, len(p))})
    means = np.sort(d, axis=1)[:, :20].mean(1)
    assert {r.id: r.mean_distance for r in clouds.neighbour_distance(df, "id", 20).collect()} == pytest.approx(dict(enumerate(means)))
    kept = {r.id for r in clouds.without_outliers(df, "id", 20, 2.5).collect()}
    assert kept == set(np.flatnonzero(means < means.mean() + 2.5 * means.std(ddof=1))) and 150 not in kept
    assert clouds.nearest(df, df.where("id < 0"), "id").count() == 0 and clouds.neighbour_distance(df.where("id < 0"), "id").count() == 0
    flat = df.where("id < 150").selectExpr("id", "x", "y", "0D as z")
    n = clouds.normals(flat, "id", radius=0.4).toPandas()
    assert np.allclose(np.abs(n.nz), 1, atol=1e-6)


def test_places_over_ranges(spark):
    df = spark.range(1000).selectExpr("(id * 37) % 500 as v", "id")
    got = sorted((r.v, r.id, r.place) for r in sequence.numbered(df, [], ["v", "id"], "place").collect())
    assert [g[2] for g in got] == list(range(1000))


def test_long_videos_stream_through_the_fold(spark):
    cfg = KeyframeConfig(min_interval_s=0.4, max_interval_s=1.2, motion_threshold=5.0, min_features=1, blur_percentile=10.0)
    rng = np.random.default_rng(8)
    rows = [(v, i, i * 0.2, float(rng.uniform(0, 100)), 50) for v, n in ((1, 25_000), (2, 1), (3, 2), (4, 300)) for i in range(n)]
    df = spark.createDataFrame(rows, "video_id long, sequence long, timestamp_s double, sharpness double, feature_count long").repartition(7)
    got = {(r.video_id, r.sequence): r.reason for r in keyframes.select(df, cfg).collect()}
    assert len(got) == len(rows)
    for v in (1, 2, 3, 4):
        own = [dict(zip(("video_id", "sequence", "timestamp_s", "sharpness", "feature_count"), r, strict=True)) for r in rows if r[0] == v]
        blur, last = float(np.percentile([r["sharpness"] for r in own], 10)), None
        for k, r in enumerate(own):
            selected, reason, *_ = keyframes.decide(r, last, k == len(own) - 1, blur, cfg, keyframes.value_pair())
            assert got[v, r["sequence"]] == reason
            last = r if selected else last


def textures(n, still=False):
    base = K._box(np.random.default_rng(12).integers(0, 255, (120, 260)).astype(float), 5) / 25
    for i in range(n):
        g = np.full((120, 160), 90.0) if still else base[:120, 2 * i : 2 * i + 160]
        yield np.repeat(g.astype(np.uint8)[..., None], 3, axis=2)


@pytest.mark.parametrize("still", [False, True])
def test_select_keyframes_from_pictures(spark, tmp_path, still):
    (tmp_path / "in").mkdir()
    for i, image in enumerate(textures(12, still)):
        (tmp_path / "in" / f"frame_{i:05d}_t{i * 0.2:09.3f}.png").write_bytes(sinks.png(image))
    r = cli.main(["select-keyframes", "--frames-dir", str(tmp_path / "in"), "--output-dir", str(tmp_path / "out"), "--max-interval-s", "1.0", "--target-motion-ratio", "0.005", "--min-features", "5"], spark)
    assert 2 <= r["selected_keyframes"] < 12 and r["coverage_fraction"] == 1.0 and r["max_selected_gap_s"] <= 1.2
    assert {"first_frame", "last_frame"}.isdisjoint(r["rejections"]) and sum(r["rejections"].values()) == 12 - r["selected_keyframes"]
    assert r["quality"]["candidate_sharpness"]["maximum"] >= r["quality"]["selected_sharpness"]["median"] and len(r["bins"]) == r["total_bins"] and r["config"]["max_interval_s"] == 1.0
    assert ("selected_max_gap_fallback" in (tmp_path / "out" / "keyframes.csv").read_text()) == still
    head, *lines = (tmp_path / "out" / "keyframes.csv").read_text().splitlines()
    assert head.split(",") == list(cli.KEYFRAME_CSV) and len(lines) == 12
    table = [dict(zip(head.split(","), x.split(","), strict=True)) for x in lines]
    assert all((x["selected"] == "True") == x["output_filename"].startswith("frames/frame_") for x in table) and table[0]["initial_tracked_features"] == "0"
    assert still or all(int(x["initial_tracked_features"]) >= int(x["tracked_features"]) > 0 for x in table[1:])
    listed = (tmp_path / "out" / "image_list.txt").read_text().splitlines()
    assert len(listed) == r["selected_keyframes"] and listed[0] == "frame_00000_t00000.000.png" and all((tmp_path / "in" / n).exists() for n in listed)
    names = sorted(p.name for p in (tmp_path / "out" / "frames").iterdir() if p.suffix == ".png")
    assert len(names) == r["selected_keyframes"] and names[0] == "frame_00000_source_00000_t00000.000.png"
    with pytest.raises(FileExistsError):
        cli.main(["select-keyframes", "--frames-dir", str(tmp_path / "in"), "--output-dir", str(tmp_path / "out")], spark)


def riff(kind, body):
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def test_video_commands(spark, tmp_path):
    io = spark._jvm.java.io

    def jpeg(image):
        out = io.ByteArrayOutputStream()
        spark._jvm.javax.imageio.ImageIO.write(spark._jvm.javax.imageio.ImageIO.read(io.ByteArrayInputStream(sinks.png(image))), "jpg", out)
        return bytes(out.toByteArray())

    avih = struct.pack("<10I", 100_000, 0, 0, 0, 20, 0, 1, 0, 160, 120) + b"\0" * 16
    strh = b"vidsMJPG" + b"\0" * 12 + struct.pack("<2I", 1, 10) + b"\0" * 28
    head = riff(b"LIST", b"hdrl" + riff(b"avih", avih) + riff(b"LIST", b"strl" + riff(b"strh", strh)))
    (tmp_path / "v.avi").write_bytes(riff(b"RIFF", b"AVI " + head + riff(b"LIST", b"movi" + b"".join(riff(b"00dc", jpeg(i)) for i in textures(20)))))
    r = cli.main(["inspect-video", "--video", str(tmp_path / "v.avi"), "--output", str(tmp_path / "r.json"), "--full-decode"], spark)
    assert r["complete_decode"] and json.loads((tmp_path / "r.json").read_text()) == r
    r = cli.main(["extract-frames", "--video", str(tmp_path / "v.avi"), "--output-dir", str(tmp_path / "out"), "--target-fps", "2"], spark)
    assert (r["frames"], r["stride"], r["achieved_fps"]) == (4, 5, pytest.approx(2.0)) and r["sharpness"]["minimum"] > 0
    assert len([p for p in (tmp_path / "out" / "frames").iterdir() if p.suffix == ".jpg"]) == 4
    lines = (tmp_path / "out" / "frames.csv").read_text().splitlines()
    assert lines[0] == "sequence,source_frame,timestamp_s,sharpness,brightness_mean,filename" and [x.split(",")[1] for x in lines[1:]] == ["0", "5", "10", "15"]


def test_report_commands(spark, tmp_path):
    out = str(tmp_path / "m.json")
    r = cli.main(["init-dataset", "--dataset-id", "d", "--video", "v.mov", "--output", out], spark)
    assert files.manifest(spark, out).first().metric_references[0].distance_m == r["metric_references"][0]["distance_m"] == 1.2192
    (tmp_path / "s.json").write_text(json.dumps({"anchor": {"name": "tape", "distance_m": 1.2192, "reconstructed_units": 0.5}, "checks": [{"name": "door", "actual_m": 0.9144, "reconstructed_units": 0.36}]}))
    r = cli.main(["scale-report", "--input", str(tmp_path / "s.json"), "--output", out], spark)
    assert r["meters_per_unit"] == 2.4384 and r["dimensions"][0]["estimated_m"] == pytest.approx(0.877824) and r["mean_percent_error"] == pytest.approx(4.0)
    (tmp_path / "images.txt").write_text("\n".join(f"{i} 1 0 0 0 {x} 0 0 1 {i:06d}.jpg\n" for i, x in enumerate((0, -1, 0))) + "\n")
    r = cli.main(["trajectory-report", "--images-txt", str(tmp_path / "images.txt"), "--output-dir", str(tmp_path / "t"), "--expected-images", "3"], spark)
    assert r["path_length_units"] == 2.0 and all(r["gates"].values())
    assert (tmp_path / "t" / "trajectory.ply").read_text().splitlines()[:3] == ["ply", "format ascii 1.0", "element vertex 3"] and (tmp_path / "t" / "trajectory.png").read_bytes()[:4] == b"\x89PNG"
    assert (tmp_path / "t" / "trajectory.csv").read_text().splitlines()[0] == "image_id,image_name,cx,cy,cz"
    (tmp_path / "logs").mkdir()
    for name, n in (("0.txt", 5), ("1.txt", 812), ("2.txt", 812)):
        (tmp_path / "logs" / name).write_text(f"Registered images: {n}\nPoints: 3\n")
    r = cli.main(["sparse-report", "--logs-dir", str(tmp_path / "logs"), "--output", out], spark)
    assert (r["name"], r["registered_images"], r["observations"]) == ("1.txt", 812, None)


def test_rematch_commands(spark, tmp_path):
    db = tmp_path / "db.sqlite"
    with sqlite3.connect(db) as c:
        c.execute("create table images(image_id integer primary key, name text)")
        for t in ("matches", "two_view_geometries"):
            c.execute(f"create table {t}(pair_id integer primary key)")
        c.executemany("insert into images values (?, ?)", [(i, f"frame_{n:05d}_t0.jpg") for i, n in ((1, 10), (2, 11), (3, 20), (4, 21))])
        c.execute("insert into matches values (?)", (2147483647 + 3,))
        c.execute("insert into two_view_geometries values (?)", (2147483647 + 3,))
    args = ["--database", str(db), "--pair-list", str(tmp_path / "p"), "--report", str(tmp_path / "r.json")]
    r = cli.main(["prepare-cross-rematch", *args, "--first-start-frame", "10", "--first-end-frame", "11", "--second-start-frame", "20", "--second-end-frame", "21"], spark)
    assert (r["planned"], r["matches_removed"], r["geometries_removed"], r["integrity"]) == (4, 1, 1, "ok") and (r["first_images"], r["second_images"], r["second_end_frame"]) == (2, 2, 21)
    r = cli.main(["prepare-targeted-rematch", *args, "--start-frame", "10", "--end-frame", "20", "--overlap", "2"], spark)
    assert (r["planned"], r["selected_images"], r["overlap"]) == (1, 3, 2) and (tmp_path / "p").is_file() and spark.read.text(str(tmp_path / "p")).first().value == "frame_00010_t0.jpg frame_00011_t0.jpg"


def test_mesh_command(spark, tmp_path):
    t = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]], float)
    faces = np.array([[0, 1, 2], [0, 1, 3], [0, 2, 3], [1, 2, 3]])
    head = "\n".join(["ply", "format binary_little_endian 1.0", "element vertex 8", "element face 8", *ranges.PROPERTIES, "end_header"]) + "\n"
    body = b"".join(struct.pack("<6d3B", *p, 0, 0, 1, 1, 2, 3) for p in np.vstack([t, t + [10, 0, 0]])) + b"".join(struct.pack("<B3I", 3, *f) for f in np.vstack([faces, faces + 4]))
    (tmp_path / "m.ply").write_bytes(head.encode() + body)
    r = cli.main(["dense-qa", "--mesh-ply", str(tmp_path / "m.ply"), "--output-dir", str(tmp_path / "o")], spark)
    assert r["watertight"] and r["largest_two_sampled_gap_m"] == 9.0 and r["largest_two_centroid_distance_m"] == 10.0 and r["surface_area"] == pytest.approx(2 * (1.5 + 3**0.5 / 2)) and (r["vertices"], r["second_component_fraction"]) == (8, 0.5)
    assert (tmp_path / "o" / "dense_components.png").read_bytes()[:4] == b"\x89PNG" and r["components"][0]["extent_x"] == 1.0 and r and [c["vertices"] for c in r["components"]] == [4, 4]


def test_sparse_plan_and_bundle_commands(spark, tmp_path):
    (tmp_path / "img").mkdir()
    for i in range(5):
        (tmp_path / "img" / f"frame_{i:03d}.jpg").write_bytes(b"x")
    r = cli.main(["plan-sparse", "--images-dir", str(tmp_path / "img"), "--workspace", str(tmp_path / "w"), "--loop-anchor-window", "2"], spark)
    assert (r["images"], r["loop_pairs"], [c["stage"] for c in r["commands"]]) == (5, 4, ["feature_extractor", "sequential_matcher", "loop_pairs", "mapper"])
    assert (tmp_path / "w" / "loop_pairs.txt").read_text() == "frame_000.jpg frame_003.jpg\nframe_000.jpg frame_004.jpg\nframe_001.jpg frame_003.jpg\nframe_001.jpg frame_004.jpg\n"
    with pytest.raises(FileExistsError):
        cli.main(["plan-sparse", "--images-dir", str(tmp_path / "img"), "--workspace", str(tmp_path / "w")], spark)
    with sqlite3.connect(tmp_path / "m.db") as c:
        c.execute("create table images(image_id integer primary key, name text)")
        c.execute("insert into images values (1, 'a.jpg')")
    with pytest.raises(ValueError, match="images"):
        cli.main(["plan-sparse", "--images-dir", str(tmp_path / "img"), "--workspace", str(tmp_path / "w2"), "--matched-database", str(tmp_path / "m.db")], spark)
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "manifest.json").write_text(json.dumps({"components": {"main": {"registered_images": 1}}}))
    with pytest.raises(ValueError, match="not whole"):
        cli.main(["check-bundle", "--bundle-dir", str(tmp_path / "b"), "--output", str(tmp_path / "r.json")], spark)
    rows = [("main", float(i % 7), float(i % 5), 0.0) for i in range(35)]
    spark.createDataFrame(rows, "component string, x double, y double, z double").write.parquet(f"{tmp_path}/clouds")
    r = cli.main(["dense-summary", "--clouds", f"{tmp_path}/clouds", "--output-dir", str(tmp_path / "d"), "--voxel-size-m", "0.5", "--neighbours", "4"], spark)
    assert r["components"][0]["voxel_points"] == 35 and (tmp_path / "d" / "dense.ply").read_text().splitlines()[2] == f"element vertex {r['dense_points']}"
