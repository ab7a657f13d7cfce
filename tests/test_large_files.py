"""What a large file costs its tasks."""

import sqlite3

import numpy as np

from panoply.sources import files, ranges


def test_a_sqlite_file_is_never_a_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "SQLITE_ROWS", 7)
    db = sqlite3.connect(tmp_path / "db.sqlite")
    with db:
        db.execute("CREATE TABLE images (image_id INTEGER, name TEXT)")
        db.executemany("INSERT INTO images VALUES (?, ?)", [(i, f"n{i}" if i % 5 else None) for i in range(100)])
    db.close()
    t = files.sqlite_table(spark, str(tmp_path / "db.sqlite"), "SELECT image_id, name FROM images", "image_id long, name string")
    assert "content" not in t._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, t.collect())) == [(i, f"n{i}" if i % 5 else None) for i in range(100)]


def test_small_parts_of_a_large_mesh_grow(spark, tmp_path):
    n = 20_000
    body = np.zeros(n, ranges.VERTEX)
    body["xyz"][:, 0] = np.arange(n)
    head = ["ply", "format binary_little_endian 1.0", f"element vertex {n}", *ranges.PROPERTIES[:-1], "element face 0", ranges.PROPERTIES[-1], "end_header"]
    (tmp_path / "m.ply").write_bytes(("\n".join(head) + "\n").encode() + body.tobytes())
    parts = ranges._PlyReader(f"{tmp_path}/m.ply", "vertex", 60).partitions()
    assert len(parts) <= 2 * ranges.PARTS and [p.first for p in parts] == [0, *np.cumsum([p.count for p in parts])[:-1]] and sum(p.count for p in parts) == n
    assert len(ranges._PlyReader(f"{tmp_path}/m.ply", "vertex", 51 * 1000).partitions()) == 20
    got = files.ply_vertices(spark, f"{tmp_path}/m.ply", part=60).selectExpr("count(*) AS n", "count_if(vid = x) AS same").first()
    assert tuple(got) == (n, n)
