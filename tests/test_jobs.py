"""The two jobs: runs over growing input, reruns, odd rows, settings, and their queries against DuckDB."""

import datetime as dt
import hashlib
import json
import shutil

import duckdb
import pytest

from jobs import intake, preflight, queries
from jobs.common import config

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, extra int"


def ledger(spark, target):
    return sorted((tuple(r) for r in intake.read_ledger(spark, target).collect()), key=repr)


def entry(doc_id, text, lang, source):
    t = text or ""
    return doc_id, source, lang, hashlib.sha256(t.encode()).hexdigest(), len(t.encode()), len(t), t.count("\n") + 1 if t else 0


def test_intake_takes_only_new_files_and_reruns_safely(spark, tmp_path):
    first = [(1, "a\nb", "en", "x/y"), (2, None, None, None), (3, "", "en", ""), (3, "", "en", ""), (None, "é" * 50_000, "en", "x/y")]
    second = [(4, "a\nb", "de", "x_y"), (5, "zz", "en", "x/y")]
    src, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    spark.createDataFrame([(*r, 7) for r in first], DOCS).repartition(3).write.parquet(src)
    assert intake.run(spark, src, out, mark) == {"read": 5, "held": 5}
    want = sorted((entry(*r) for r in first), key=repr)
    assert ledger(spark, out) == want
    assert intake.run(spark, src, out, mark) == {"read": 0, "held": 5}
    spark.createDataFrame([(*r, 7) for r in second], DOCS).write.mode("append").parquet(src)
    assert intake.run(spark, src, out, mark, {"files_per_batch": 1}) == {"read": 2, "held": 7}
    want = sorted((entry(*r) for r in first + second), key=repr)
    assert ledger(spark, out) == want
    got = {r.source: (r.documents, r.bytes, r.texts, r.maximum) for r in spark.read.parquet(f"{out}/summary").collect()}
    assert got == {"x/y": (3, 100_005, 3, 100_000.0), None: (1, 0, 1, 0.0), "": (2, 0, 1, 0.0), "x_y": (1, 3, 1, 3.0)}
    before = sorted(map(str, spark.read.parquet(f"{out}/summary").collect()))
    spark.read.parquet(f"{out}/summary").limit(1).write.parquet(f"{tmp_path}/torn")
    shutil.rmtree(f"{out}/summary")
    shutil.move(f"{tmp_path}/torn", f"{out}/summary")  # as if a run had broken off before it wrote the summary
    assert intake.run(spark, src, out, mark)["read"] == 0 and ledger(spark, out) == want
    assert sorted(map(str, spark.read.parquet(f"{out}/summary").collect())) == before


def test_intake_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/in")
    assert intake.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark") == {"read": 0, "held": 0}
    assert ledger(spark, f"{tmp_path}/out") == [] and spark.read.parquet(f"{tmp_path}/out/summary").count() == 0


EVENTS = "event_id long, ts timestamp_ntz, event_type string, value double, camera string"


def at(day, second):
    return dt.datetime(2024, 1, day) + dt.timedelta(seconds=second)


def test_preflight_replaces_only_the_days_it_reads(spark, tmp_path):
    cfg = config("preflight") | {"reach": 10.0, "low_track": 0.5, "longest_low_track_s": 15.0, "blur_below": 5.0, "lasting_s": 10.0, "bin_s": 20.0}
    # day 1: values jump at 20 and 30 s, so overlap is low from 10 to 30 s; blurred from 20 to 40 s but at 30
    day1 = [(i, at(1, 10 * i), "cam", v, "q") for i, v in enumerate([20.0, 20.0, 1.0, 20.0, 20.0, 20.0])]
    day2 = [(10 + i, at(2, 10 * i), "cam", v, "q") for i, v in enumerate([9.0, 1.0, 1.0, 1.0, 9.0])] + [(20, None, "cam", 3.0, "q"), (21, at(2, 7), None, 3.0, "q"), (22, at(2, 8), "cam", None, "q")]
    src, out = f"{tmp_path}/events", f"{tmp_path}/out"
    spark.createDataFrame(day1, EVENTS).write.parquet(src)
    assert preflight.run(spark, src, out, cfg) == {"read": 6, "wrote": 1}
    row = preflight.read_reports(spark, out).first()
    assert (row.frames, row.duration_s, row.longest_low_track_s, row.blurred_frames, row.low_track_gate, row.total_bins, row.covered_bins) == (6, 50.0, 20.0, 0, False, 3, 3)
    spark.createDataFrame(day2, EVENTS).write.mode("append").parquet(src)
    assert preflight.run(spark, src, out, cfg | {"first_day": "2024-01-02"}) == {"read": 6, "wrote": 2}
    got = {(r.camera, str(r.day)): (r.frames, r.blurred_frames, r.blur_gate, r.low_track_gate) for r in preflight.read_reports(spark, out).collect()}
    assert got == {("cam", "2024-01-01"): (6, 0, True, False), ("cam", "2024-01-02"): (5, 3, False, True), (None, "2024-01-02"): (1, 0, True, True)}
    before = sorted(map(str, preflight.read_reports(spark, out).collect()))
    preflight.run(spark, src, out, cfg)
    assert sorted(map(str, preflight.read_reports(spark, out).collect())) == before
    assert preflight.run(spark, src, out, cfg | {"first_day": "2025-01-01"}) == {"read": 0, "wrote": 0}
    assert sorted(map(str, preflight.read_reports(spark, out).collect())) == before


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"files_per_batch": 3}))
    assert config("intake", tmp_path / "c.json") == {"files_per_batch": 3}
    (tmp_path / "c.json").write_text(json.dumps({"files": 3}))
    with pytest.raises(ValueError, match="unknown settings: files"):
        config("intake", tmp_path / "c.json")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_job_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    want = con.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    plain = lambda r: tuple(round(float(x), 4) if isinstance(x, float) else x for x in r)
    assert sorted(map(plain, df.select(*want.columns).collect())) == sorted(map(plain, want.fetchall()))
