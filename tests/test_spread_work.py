"""Work is dealt to many tasks, whatever the files that its rows come from."""

import numpy as np
import pandas as pd
from pyspark import TaskContext

from panoply.operators import sequence
from panoply.plans.measured import each
from panoply.streaming.keyframes import in_order


def test_rows_of_one_file_are_dealt_to_many_tasks(spark, tmp_path):
    spark.range(200).coalesce(1).write.parquet(f"{tmp_path}/one")
    got = each(spark.read.parquet(f"{tmp_path}/one"), "id", lambda r: (TaskContext.get().partitionId(),), "task long").collect()
    assert sorted(r.id for r in got) == list(range(200)) and len({r.task for r in got}) > 4


def test_ranges_grow_in_number_and_not_in_size(spark, monkeypatch):
    monkeypatch.setattr(sequence, "RANGE", 100)
    df = spark.range(3000).selectExpr("id % 3 AS k", "(id * 7919) % 3000 AS o")
    rows, ranges = sequence.ranged(df, ["k"], ["o"])
    assert ranges == 30 and rows.groupBy("_range").count().agg({"count": "max"}).first()[0] <= 300
    got = sequence.numbered(df, ["k"], ["o"], "i").collect()
    for k in range(3):
        mine = sorted((r.o, r.i) for r in got if r.k == k)
        assert [i for _, i in mine] == list(range(1000))


def test_a_groups_frames_in_order():
    rng = np.random.default_rng(5)
    parts = [pd.DataFrame({"timestamp_s": rng.integers(0, 4, n) / 2, "sequence": rng.permutation(n), "sharpness": rng.random(n)}) for n in (5, 0, 9)]
    parts[0].loc[2, "timestamp_s"] = np.nan
    want = pd.concat(parts).sort_values(["timestamp_s", "sequence"]).to_dict("records")
    assert [str(r) for r in in_order(iter(parts))] == [str(r) for r in want]


def test_blocks_of_pictures_are_dealt_to_many_tasks_and_compared_where_needed(spark):
    from panoply.operators import keyframes
    from panoply.schemas import KeyframeConfig

    cfg = KeyframeConfig(min_interval_s=0.4, max_interval_s=1.2, motion_threshold=10.0, min_features=20)
    rows = [(0, k, k / 5, 100.0 + 7 * (k % 9), 50) for k in range(4000)]
    frames = spark.createDataFrame(rows, "video_id long, sequence long, timestamp_s double, sharpness double, feature_count long")
    decided = keyframes.select(frames, cfg, pair=keyframes.value_pair())
    assert len({r.t for r in decided.selectExpr("spark_partition_id() AS t").distinct().collect()}) > 4
    held, compared = [dict(zip(frames.columns, r, strict=True)) for r in rows[:12]], []

    def pair(last, now):
        compared.append((last["sequence"], now["sequence"]))
        return keyframes.Motion(20.0, 1.0)

    assert keyframes._following(held, held[0], 1, 0.0, cfg, pair) == 2 and compared == [(0, 2)]
    assert keyframes._following(held, held[0], 7, 0.0, cfg, pair) == 7 and len(compared) == 1


def test_a_streams_files_are_looked_up_in_few_tasks(spark, tmp_path):
    from panoply.sources import files

    (tmp_path / "in").mkdir()
    for i in range(60):
        (tmp_path / "in" / f"frame_{i:05d}_t00000.{i}00.jpg").write_bytes(b"x")
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    with files.few_listings(spark):
        out = files.candidates_stream(spark, f"{tmp_path}/in").select("sequence").writeStream.format("parquet").option("path", f"{tmp_path}/out")
        q = out.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    seen = spark.sparkContext.statusTracker()
    tasks = [seen.getStageInfo(s).numTasks for j in seen.getJobIdsForGroup(str(q.runId)) for s in seen.getJobInfo(j).stageIds]
    assert tasks and max(tasks) < 60 and spark.read.parquet(f"{tmp_path}/out").count() == 60
    assert spark.conf.get(key) == before


def test_ordered_stream_asks_little_of_its_state():
    from pyspark.sql import Row

    from panoply.operators.keyframes import value_pair
    from panoply.plans.queries import CFG
    from panoply.streaming.keyframes import OrderedKeyframes

    class Held:
        def __init__(self):
            self.timers, self.rows, self.value = [], [], None

        registerTimer = property(lambda self: self.timers.append)  # noqa: N815  the interface's names
        getValueState = getListState = lambda self, *_: self  # noqa: N815
        appendList = property(lambda self: self.rows.extend)  # noqa: N815

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = list(rows)

    class Last(Held):
        def get(self):
            return self.value

        def update(self, v):
            self.value = v

    class Time:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.at

    p, held = OrderedKeyframes(CFG, 20.0, value_pair(), 100.0), Held()
    p.init(held)
    p.last = Last()
    rows = [Row(at=t * 1000, sequence=t, timestamp_s=float(t), sharpness=50.0, feature_count=30) for t in (3, 1, 2)]
    assert list(p.handleInputRows((7,), iter(rows), None)) == [] and held.timers == [3001]
    got = list(p.handleExpiredTimer((7,), Time(5000), None))
    assert [(r.video_id, r.sequence, r.reason) for r in got] == [(7, 1, "first_frame"), (7, 2, "reject_min_interval")]
    assert held.timers == [3001, 103_000] and [r[1] for r in held.rows] == [3]


def test_ordered_stream_agrees_with_the_sql(spark):
    import duckdb

    from panoply.plans.catalog import QUERIES, SQL

    db = duckdb.connect()
    db.execute("CREATE VIEW events AS FROM '/root/testdata/sf0.001/events.parquet'")
    want = db.execute(SQL["keyframe_stream_ordered"]).fetchall()
    assert sorted(map(tuple, QUERIES["keyframe_stream_ordered"](spark, "/root/testdata/sf0.001").collect())) == sorted(want)


def test_a_path_that_comes_back_to_its_pixels_is_drawn_whole(spark, monkeypatch):
    """A star: the path is at its middle before each of its tips, and every way there is on the picture."""
    from panoply.sources import sinks

    rng = np.random.default_rng(7)
    tips = np.column_stack([rng.normal(0, (8, 3), (40, 2)), np.zeros(40)])
    path = np.stack([np.zeros((40, 3)), tips], axis=1).reshape(-1, 3)
    df = spark.createDataFrame([(f"{i:03d}", *map(float, p)) for i, p in enumerate(path)], "order string, x double, y double, z double").repartition(5, "x")
    points = sinks.projected(df, ["order"], 120, 80, 10)
    at = np.array([(r.px, r.py) for r in points.orderBy("order").collect()])
    want, line = np.full((80, 120, 3), 248, np.uint8), (1, 2, 3)
    for a, b in zip(at[:-1], at[1:], strict=True):
        n = max(*abs(b - a), 1) + 1
        xs, ys = (np.rint(np.linspace(a[i], b[i], n)).astype(int) for i in (0, 1))
        for d in (-1, 0, 1):
            want[np.clip(ys + d, 0, 79), xs] = want[ys, np.clip(xs + d, 0, 119)] = line
    rows, columns = np.mgrid[:80, :120]
    for (x, y), colour in ((at[0], (4, 5, 6)), (at[-1], (7, 8, 9))):
        want[(columns - x) ** 2 + (rows - y) ** 2 <= 100] = colour
    monkeypatch.setattr(sinks, "DRAWN_AT_ONCE", 50)
    assert (sinks.canvas(points, 120, 80, 248, (line, (4, 5, 6), (7, 8, 9))) == want).all()
    ends = np.column_stack([at[:-1], at[1:]])
    mask = sinks.line_pixels(ends, 120, 80)
    assert (mask | (want != 248).any(axis=2) == (want != 248).any(axis=2)).all() and not sinks.line_pixels(ends[:0], 120, 80).any()
    empty = sinks.canvas(sinks.projected(df.limit(0), ["order"], 120, 80), 120, 80, 248, (line, line, line))
    assert (empty == 248).all()
