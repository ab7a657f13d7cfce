"""Domain views over the driver's tables, as DataFrames and as the SQL that the oracles start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str, video: str = "user_id") -> DataFrame:
    """A user's events as a video's frames; or those of another column's values."""
    w = Window.partitionBy(video)
    e = table(spark, sf_dir, "events")
    e = e.withColumn("_m", F.min("ts").over(w)).withColumn("sequence", (F.row_number().over(w.orderBy("ts", "event_id")) - 1).cast("long"))
    return e.select(F.col(video).alias("video_id"), "sequence", F.col("event_id").alias("source_frame"), (F.expr("timestampdiff(MICROSECOND, _m, ts)") / F.lit(1e6)).alias("timestamp_s"), F.col("value").alias("sharpness"), F.col("value").alias("brightness_mean"), F.get_json_object("props", "$.k").cast("long").alias("feature_count"))


FRAMES = """f AS (SELECT user_id AS video_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS sequence, event_id AS source_frame,
    (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS timestamp_s, value AS sharpness, value AS brightness_mean,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS feature_count FROM events)"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("model_id"), (F.col("event_id") + 1).alias("image_id"), F.format_string("frame_%05d_t%09.3f.jpg", "event_id", "value").alias("name"))


IMAGES = """i AS (SELECT user_id AS model_id, event_id + 1 AS image_id, printf('frame_%05d_t%09.3f.jpg', event_id, value) AS name, event_id AS idx FROM events)"""


def stored_pairs(spark: SparkSession, sf_dir: str, mod: int) -> DataFrame:
    """Pairs in a match table: images of one model up to 30 ids apart whose ids' sum is divisible by mod."""
    i = images(spark, sf_dir).select("model_id", "image_id")
    a = i.select("model_id", F.col("image_id").alias("a"), F.explode(F.array(F.expr("image_id div 30"), F.expr("image_id div 30 + 1"))).alias("_b"))
    b = i.select("model_id", F.col("image_id").alias("b"), F.expr("image_id div 30").alias("_b"))
    p = a.join(b, ["model_id", "_b"]).where((F.col("b") > F.col("a")) & (F.col("b") - F.col("a") <= 30) & ((F.col("a") + F.col("b")) % mod == 0))
    return p.select("model_id", (F.lit(2147483647).cast("long") * F.col("a") + F.col("b")).alias("pair_id"))


def stored_sql(name: str, mod: int) -> str:
    return f"{name} AS (SELECT p.model_id, 2147483647 * p.image_id + q.image_id AS pair_id FROM i p JOIN i q ON p.model_id = q.model_id AND q.image_id > p.image_id AND q.image_id - p.image_id <= 30 AND (p.image_id + q.image_id) % {mod} = 0)"


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    part = lambda a, n: F.transform(F.slice("embedding", a, n), lambda x: x.cast("double"))
    return e.select(F.col("label").cast("long").alias("model_id"), F.col("vec_id").alias("image_id"), F.format_string("frame_%05d.jpg", "vec_id").alias("image_name"), part(1, 4).alias("q"), part(5, 3).alias("t"))


_Q = [f"CAST(embedding[{i}] AS DOUBLE)" for i in range(1, 8)]
_N = f"sqrt({'+'.join(f'{q}*{q}' for q in _Q[:4])})"
POSES = f"""e AS (SELECT CAST(label AS BIGINT) AS model_id, vec_id AS image_id, printf('frame_%05d.jpg', vec_id) AS image_name,
    {', '.join(f'{q}/{_N} AS {n}' for q, n in zip(_Q, ('w', 'x', 'y', 'z')))}, {', '.join(f'{q} AS t{k}' for k, q in enumerate(_Q[4:]))} FROM embeddings),
    p AS (SELECT *, -((1-2*(y*y+z*z))*t0 + 2*(x*y+w*z)*t1 + 2*(x*z-w*y)*t2) AS cx, -(2*(x*y-w*z)*t0 + (1-2*(x*x+z*z))*t1 + 2*(y*z+w*x)*t2) AS cy,
    -(2*(x*z+w*y)*t0 + 2*(y*z-w*x)*t1 + (1-2*(x*x+y*y))*t2) AS cz FROM e)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("point3d_id"), F.col("label").cast("long").alias("label"), *[F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")])


POINTS = "c AS (SELECT vec_id AS point3d_id, CAST(label AS BIGINT) AS label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vid"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), F.col("p_partkey").cast("double").alias("z"))


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles inside blocks of eight parts; those that would name an absent part are left out."""
    p = table(spark, sf_dir, "part").where("p_size % 5 <> 0")
    q, r = F.expr("(p_partkey div 8) * 8"), F.col("p_partkey") % 8
    o = F.when(F.col("p_size") % 2 == 0, 2).otherwise(7)
    t = p.select(F.col("p_partkey").alias("fid"), (q + r).alias("a"), (q + (r + 1) % 8).alias("b"), (q + (r + o) % 8).alias("c"))
    v = table(spark, sf_dir, "part").select("p_partkey")
    for k in "abc":
        t = t.join(v.withColumnRenamed("p_partkey", k), k, "left_semi")
    return t.select("fid", "a", "b", "c")


MESH = """v AS (SELECT p_partkey AS vid, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, CAST(p_partkey AS DOUBLE) AS z FROM part),
    t0 AS (SELECT p_partkey AS fid, (p_partkey // 8) * 8 + p_partkey % 8 AS a, (p_partkey // 8) * 8 + (p_partkey % 8 + 1) % 8 AS b,
        (p_partkey // 8) * 8 + (p_partkey % 8 + CASE WHEN p_size % 2 = 0 THEN 2 ELSE 7 END) % 8 AS c FROM part WHERE p_size % 5 <> 0),
    t AS (SELECT * FROM t0 WHERE a IN (SELECT vid FROM v) AND b IN (SELECT vid FROM v) AND c IN (SELECT vid FROM v)),
    ta AS (SELECT fid, a, b, c, 0.5 * sqrt(pow((v2.y-v1.y)*(v3.z-v1.z)-(v2.z-v1.z)*(v3.y-v1.y), 2) + pow((v2.z-v1.z)*(v3.x-v1.x)-(v2.x-v1.x)*(v3.z-v1.z), 2)
        + pow((v2.x-v1.x)*(v3.y-v1.y)-(v2.y-v1.y)*(v3.x-v1.x), 2)) AS area FROM t JOIN v v1 ON v1.vid = a JOIN v v2 ON v2.vid = b JOIN v v3 ON v3.vid = c),
    te AS (SELECT least(p, q) AS lo, greatest(p, q) AS hi, count(*) AS n FROM (SELECT a AS p, b AS q FROM t UNION ALL SELECT b, c FROM t UNION ALL SELECT c, a FROM t) GROUP BY ALL)"""
ROOTS = """ed AS (SELECT lo AS s, hi AS d FROM te UNION SELECT hi, lo FROM te), reach AS (SELECT vid AS s, vid AS d FROM v UNION SELECT reach.s, ed.d FROM reach JOIN ed ON reach.d = ed.s),
    ro AS (SELECT s AS vid, min(d) AS root FROM reach GROUP BY s)"""
COMPONENTS = """cm AS (SELECT root, count(*) AS vertices, avg(x) AS centroid_x, avg(y) AS centroid_y, avg(z) AS centroid_z FROM v JOIN ro USING (vid) GROUP BY root),
    cf AS (SELECT ro.root, count(*) AS triangles, sum(area) AS area FROM ta JOIN ro ON ro.vid = ta.a GROUP BY ro.root),
    ct AS (SELECT cm.*, coalesce(cf.triangles, 0) AS triangles, coalesce(cf.area, 0) AS area, row_number() OVER (ORDER BY vertices DESC, root) AS rank,
        vertices / sum(vertices) OVER () AS vertex_fraction FROM cm LEFT JOIN cf USING (root))"""
