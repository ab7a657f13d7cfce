"""The jobs as registered queries, with their SQL: each runs twice into one new folder, and the output is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import intake, preflight
from jobs.common import config
from panoply.session import shared_path


def job1_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "job1-intake")
    # a pattern, as a table may be one file, and a stream takes a folder or a pattern
    for _ in range(2):  # the second run finds nothing new
        intake.run(spark, f"{sf_dir}/document[s].parquet", f"{folder}/out", f"{folder}/checkpoint")
    return intake.read_ledger(spark, f"{folder}/out")


def job2_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "job2-preflight")
    for _ in range(2):  # the second run overwrites the same days with the same rows
        preflight.run(spark, f"{sf_dir}/events.parquet", f"{folder}/out")
    out = preflight.read_reports(spark, f"{folder}/out").withColumn("day", F.col("day").cast("string"))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes])


QUERIES = {f.__name__: f for f in (job1_intake, job2_preflight)}
_C = config("preflight")
SQL = {
    "job1_intake": """SELECT doc_id, source, lang, sha256(coalesce(text, '')) AS sha256, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes, CAST(length(coalesce(text, '')) AS BIGINT) AS characters,
        CAST(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS BIGINT) AS lines FROM documents""",
    "job2_preflight": f"""WITH f AS (SELECT event_type AS camera, CAST(ts AS DATE) AS day, event_id AS sequence, (epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 1e6 AS t, value AS v FROM events WHERE ts IS NOT NULL AND value IS NOT NULL),
      r AS (SELECT *, CASE WHEN lag(v) OVER o IS NOT NULL THEN greatest(0, 1 - abs(v - lag(v) OVER o) / {_C["reach"]}) END AS track, row_number() OVER o AS rn FROM f WINDOW o AS (PARTITION BY camera, day ORDER BY t, sequence)),
      l AS (SELECT camera, day, max(t1 - coalesce(t0, ta)) AS longest FROM (SELECT camera, day, g, max(t) AS t1, min(t) AS ta, min(since) AS t0 FROM
          (SELECT *, rn - row_number() OVER (PARTITION BY camera, day ORDER BY rn) AS g FROM (SELECT *, lag(t) OVER (PARTITION BY camera, day ORDER BY rn) AS since FROM r) WHERE track < {_C["low_track"]}) GROUP BY ALL) GROUP BY ALL),
      b AS (SELECT camera, day, sum(n) AS blurred FROM (SELECT camera, day, g, count(*) AS n FROM (SELECT *, rn - row_number() OVER (PARTITION BY camera, day ORDER BY rn) AS g FROM r WHERE v < {_C["blur_below"]}) GROUP BY ALL HAVING max(t) - min(t) >= {_C["lasting_s"]}) GROUP BY ALL),
      sp AS (SELECT camera, day, count(*) AS frames, min(t) AS s, max(t) AS e, median(track) AS median_track FROM r GROUP BY ALL),
      bi AS (SELECT camera, day, s, e, unnest(range(CAST(greatest(1, ceil(greatest(e - s, 1e-9) / {_C["bin_s"]})) AS BIGINT))) AS bin FROM sp),
      bc AS (SELECT bi.camera, bi.day, bin, count(r.t) AS n FROM bi LEFT JOIN r ON r.camera = bi.camera AND r.day = bi.day AND r.t BETWEEN s + bin * {_C["bin_s"]} AND least(e, s + bin * {_C["bin_s"]} + {_C["bin_s"]}) GROUP BY ALL),
      k AS (SELECT camera, day, count(*) AS total_bins, count(*) FILTER (WHERE n > 0) AS covered_bins FROM bc GROUP BY ALL),
      a AS (SELECT camera, day, frames, e - s AS duration_s, total_bins, covered_bins, median_track, coalesce(longest, 0) AS longest, CAST(coalesce(blurred, 0) AS BIGINT) AS blurred FROM sp JOIN k USING (camera, day) LEFT JOIN l USING (camera, day) LEFT JOIN b USING (camera, day))
      SELECT camera, CAST(day AS VARCHAR) AS day, frames, round(duration_s, 6) AS duration_s, total_bins, covered_bins, round(median_track, 6) AS median_track_ratio, round(longest, 6) AS longest_low_track_s, blurred AS blurred_frames, round(blurred / frames, 6) AS blurred_fraction,
        covered_bins = total_bins AS bins_gate, coalesce(median_track >= {_C["least_median_track"]}, false) AS track_gate, longest <= {_C["longest_low_track_s"]} AS low_track_gate, blurred / frames < {_C["most_blurred"]} AS blur_gate FROM a""",
}
