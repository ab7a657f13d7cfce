"""Preflight of captures, day by day: python -m jobs.preflight EVENTS TARGET [--config FILE]

Before a costly reconstruction each capture is checked: are all time bins covered, do neighbouring frames overlap, how long does
low overlap last, how much is lastingly blurred. A camera's events of one day are one capture; the job reads the days that the
settings name, or all, and replaces just those days' partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, config, main
from panoply.operators import preflight
from panoply.schemas import PreflightConfig

KEYS = ["camera", "day"]


def captures(events: DataFrame, settings: dict) -> DataFrame:
    """Events as frames of their camera's capture of that day. Events without a time or a value are left out."""
    day = F.to_date("ts")
    f = events.where(F.col("ts").isNotNull() & F.col("value").isNotNull()).select(F.col("event_type").alias("camera"), day.alias("day"), F.col("event_id").alias("sequence"), (F.expr("timestampdiff(MICROSECOND, date_trunc('DAY', ts), ts)") / F.lit(1e6)).alias("timestamp_s"), F.col("value").cast("double").alias("sharpness"))
    for bound, keep in (("first_day", F.col("day").__ge__), ("last_day", F.col("day").__le__)):
        if settings[bound]:
            f = f.where(keep(F.to_date(F.lit(settings[bound]))))
    return f


def read_reports(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target)


def run(spark: SparkSession, events: str, target: str, settings: dict | None = None) -> dict:
    """Writes one row for each camera and day under TARGET, partitioned by day. The days that it reads are overwritten whole, the others stay; a rerun gives the same rows."""
    settings = settings or config("preflight")
    cfg = PreflightConfig(**{k: v for k, v in settings.items() if k not in ("first_day", "last_day", "reach")})
    frames = captures(spark.read.parquet(events), settings)
    read = frames.count()
    LOG.info("preflight: read %d frames from %s, days %s to %s", read, events, settings["first_day"] or "first", settings["last_day"] or "last")
    report = preflight.report(preflight.with_tracks(frames, KEYS, settings["reach"]), KEYS, cfg)
    report.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(target)
    days = frames.select("day").distinct()
    wrote = read_reports(spark, target).join(F.broadcast(days), "day", "left_semi").count() if read else 0
    LOG.info("preflight: wrote %d captures under %s", wrote, target)
    return {"read": read, "wrote": wrote}


if __name__ == "__main__":
    main("preflight", run, {"events": "Parquet table of events", "target": "folder of the reports"})
