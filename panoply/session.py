"""Session settings and the shared folder that iterative operators write to."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where a local session without spark.checkpoint.dir writes; removed at exit.
LOCAL = f"/tmp/checkpoints/panoply-core-{os.getpid()}"


def session(app: str = "panoply", cores: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the queries assume; on a cluster the launcher's own settings stay."""
    n = cores or os.cpu_count() or 4
    conf = {"spark.sql.shuffle.partitions": n, "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": memory, "spark.ui.showConsoleProgress": "false"}
    builder = SparkSession.builder.appName(app)
    if "SPARK_MASTER" not in os.environ:
        builder = builder.master(f"local[{n}]")
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new folder's URI inside the folder in spark.checkpoint.dir, which driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{LOCAL}"
        atexit.register(shutil.rmtree, LOCAL, ignore_errors=True)
    if "://" not in base and base.startswith("/"):
        base = f"file://{base}"
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read again, so that loops don't grow their lineage."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


#: Rows up to which a written table is broadcast.
SMALL = 100_000


def small(df: DataFrame) -> DataFrame:
    """A written table of narrow rows as the small side of a join: broadcast if it has few rows, else left to a join by key."""
    return F.broadcast(df) if df.count() <= SMALL else df


def discard(df: DataFrame) -> None:
    """Deletes what written() wrote for df, once nothing reads it any more."""
    if path := getattr(df, "_written", None):
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
