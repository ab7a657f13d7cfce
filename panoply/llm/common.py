"""Shared plumbing of the corpus operators: the shared folder, written tables, files."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN = f"/tmp/checkpoints/panoply-{os.getpid()}"


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder's URI inside the folder that driver and executors share.

    That is ``spark.checkpoint.dir``. Where it is unset, a local session gets a folder of its own,
    removed at exit; a cluster session without it is an error, as no machine-local folder would do.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{_OWN}"
        os.makedirs(_OWN, exist_ok=True)
        atexit.register(shutil.rmtree, _OWN, ignore_errors=True)
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{base}" if base.startswith("/") else base
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = shared_dir(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._panoply_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes what materialize() wrote for df, once nothing reads it any more."""
    if path := getattr(df, "_panoply_path", None):
        delete(df.sparkSession, path)


def delete(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str):
    """(pyarrow file system, path): the local one for file URIs, else the store that the scheme names."""
    from pyarrow import fs

    if uri.startswith("file:") or uri.startswith("/"):
        path = uri.removeprefix("file:")
        return fs.LocalFileSystem(), "/" + path.lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    """Writes a whole file under a name of this attempt and renames it, so a repeated task leaves one whole file."""
    store, path = filesystem(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod4(col):
    """crc32 of the id as text, mod 4."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % 4


def text_blocks(batches, column: int, limit: int = 24_000_000):
    """From Arrow batches: (batch slice, its texts with null as empty), slices of about ``limit`` characters at most, one row at least."""
    for batch in batches:
        texts = batch.column(column)
        at, n = 0, batch.num_rows
        while at < n:
            size, end = 0, at
            while end < n and (end == at or size < limit):
                size += len(texts[end].as_buffer() or b"") if texts[end].is_valid else 0
                end += 1
            part = batch.slice(at, end - at)
            yield part, [t or "" for t in part.column(column).to_pylist()]
            at = end
