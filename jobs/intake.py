"""Intake of text artefacts into a fixity ledger: python -m jobs.intake SOURCE TARGET CHECKPOINT [--config FILE]

A capture's text artefacts (manifests, logs, notes) arrive as Parquet files in a folder. Each text's SHA-256, size and counts are
recorded once, so that later copies can be checked against them. A file stream with a checkpoint takes only files that are new.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, config, main
from panoply.operators.sequence import distribution, same

SCHEMA = "doc_id long, source string, lang string, sha256 string, bytes long, characters long, lines long, part string"


def fingerprints(docs: DataFrame) -> DataFrame:
    """A ledger row for each text. Null texts count as empty. part names the source in a path: never null, blank or with odd characters."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    part = F.concat(F.lit("s_"), F.regexp_replace(F.coalesce("source", F.lit("")), "[^A-Za-z0-9._-]", "_"))
    columns = {"sha256": F.sha2(text, 256), "bytes": F.octet_length(text), "characters": F.char_length(text), "lines": F.when(text == "", 0).otherwise(F.regexp_count(text, F.lit("\n")) + 1)}
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), *[c.cast("string" if n == "sha256" else "long").alias(n) for n, c in columns.items()], part.alias("part"))


def summary(ledger: DataFrame) -> DataFrame:
    """One row a source: rows, bytes, different texts, and the distribution of their bytes."""
    g = ledger.groupBy("source").agg(F.count("*").alias("documents"), F.sum("bytes").alias("bytes"), F.countDistinct("sha256").alias("texts"))
    sizes = distribution(ledger, ["source"], "bytes").withColumnRenamed("source", "_source")
    return g.join(sizes, same(["source"])).drop("_source")


def read_ledger(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(f"{target}/ledger").drop("part")


def _count(rows) -> int:
    """What rows() counts, 0 while its folder isn't there."""
    try:
        return rows()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0


def run(spark: SparkSession, source: str, target: str, checkpoint: str, settings: dict | None = None) -> dict:
    """Takes the files under SOURCE that are new since CHECKPOINT into TARGET/ledger, and writes TARGET/summary anew from the whole ledger.

    A run without new files changes nothing. A run that broke off is taken up where its checkpoint stands; the sink's own log
    keeps a batch from being counted twice, and a summary that doesn't count all of the ledger is written again.
    """
    settings = settings or config("intake")
    before = _count(lambda: read_ledger(spark, target).count())
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", settings["files_per_batch"]).parquet(source)
    writer = fingerprints(stream).writeStream.format("parquet").partitionBy("part").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.start(f"{target}/ledger").awaitTermination()
    ledger = read_ledger(spark, target)
    held = ledger.count()
    LOG.info("intake: read %d new rows from %s", held - before, source)
    if not held or _count(lambda: spark.read.parquet(f"{target}/summary").agg(F.sum("documents")).first()[0] or 0) != held:
        summary(ledger).write.mode("overwrite").parquet(f"{target}/summary")
        LOG.info("intake: wrote %s/summary", target)
    LOG.info("intake: %s/ledger holds %d rows", target, held)
    return {"read": held - before, "held": held}


if __name__ == "__main__":
    main("intake", run, {"source": "folder of Parquet files, or a pattern", "target": "folder of the ledger", "checkpoint": "folder of the stream's checkpoint"})
