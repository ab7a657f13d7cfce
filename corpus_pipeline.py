"""The corpus pipeline: quality filter, near duplicates, secrets, source mix, token ids. Each stage reads what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panoply.llm import bpe, mixing, quality, secrets, simhash
from panoply.llm.common import drop, materialize, table


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network scores under its threshold go. A null text is scored as empty."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints one document stays: the smallest by doc_id, then by the SHA-256 of its text.

    Rows with one id and texts in several groups stay once for each group. Of rows with one id and text the smallest by the
    other columns stays. Documents without an id can't be told apart by it and all stay.
    """
    first = simhash.first_rows(docs.where("doc_id is not null").select("doc_id", "text")).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_first"))
    marked = docs.withColumn("_digest", simhash.text_digest(F.col("text")))
    same = marked.join(first, (F.col("doc_id") == F.col("_id")) & (F.col("_digest") == F.col("_first")), "left_semi")
    row = F.struct(*[c for c in docs.columns if c != "text"], "text")
    kept = same.groupBy("doc_id", "_digest").agg(F.min(row).alias("_row")).select(*[F.col("_row")[c].alias(c) for c in docs.columns])
    return kept.unionByName(docs.where("doc_id is null"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of the secret scan becomes a mark; n_chars follows the text. Null texts stay null."""
    out = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.coalesce(F.char_length("text"), "n_chars").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: not, once or twice. Those without words are never taken."""
    return mixing.take(docs, mixing.plan(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids of each document copy."""
    return bpe.encode_documents(docs, ids=True)


STAGES = [("quality", drop_low_quality), ("near_duplicates", drop_near_duplicates), ("secrets", redact_secrets), ("mix", mix_sources), ("encode", encode)]

#: SQL can express neither the network nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
