"""Filter interaction audit: what each of five filters removes, in each of their 120 orders, by part."""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_blocks

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MARKS = b"#$%&*|"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
#: FIRST[mask, order]: the place (from 0) of the first filter of the order that a document with this failure mask fails; 5 if none.
FIRST = np.array([[next((k for k, f in enumerate(o) if m >> FILTERS.index(f) & 1), len(FILTERS)) for o in ORDERS] for m in range(1 << len(FILTERS))])
#: Rows whose 120 look-ups are held at once, and parts whose sums a task holds before it sends them on.
ROWS, PARTS = 2048, 256


def failures(text: str) -> int:
    """Bits 0 to 3: the text fails A (under 200 words), B (under half its words distinct), C (over 2 % capitals), D (holds a mark)."""
    data = text.encode("utf-8", "replace")
    words = data.split()  # bytes: the six ASCII white-space characters
    a = len(words) < 200
    b = 100 * len(set(words)) < 50 * len(words)
    c = 100 * (len(data) - len(data.translate(None, UPPER))) > 2 * len(text)
    d = len(data) != len(data.translate(None, MARKS))
    return a | b << 1 | c << 2 | d << 3


def measured(docs: DataFrame, text: str, part: str) -> DataFrame:
    """doc_id, part, mask (A to D), digest of each document."""

    def run(batches):
        for block, texts in text_blocks(batches, 2):
            masks = pa.array([failures(t) for t in texts], pa.int32())
            digests = pa.array([hashlib.sha256(t.encode("utf-8", "replace")).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), masks, digests], names=["doc_id", "part", "mask", "digest"])

    columns = [docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), docs[text].cast("string").alias("text")]
    return docs.select(*columns).mapInArrow(run, "doc_id long, part string, mask int, digest binary")


SUMS = ("removed", "good_lost", "toxic_lost")


def tally(batches):
    """From (part, mask, good, toxic, n): for each part the rows that each step of each order removes, by label, as arrays over order and step (the sixth: rows kept)."""
    steps = len(FILTERS) + 1
    cells = len(ORDERS) * steps
    held: dict[str, np.ndarray] = {}

    def sent():
        if held:
            sums = [pa.array([list(v[k]) for v in held.values()], pa.list_(pa.int64())) for k in range(len(SUMS))]
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *sums], names=["part", *SUMS])
            held.clear()

    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            b = batch.slice(at, ROWS)
            coded = b.column(0).dictionary_encode()
            part, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            mask, good, toxic, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
            # a row's cell in each order: part, order, the step that removes it
            where = (part[:, None] * len(ORDERS) + np.arange(len(ORDERS))) * steps + FIRST[mask]
            got = [np.bincount(where.ravel(), np.repeat(n * w, len(ORDERS)), len(names) * cells).astype(np.int64).reshape(-1, cells) for w in (1, good, toxic)]
            for k, name in enumerate(names):
                if name not in held and len(held) >= PARTS:
                    yield from sent()
                held[name] = held.get(name, 0) + np.stack([g[k] for g in got])
    yield from sent()


def interactions(docs: DataFrame, labels: DataFrame, text: str = "text", part: str = "source") -> DataFrame:
    """One row for each part, order of the filters and step: what the step's filter removes there, and what the step costs.

    Filter E fails rows whose text a smaller doc_id has too, anywhere in the table; rows that share the smallest id all pass it. A
    null doc_id is smaller than none and larger than none: such a row passes E and fails no other. Null texts count as empty, a
    null part as an empty string. A document is good (toxic) if any of its label rows says quality 1 (toxic 1). Repeated rows
    count each. No rows give no parts. Other columns aren't read.

    Rows meet by digest and id together, so a text that a third of all rows share is never gathered. Of E only the first ids
    are sent, and labels are joined once for rows of one id and text.
    """
    slim = materialize(measured(docs, text, part), "measured")
    rows = slim.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    first = slim.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    late = F.when(F.col("doc_id").isNotNull() & F.col("_first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    rows = rows.join(first, ["doc_id", "digest"], "left").join(known, "doc_id", "left")
    rows = rows.select("part", F.col("mask").bitwiseOR(late).alias("mask"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("good", "toxic")], "n")
    sums = rows.mapInArrow(tally, "part string, " + ", ".join(f"{c} array<long>" for c in SUMS))
    cells = sums.select("part", F.posexplode(F.arrays_zip(*SUMS)).alias("cell", "v")).groupBy("part", "cell").agg(*[F.sum(f"v.{c}").alias(c) for c in SUMS])
    steps = len(FILTERS) + 1
    cells = cells.select("part", F.expr(f"cell div {steps}").alias("_o"), (F.col("cell") % steps + 1).alias("step"), *SUMS)
    # kept after a step: whatever a later step removes, or none
    later = Window.partitionBy("part", "_o").orderBy("step").rowsBetween(1, Window.unboundedFollowing)
    orders = F.array(*map(F.lit, ORDERS))
    out = cells.withColumn("kept", F.sum("removed").over(later)).where(F.col("step") < steps)
    out = out.withColumn("filter_order", F.element_at(orders, (F.col("_o") + 1).cast("int"))).withColumn("_f", F.substring("filter_order", F.col("step"), F.lit(1)))
    # a filter removes all that fail it where it stands first, and only what fails nothing else where it stands last
    of = Window.partitionBy("part", "_f")
    out = out.withColumns({"_fails": F.max("removed").over(of), "unique_fails": F.min("removed").over(of), "shapley": F.sum("removed").over(of)})
    return out.select("part", "filter_order", F.col("step").cast("int").alias("step"), "kept", "removed", (F.col("_fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
