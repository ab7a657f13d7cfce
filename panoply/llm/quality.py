"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod4, drop, materialize, text_blocks

#: Bytes that a filter sees, bytes between its places, bytes of a chunk (its places' filters reach WIDTH - STEP bytes further).
WIDTH, STEP, CHUNK = 8, 2, 256
FILTERS, HIDDEN = 16, 16
#: The bound on what training sees: labelled rows of each class, whole, and bytes of them together; a row over an eighth of the bytes is no training row.
TRAIN_ROWS, TRAIN_BYTES = 1500, 8_000_000
EPOCHS, BATCH, RATE, DECAY = 6, 32, 0.01, 1e-5
LEAST_STEPS = 400
THRESHOLD = 0.7


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every text's bytes in rows of CHUNK + WIDTH - STEP, each row starting CHUNK after the one before, zeros at the end;
    and the first row of each text. An empty text is one row of zeros."""
    n = np.array([max(1, -(-len(t) // CHUNK)) for t in texts], np.int64)
    starts = np.append(0, np.cumsum(n)[:-1]) if len(n) else n
    out = np.zeros((int(n.sum()), CHUNK + WIDTH - STEP), np.uint8)
    for a, m, t in zip(starts.tolist(), n.tolist(), texts, strict=True):
        flat = np.zeros(m * CHUNK + WIDTH - STEP, np.uint8)
        flat[: len(t)] = np.frombuffer(t, np.uint8)
        out[a : a + m] = np.lib.stride_tricks.as_strided(flat, (m, CHUNK + WIDTH - STEP), (CHUNK, 1))
    return out, starts


class ByteCNN:
    """Filters over one-hot bytes (a value for each filter, place and byte), max over the chunk's places; over the chunks of
    a document their largest, smallest and mean; a hidden layer; one logit."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        f32 = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        self.p = {"filters": f32(WIDTH, 256, FILTERS, scale=0.3), "w1": f32(3 * FILTERS, HIDDEN, scale=0.2), "b1": np.zeros(HIDDEN, np.float32), "w2": f32(HIDDEN, scale=0.3), "b2": np.zeros(1, np.float32)}
        self.shift, self.constant = 0.0, None

    def pair_tables(self) -> np.ndarray:
        """The filters' values for each two bytes in a row: half the look-ups, and the same sums."""
        f = self.p["filters"]
        return np.stack([(f[k + 1][:, None] + f[k][None]).reshape(65536, FILTERS) for k in range(0, WIDTH, 2)])

    def pooled(self, rows: np.ndarray, tables: np.ndarray, where: bool = False):
        """Each chunk's largest value of each filter, and its place if asked for."""
        pairs = np.ascontiguousarray(rows).view("<u2")
        places = CHUNK // STEP
        total = tables[0][pairs[:, :places]]
        for k in range(1, WIDTH // 2):
            total += tables[k][pairs[:, k : k + places]]
        if where:
            at = total.argmax(axis=1)
            return np.take_along_axis(total, at[:, None], 1)[:, 0], at
        return total.max(axis=1)

    @staticmethod
    def document(pool: np.ndarray, starts: np.ndarray) -> np.ndarray:
        n = np.diff(np.append(starts, len(pool)))[:, None]
        return np.concatenate([np.maximum.reduceat(pool, starts), np.minimum.reduceat(pool, starts), np.add.reduceat(pool, starts) / n], axis=1)

    def logits(self, doc: np.ndarray) -> np.ndarray:
        return np.tanh(doc @ self.p["w1"] + self.p["b1"]) @ self.p["w2"] + self.p["b2"][0]

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> ByteCNN:
        """Adam on the log loss; the gradient of a maximum goes to its place alone."""
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        batches = max(1, -(-len(texts) // BATCH))
        epochs = max(epochs, min(60, -(-LEAST_STEPS // batches)))  # few rows: more rounds
        step, total = 0, epochs * batches
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                rows, starts = chunks([texts[i] for i in some])
                pool, place = self.pooled(rows, self.pair_tables(), where=True)
                doc = self.document(pool, starts)
                hidden = np.tanh(doc @ self.p["w1"] + self.p["b1"])
                out = hidden @ self.p["w2"] + self.p["b2"][0]
                y = labels[some].astype(np.float32)
                d_out = (1 / (1 + np.exp(-out)) - y).astype(np.float32) / len(some)
                d_hidden = d_out[:, None] * self.p["w2"] * (1 - hidden**2)
                d_doc = d_hidden @ self.p["w1"].T
                owner = np.repeat(np.arange(len(some)), np.diff(np.append(starts, len(rows))))
                n = np.bincount(owner)[:, None]
                hi, lo, avg = np.split(d_doc, 3, axis=1)
                d_pool = (avg / n)[owner]
                for grad, value in ((hi, np.maximum.reduceat(pool, starts)), (lo, np.minimum.reduceat(pool, starts))):
                    hit = pool == value[owner]
                    d_pool += np.where(hit, grad[owner] / np.add.reduceat(hit, starts, dtype=np.float32)[owner], 0)
                grads = {"w1": doc.T @ d_hidden, "b1": d_hidden.sum(0), "w2": hidden.T @ d_out, "b2": d_out.sum(keepdims=True), "filters": np.zeros_like(self.p["filters"])}
                which = np.broadcast_to(np.arange(FILTERS), place.shape)
                for w in range(WIDTH):
                    byte = rows[np.arange(len(rows))[:, None], place * STEP + w]
                    grads["filters"][w] = np.bincount((byte.astype(np.int64) * FILTERS + which).ravel(), d_pool.ravel(), 256 * FILTERS).reshape(256, FILTERS)
                step += 1
                rate = RATE * min(1.0, 2.0 * (1 - step / (total + 1)))
                for k, g in grads.items():
                    g = g + DECAY * self.p[k]
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.01 * (g * g - square[k])
                    self.p[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self

    def score(self, texts: list[bytes], block: int = 2048) -> np.ndarray:
        """One probability for each text, over all its chunks."""
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant if self.constant is not None else 0.0)
        rows, starts = chunks(texts)
        tables = self.tables if hasattr(self, "tables") else self.pair_tables()
        self.tables = tables
        pool = np.concatenate([self.pooled(rows[a : a + block], tables) for a in range(0, len(rows), block)])
        return 1 / (1 + np.exp(-(self.logits(self.document(pool, starts)).astype(np.float64) + self.shift)))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES, text: str = "text") -> ByteCNN:
    """Fits on at most ``rows`` labelled documents of each class, smallest id hash first, none of those held out
    (crc32 of the id as text mod 4 is 2), as long as their bytes fit in ``size``. Their texts are used whole.

    Rows whose label is null or neither 0 nor 1 are left out; contradicting labels count as the larger share says, and of several texts of one id the least
    in byte order counts, so reruns agree. Without two classes the score is the share of label 1 (one half without labels).
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("q")).where(crc_mod4("doc_id") != 2)
    known = known.select("doc_id", (F.col("q") >= 0.5).cast("int").alias("y"), F.xxhash64("doc_id").alias("h"))
    share = known.agg(F.avg("y"), F.count("*")).first()
    chosen = known.where("y = 0").orderBy("h", "doc_id").limit(rows).union(known.where("y = 1").orderBy("h", "doc_id").limit(rows))
    whole = F.encode(F.coalesce(docs[text].cast("string"), F.lit("")), "utf-8")
    some = docs.select("doc_id", whole.alias("b")).join(F.broadcast(chosen), "doc_id").where(F.octet_length("b") <= size // 8)  # chosen: 2 x rows at most
    some = materialize(some.groupBy("doc_id", "y", "h").agg(F.min("b").alias("b")), "training")
    order = ["h", "doc_id"]
    fits = F.sum(F.octet_length("b")).over(Window.partitionBy("y").orderBy(*order)) <= size
    got = some.withColumn("_fits", fits).where("_fits").orderBy(*order).select("y", "b").toArrow()
    drop(some)
    y = got["y"].to_numpy()
    model = ByteCNN()
    if not len(y) or y.min() == y.max():
        model.constant = float(y[0]) if len(y) else 0.5
        return model
    model.fit([b for b in got["b"].to_pylist()], y)
    # Both classes weigh alike in training; half the log odds of the labels' own share is given back.
    p = min(0.99, max(0.01, share[0]))
    model.shift = 0.5 * float(np.log(p / (1 - p)))
    return model


def classify(docs: DataFrame, model: ByteCNN, text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted. The score depends on the text alone; null counts as empty. No shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # filters and layers: under 200 kB whatever the data

    def run(batches):
        for part, texts in text_blocks(batches, 2, 4_000_000):
            score = sent.value.score([t.encode("utf-8", "replace") for t in texts])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(crc_mod4("doc_id") == 2, F.lit(False)).alias("held_out"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: ByteCNN, text: str = "text") -> DataFrame:
    """The rows of docs that the model predicts as label 1, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        for part, texts in text_blocks(batches, at, 4_000_000):
            yield part.filter(pa.array(sent.value.score([t.encode("utf-8", "replace") for t in texts]) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
