"""Toxicity: cumulative-link ordinal regression over sparse words, giving an expected severity."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize, text_blocks

#: The bound on what training sees: labelled rows of each class.
TRAIN_ROWS = 2000
#: Grades 0 to 3: clean, then toxic by thirds of the number of tell-tale words in it (those over ten times commoner in toxic rows).
GRADES = 4
WORD = re.compile(r"\w+")


#: A word stands for itself and for its beginnings of these lengths, so inflected forms of a stem share weights.
STEMS = (4, 5, 6, 7)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def features(word: str) -> list[str]:
    return [word, *[f"{word[:n]}*" for n in STEMS if len(word) >= n]]


class OrdinalModel:
    """P(grade >= k) = sigmoid(w.x - t_k), one weight for each feature over ordered thresholds t_1 < t_2 < ...; x counts the document's distinct words that have the feature."""

    def __init__(self, weights: dict[str, float], thresholds: list[float]):
        self.weights, self.thresholds, self.known = weights, thresholds, {}

    def of_word(self, word: str) -> float:
        value = self.known.get(word)
        if value is None:
            if len(self.known) > 300_000:
                self.known.clear()
            value = self.known[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return value

    def value(self, text: str) -> float:
        return sum(map(self.of_word, set(words(text)))) if self.weights else 0.0

    def above(self, value: np.ndarray) -> np.ndarray:
        """P(grade >= k) for each threshold."""
        return 1 / (1 + np.exp(-np.clip(np.asarray(value)[:, None] - np.array(self.thresholds)[None], -60, 60)))


def grades(hits: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Severity for training: 0 for clean rows, 1 to 3 for toxic ones, by thirds of their tell-tale words."""
    if not toxic.any():
        return toxic.copy()
    low, high = np.quantile(hits[toxic == 1], [1 / 3, 2 / 3])
    return np.where(toxic == 1, 1 + (hits > low) + (hits > high), 0)


def fit(rows: list[tuple[list[str], list[int]]], hits: np.ndarray, toxic: np.ndarray, vocabulary: list[str], rounds: int = 400, l1: float = 1e-3) -> OrdinalModel:
    """From each row's features of the vocabulary, with their counts. Proximal gradient steps with momentum on the ordinal log loss; the L1 term
    leaves weights on telling features only, and none is negative, so no word makes a text look cleaner."""
    y = grades(hits, toxic)
    vocab = {f: i for i, f in enumerate(vocabulary)}
    triples = [(r, vocab[f], c) for r, (names, counts) in enumerate(rows) for f, c in zip(names, counts, strict=True)]
    row, col, val = (np.array(x, np.int64) for x in (zip(*triples, strict=True) if triples else ([], [], [])))
    n, k = len(rows), GRADES - 1
    w, first, gap = np.zeros(len(vocab)), 0.0, np.zeros(k - 1)  # t = first, first + exp(gap) ...
    v, m = np.zeros(len(vocab)), np.zeros(k)
    weight = np.where(toxic == 1, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (1 - toxic).sum()))
    for _ in range(rounds):
        t = first + np.append(0, np.cumsum(np.exp(gap)))
        x = np.bincount(row, w[col] * val, n)
        cum = np.column_stack([np.ones(n), 1 / (1 + np.exp(-np.clip(x[:, None] - t, -40, 40))), np.zeros(n)])
        at = np.arange(n)
        p = np.maximum(cum[at, y] - cum[at, y + 1], 1e-9)
        slope = cum * (1 - cum)
        up, down = slope[at, y], slope[at, y + 1]
        d_x = -weight * (up - down) / p
        d_t = np.zeros(k)
        np.add.at(d_t, np.maximum(y - 1, 0), np.where(y > 0, weight * up / p, 0))
        np.add.at(d_t, np.minimum(y, k - 1), np.where(y < k, -weight * down / p, 0))
        g = np.bincount(col, d_x[row] * val, len(vocab))
        v = 0.9 * v - 2.0 * g
        w = w + v
        w = np.maximum(w - 2.0 * l1, 0)
        tail = np.cumsum(d_t[::-1])[::-1]
        m = 0.9 * m - 0.3 * np.append(tail[0], tail[1:] * np.exp(gap))
        first, gap = first + m[0], np.clip(gap + m[1:], -4, 3)
    t = first + np.append(0, np.cumsum(np.exp(gap)))
    return OrdinalModel({a: float(w[i]) for a, i in vocab.items() if w[i]}, t.tolist())


def bags(texts: DataFrame) -> DataFrame:
    """For rows doc_id, y, h, t: the distinct words of t with their counts, and their features with the number of words that have each."""

    def run(batches):
        for part, found in text_blocks(batches, 3):
            held = [Counter(words(t)) for t in found]
            of = [Counter(f for w in bag for f in features(w)) for bag in held]
            lists = [pa.array([list(x.keys() if keys else x.values()) for x in side], pa.list_(kind)) for side in (held, of) for keys, kind in ((True, pa.string()), (False, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *lists], names=["doc_id", "y", "h", "words", "counts", "features", "ns"])

    return texts.mapInArrow(run, "doc_id long, y int, h long, words array<string>, counts array<long>, features array<string>, ns array<long>")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, text: str = "text") -> OrdinalModel:
    """Fits on at most ``rows`` labelled documents of each class, smallest id hash first. Without both classes no word has a weight, and every severity is near 0.

    Words are counted where the texts are; what comes to the driver is, for these rows, the counts of the features that tell the classes apart.
    Each of them is in a fiftieth of the toxic rows (or in three), so there are no more than fifty average toxic texts have. Of several texts of
    one id the least in byte order counts, so reruns agree.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")).withColumn("h", F.xxhash64("doc_id"))
    chosen = known.where("y = 0").orderBy("h", "doc_id").limit(rows).union(known.where("y = 1").orderBy("h", "doc_id").limit(rows))
    some = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("t")).join(F.broadcast(chosen), "doc_id")  # chosen: 2 x rows at most
    held = materialize(bags(some.groupBy("doc_id", "y", "h").agg(F.min("t").alias("t"))), "bags")
    n = {r["y"]: r["count"] for r in held.groupBy("y").count().collect()}
    if len(n) < 2:
        drop(held)
        return OrdinalModel({}, [4.0, 5.0, 6.0])
    toxic, clean = F.sum("y"), F.sum(1 - F.col("y"))
    of = lambda names: held.select("y", F.explode(names).alias("f")).groupBy("f").agg(toxic.alias("d1"), clean.alias("d0"))
    tell = of("words").where((F.col("d1") >= max(2, 0.01 * n[1])) & (F.col("d1") / n[1] > 10 * (F.col("d0") + 0.5) / n[0])).select("f")
    # Features that could only be learnt by heart stay out: those in few toxic rows, or not far commoner there.
    vocab = of("features").where((F.col("d1") >= max(3, 0.02 * n[1])) & (F.col("d1") / n[1] > 4 * (F.col("d0") + 1) / n[0])).select("f")
    count = lambda names, counts, wanted: held.select("doc_id", F.explode(F.arrays_zip(names, counts)).alias("x")).select("doc_id", F.col(f"x.{names}").alias("f"), F.col(f"x.{counts}").alias("n")).join(wanted, "f")
    hits = count("words", "counts", tell).groupBy("doc_id").agg(F.sum("n").alias("hits"))
    sparse = count("features", "ns", vocab).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("f", "n"))).alias("fs"))
    got = held.select("doc_id", "y", "h").join(hits, "doc_id", "left").join(sparse, "doc_id", "left").orderBy("h", "doc_id").select("y", "hits", "fs.f", "fs.n").toArrow().to_pydict()
    names = [r["f"] for r in vocab.orderBy("f").collect()]  # few, as the docstring says
    drop(held)
    return fit([(f or [], c or []) for f, c in zip(got["f"], got["n"], strict=True)], np.array([x or 0 for x in got["hits"]], float), np.array(got["y"], np.int64), names)


def severity(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """doc_id, severity (expected grade, 0 to 3), p_toxic (grade 1 or more), grade (the likeliest), toxic (0 or 1), for every row.

    Null and empty texts have no words and are clean. Whole texts are read; nothing is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training vocabulary

    def run(batches):
        m = sent.value
        for part, texts in text_blocks(batches, 1):
            p = m.above(np.array([m.value(t) for t in texts], float))
            full = np.column_stack([np.ones(len(p)), p, np.zeros(len(p))])
            cols = [part.column(0), pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array((full[:, :-1] - full[:, 1:]).argmax(axis=1).astype(np.int32)), pa.array((p[:, 0] >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "severity", "p_toxic", "grade", "toxic"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, "doc_id long, severity double, p_toxic double, grade int, toxic int")
