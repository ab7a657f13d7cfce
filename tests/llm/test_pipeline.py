"""The pipeline's stages against a plain recomputation of each on what the one before kept; toxicity against its formula and labels kept out of the fit; odd tables."""

import hashlib
import re
from collections import Counter
from math import exp

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import base_scan, brute_fingerprint, labelled, library

from panoply.llm import bpe, mixing, quality, secrets, simhash, tokenfile, toxicity

SF = "/root/testdata/sf0.001"


def plain_score(model, data):
    """The network's sum for each place and filter, one byte at a time; no tables of pairs, no blocks of texts."""
    n, w = max(1, -(-len(data) // quality.CHUNK)), model.p
    b = np.frombuffer(data.ljust(n * quality.CHUNK + quality.WIDTH, b"\0"), np.uint8)
    places = sum(w["filters"][k][b[k : k + n * quality.CHUNK : quality.STEP]].astype(float) for k in range(quality.WIDTH))
    pool = places.reshape(n, -1, quality.FILTERS).max(axis=1)
    hidden = np.tanh(np.concatenate([pool.max(axis=0), pool.min(axis=0), pool.mean(axis=0)]) @ w["w1"] + w["b1"])
    return 1 / (1 + exp(-(hidden @ w["w2"] + w["b2"][0] + model.shift)))


def plain_groups(prints):
    """A number for each fingerprint, equal where links of at most 2 bits lead from one to the other."""
    group = list(range(len(prints)))
    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= 2 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    return group


def plain_queue(rows, places, weights=(3, 1, 2), share=1.5, repeats=2):
    """How often each (source, place) is taken, by one queue of all copies."""
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    words = Counter()
    for r in rows:
        words[r.source] += size(r)
    order = sorted(words, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight, target, left = {s: weights[k % 3] for k, s in enumerate(order)}, {}, share * sum(words.values())
    while free := [s for s in order if s not in target]:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > repeats * words[s]]
        target |= {s: repeats * words[s] for s in full} if full else {s: level * weight[s] for s in free}
        left -= sum(target[s] for s in full)
        if not full:
            break
    queue = []
    for s in order:
        run = 0
        for place, n in sorted((p, size(r)) for p, r in zip(places, rows, strict=True) if r.source == s and size(r)):
            run += n
            queue += [((run + k * words[s]) / target[s], k, place, s, n) for k in range(repeats)]
    left, taken = share * sum(words.values()), Counter()
    for _, _, place, s, n in sorted(queue, key=lambda x: x[:3]):
        left -= n
        if left < 0:
            break
        taken[s, place] += 1
    return taken


def test_stages_equal_a_plain_recomputation(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        kept[name] = docs, (docs := spark.read.parquet(f"{tmp_path}/{k}"))

    before, after = kept["quality"]
    model = quality.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    score = {r.doc_id: plain_score(model, (r.text or "").encode()) for r in before.collect()}
    assert all(abs(r.score - score[r.doc_id]) < 1e-4 for r in quality.classify(before, model).collect())
    good = {i for i, s in score.items() if s >= quality.THRESHOLD}
    assert 0 < len(good) < len(score) and {r.doc_id for r in after.collect()} == good

    before, after = (t.collect() for t in kept["near_duplicates"])
    first = {}
    for g, r in zip(plain_groups([brute_fingerprint(r.text) for r in before]), before, strict=True):
        first[g] = min(first.get(g, r), r, key=lambda r: (r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert len(first) < len(before) and sorted(after) == sorted(first.values())

    before, after = ({r.doc_id: r for r in t.collect()} for t in kept["secrets"])
    assert before.keys() == after.keys() and any(before[i] != after[i] for i in before)
    for i, r in before.items():
        text, merged = r.text, []
        for _, a, b in sorted(secrets.scan_text(r.text or "")[1], key=lambda s: s[1:]):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        for a, b in reversed(merged):
            text = text[:a] + "[secret]" + text[b:]
        assert after[i].text == text and base_scan(text or "") == [] and after[i].n_chars == (r.n_chars if text is None else len(text))

    before, after = kept["mix"]
    rows = before.withColumn("_h", F.xxhash64(F.lit(7), "doc_id", "text")).collect()
    places = [(r["_h"], r.doc_id) for r in rows]
    assert Counter((r.source, r.doc_id) for r in after.collect()) == {(s, i): n for (s, (_, i)), n in plain_queue(rows, places).items()}

    before, after = (t.collect() for t in kept["encode"])
    _, reference = library()
    encoded = [(r.doc_id, reference.encode_ordinary(r.text or "")) for r in before]
    want = sorted((i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(reference.decode_bytes(x)).hexdigest()) for i, x in encoded)
    digests = lambda rows: sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows)
    assert digests(after) == want == digests(pipeline.run(spark, SF).collect())


def test_toxicity_on_labels_kept_out_and_by_its_formula(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    out = F.crc32(F.concat(F.lit("x"), F.col("doc_id").cast("string")).cast("binary")) % 4 == 1
    model = toxicity.train(docs, labels.where(~out))
    held = labels.where(out).select("doc_id", F.col("toxic").alias("y")).join(docs, "doc_id")
    got = toxicity.severity(docs, model).join(held, "doc_id").collect()
    found = lambda y: np.mean([r.toxic for r in got if r.y == y])
    assert found(1) >= 0.85 and found(0) <= 0.03
    for r in got[::5]:
        x = 0.0
        for w in set(re.findall(r"\w+", (r.text or "").lower())):
            x += model.weights.get(w, 0) + sum(model.weights.get(w[:n] + "*", 0) for n in (4, 5, 6, 7) if len(w) >= n)
        p = [1 / (1 + exp(-(x - t))) for t in model.thresholds]
        assert abs(r.severity - sum(p)) < 1e-9 and abs(r.p_toxic - p[0]) < 1e-9 and r.toxic == (p[0] >= 0.5)


#: Names that the operators use for columns of their own.
CLASH = ["fp", "digest", "component_id", "a", "b", "c", "hub", "root", "score", "predicted", "held_out", "h", "y", "t", "q", "severity", "grade", "toxic", "words", "counts", "n_tokens", "ids", "start", "part", "size", "target", "taken", "finish", "_h", "_id", "_b", "_run", "spans"]


def test_long_texts_repeats_and_clashing_columns(spark):
    long = "word and more of it. " * 60_000
    texts = [None, "", long, long, long + "x", "a b c", "a b c", "vile " * 50_000, "\n"]
    data = [(i, t, "en", f"s{i % 2}") for i, t in enumerate(texts)] + [(5, "a b c", "en", "s1")] * 3 + [(None, "d e", "en", None), (None, None, "en", None)]
    data += [(i + 100, t, "en", "s0") for i, t, _ in labelled(60)]
    plain = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i + 100, q, 1 - q) for i, _, q in labelled(60)] + [(2, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
    wide = plain.withColumns({c: F.lit("7") for c in CLASH})
    for job in (
        simhash.near_duplicates,
        lambda d: toxicity.severity(d, toxicity.train(d, labels)),
        lambda d: quality.classify(d, quality.train(d, labels)),
        mixing.mix,
        secrets.scan,
        bpe.encode_documents,
        lambda d: tokenfile.read_tokens(spark, tokenfile.write_tokens(d)),
    ):
        got = sorted(map(str, job(plain).collect()))
        assert len(got) == len(data) and sorted(map(str, job(wide).collect())) == got
