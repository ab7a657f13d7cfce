"""The Jaccard join and the filter audit against brute force; nulls, empties, repeats, clashing columns."""

import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panoply.llm import audit, jaccard
from panoply.llm.common import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, node string, n int, keys int, key string, prev int, source string"


def frame(spark, texts):
    """(doc_id, text) with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, 2, "k", 3, "s") for i, t in texts], DOCS)


def sets(text, size=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def groups(docs):
    """(doc_id, size, smallest id reachable) of each row, every pair compared."""
    held = [sets(t) for _, t in docs]
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(held):
        for j, b in enumerate(held[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return Counter((d, len(held[i]), least.get(top(i)) if held[i] else d) for i, (d, _) in enumerate(docs))


def found(spark, docs, parts=5):
    return Counter(map(tuple, jaccard.components(frame(spark, docs).repartition(parts)).collect()))


@pytest.fixture(scope="module")
def corpus():
    """Families of texts around the threshold, of many sizes, half of them with a passage that all of these share."""
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(2000)]
    shared, texts = [rnd.choice(words) for _ in range(120)], []
    for n in (4, 5, 6, 8, 9, 12, 16, 17, 33, 64, 70, 130, 300, 700):
        for family in range(3):
            base = [rnd.choice(words) for _ in range(n)]
            base = base[: n // 2] + shared[: n // 2] if family else base
            for _ in range(5):
                t = list(base)
                for _ in range(rnd.randint(0, max(1, n // 40))):
                    t.insert(rnd.randrange(len(t)), rnd.choice(words)) if rnd.random() < 0.5 else t.__setitem__(rnd.randrange(len(t)), rnd.choice(words))
                texts.append(" ".join(t))
    base = [rnd.choice(words) for _ in range(200)]
    for _ in range(90):  # a large group of near copies
        t = list(base)
        for _ in range(rnd.randint(0, 5)):
            t[rnd.randrange(200)] = rnd.choice(words)
        texts.append(" ".join(t))
    docs = list(enumerate([*texts, *[texts[-1].upper()] * 25]))
    docs += [(900, None), (901, ""), (902, " \t\n"), (903, "A"), (904, "a"), (None, "a"), (None, "alone by itself"), (905, "\x0ba\x0c b\r"), (905, "A B"), (905, "other text é É")]
    return docs


def test_components_equal_brute_force(spark, corpus):
    assert found(spark, corpus) == groups(corpus)


def test_components_with_tiles_and_large_buckets(spark, corpus, monkeypatch):
    """Buckets cut into tiles, compared one by one, and texts found without a broadcast list."""
    monkeypatch.setattr(jaccard, "TILE", 6)
    monkeypatch.setattr(jaccard, "BROADCAST_UP_TO", 0)
    docs = corpus[-160:]
    assert found(spark, docs) == groups(docs)


def test_buckets_of_the_same_sets_are_compared_once(spark, corpus, monkeypatch):
    """Of buckets with the same members one is kept, a later round takes only those that the round before left, and token sets are not written."""
    buckets, tags = [], []
    write = jaccard.materialize

    def spy(df, tag):
        out = write(df, tag)
        tags.append(tag)
        if tag == "mixed":
            held = {}
            for r in out.select("key", "node").collect():
                held.setdefault(r.key, []).append(r.node)
            buckets.append({k: frozenset(v) for k, v in held.items()})
        return out

    monkeypatch.setattr(jaccard, "materialize", spy)
    assert found(spark, corpus) == groups(corpus)
    assert buckets[0] and all(len(set(b.values())) == len(b) for b in buckets)
    assert all(later.items() <= earlier.items() for earlier, later in zip(buckets, buckets[1:]))
    assert "sets" not in tags


def test_open_pairs_of_large_groups(corpus):
    """In one task: groups over SMALL give every pair that the sketches leave open, or one for two components."""
    import pyarrow as pa

    near = [t for _, t in corpus[-125:-35]]
    h = [jaccard.tokens(t, jaccard._Words()) for t in near]
    n = len(h)
    band = max(b for x in h for b, _ in jaccard.bands(len(x)))
    h = [x for x in h if band in dict(jaccard.bands(len(x)))]
    n = len(h)
    cols = [np.full(n, band), np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n), np.array([len(x) for x in h]), np.arange(n)]
    batch = pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array([jaccard.sketch(x) for x in h])], names=list("abcdefg"))
    pairs = {forest: {(a, b) for out in jaccard._compare(forest)([batch]) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True)} for forest in (True, False)}
    true = {(i, j) for j in range(n) for i in range(j) if jaccard.linked(h[i], h[j])}
    assert n > jaccard.SMALL and true <= pairs[False] and len(pairs[True]) < n and pairs[True] <= pairs[False]


def test_components_of_a_table_and_of_none(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    assert found(spark, docs) == groups(docs)
    assert jaccard.components(frame(spark, [])).count() == 0
    assert found(spark, [(1, None), (2, "")]) == Counter([(1, 0, 1), (2, 0, 2)])


def test_signatures_meet_and_sketches_bound():
    """Linked sets always share a key, and their sketches differ in no more bits than the sets in tokens."""
    rng = np.random.default_rng(4)
    for n in [*range(4, 40), 64, 65, 80, 128, 200, 257, 1000, 5000]:
        for _ in range(8):
            both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            cut = rng.integers(0, n // 9 + 1)
            a, b = np.unique(both[: n - cut]), np.unique(np.append(both[cut:], rng.integers(0, 1 << 63, rng.integers(0, 2), dtype=np.uint64)))
            if not jaccard.linked(a, b):
                continue
            shared = set(jaccard.signatures(a).tolist()) & set(jaccard.signatures(b).tolist())
            assert shared
            for band in {k & 63 for k in shared}:
                v, w = (jaccard.folded(jaccard.sketch(x), band) for x in (a, b))
                assert np.bitwise_count(v ^ w).sum() <= len(np.setxor1d(a, b)) <= jaccard.reach(len(a), len(b))


# The filter audit


def fails(docs):
    """Each row's failed filters, by the definition."""
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    out = []
    for d, t, _ in docs:
        t = t or ""
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", t) if x]
        own = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": d is not None and first[t] < d}
        out.append({f for f, bad in own.items() if bad})
    return out


def brute_audit(docs, labels):
    good, toxic = ({d for d, *v in labels if d is not None and v[k] == 1} for k in (0, 1))
    rows, out = list(zip(docs, fails(docs), strict=True)), []
    for part in sorted({s or "" for _, _, s in docs}):
        own = [(d, f) for (d, _, s), f in rows if (s or "") == part]
        removed = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, kept = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                removed[f] += len(gone)
                out.append([part, "".join(order), step, len(kept), len(gone), sum(f in x for _, x in own) - len(gone), sum(x == {f} for _, x in own), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), f])
                left = kept
        out = [[*x[:-1], removed[x[-1]]] if isinstance(x[-1], str) else x for x in out]
    return sorted(map(tuple, out))


def test_audit_equals_brute_force(spark):
    rnd = random.Random(5)
    plain = " ".join(f"word{i}" for i in range(210))
    texts = [None, "", plain, plain, "a " * 300, plain + " #", plain.upper(), plain.upper() + "&", "short $", " " * 50, "É" * 300, "x" * 60_000, " ".join(["A"] * 4 + ["b"] * 196), plain]
    docs = [(rnd.choice([None, *range(12)]), t, rnd.choice(["p", "q", None, ""])) for t in texts * 3]
    labels = [(1, 1, 0), (1, 0, 1), (2, 0, 1), (3, None, None), (None, 1, 1), (5, 1, 1), (77, 1, 1)]
    df = spark.createDataFrame([(*d, 1, "m", 2, 3) for d in docs], "doc_id long, text string, source string, mask int, part string, cell int, n int").repartition(4)
    lab = spark.createDataFrame([(*x, 9) for x in labels], "doc_id long, quality int, toxic int, mask int")
    got = audit.interactions(df, lab)
    assert [t for _, t in got.dtypes] == ["string", "string", "int", *["bigint"] * 7]
    assert sorted(map(tuple, got.collect())) == brute_audit(docs, labels)


def test_audit_of_many_parts_and_of_none(spark):
    docs = [(i, f"text {i % 40}", f"part {i % 700}") for i in range(1400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = audit.interactions(df, lab)
    assert got.count() == 700 * 600
    totals = got.where("filter_order = 'ABCDE'").groupBy("step").agg(F.sum("removed").alias("n")).orderBy("step").collect()
    assert [r.n for r in totals] == [1400, 0, 0, 0, 0] and got.where("filter_order = 'EABCD' and step = 1").agg(F.sum("removed")).first()[0] == 1360
    assert audit.interactions(df.limit(0), lab).count() == 0


def test_first_failure_table():
    assert audit.FIRST.shape == (32, 120) and (audit.FIRST[0] == 5).all()
    assert audit.FIRST[0b00101, audit.ORDERS.index("BDCAE")] == 2 and audit.FIRST[0b10000, audit.ORDERS.index("EDCBA")] == 0


def test_searches_and_audits_with_clashing_columns(spark):
    """Columns called like the operators' own change nothing."""
    from panoply.llm import forest, topk, warc

    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in np.round(rng.standard_normal(5), 3)]) for i in range(150)]
    plain = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    extra = plain.selectExpr("*", "'p' AS path", "1 AS rows", "2 AS ids", "3 AS id", "4 AS v", "5 AS rank", "6 AS score", "7 AS query_id")
    for search in (lambda t: topk.top_k(t, block=60), lambda t: forest.nearest(t, block=60)):
        assert sorted(map(tuple, search(plain).collect())) == sorted(map(tuple, search(extra).collect()))
    pages = spark.createDataFrame([(i, f"http://e.org/{i}", "x" * i) for i in range(40)], "page_id long, url string, html string")
    odd = pages.selectExpr("*", "'a' AS replica", "1 AS offset", "2 AS size", "3 AS level", "4 AS leaf", "5 AS file", "6 AS path", "7 AS digest")
    found = [sorted(map(str, warc.audit(warc.write_replicas(p, damaged=lambda page: page == 7)).collect())) for p in (pages, odd)]
    assert found[0] == found[1] and len(found[0]) == 40


def test_operators_of_empty_tables(spark, tmp_path):
    from panoply.llm import forest, quality, secrets, simhash, tokenfile, topk

    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    some = spark.createDataFrame([(i, "good words here " * 9 if i % 2 else "b@d " * 20) for i in range(40)], "doc_id long, text string")
    model = quality.train(some, spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int"))
    assert secrets.scan(docs).count() == 0 and simhash.near_duplicates(docs).count() == 0 and quality.classify(docs, model).count() == 0
    assert tokenfile.read_tokens(spark, tokenfile.write_tokens(docs.select("doc_id", "text"))).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(vectors).count() == 0 and forest.nearest(vectors).count() == 0
