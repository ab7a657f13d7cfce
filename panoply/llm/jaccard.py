"""N-gram Jaccard join by parity sketches: XOR-hashed bit sketches, a pigeonhole join per size band, exact verification.

A token is the 64-bit hash of a run of words. A document's parity sketch has bit b set if an odd number of its tokens hash to
b, so the XOR of two sketches is the sketch of the sets' symmetric difference: their Hamming distance never exceeds that
difference. Sets with Jaccard similarity 0.8 or more differ in a ninth of their summed sizes at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected
from .common import drop, materialize, text_blocks

SHINGLE = 5
#: Similarity of at least NUMERATOR / DENOMINATOR links two sets.
NUMERATOR, DENOMINATOR = 4, 5
#: Distinct sets of one bucket that a task compares with as many others at once.
TILE = 2048
#: Members up to which a bucket's pairs are compared together with those of other buckets.
SMALL = 64
#: Nodes up to which the texts to verify are found by a broadcast list of ids (8 bytes each); more by a sort-merge join.
BROADCAST_UP_TO = 250_000
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P1
    return h ^ (h >> np.uint64(32))


class _Words(dict):
    """64-bit hashes of words, kept for the words met last."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 7)
        return h


def tokens(text: str, words: _Words, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of ``size`` words, of all its words if fewer; none without words."""
    found = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z only, and the six ASCII white-space characters
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, n)
    k = min(n, size)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out * _P1 + h[i : n - k + 1 + i])
    return np.unique(out)


def largest(n: int) -> int:
    """The greatest size that a set linked to one of n tokens can have."""
    return DENOMINATOR * n // NUMERATOR


def reach(a, b):
    """The most tokens in which linked sets of these sizes can differ."""
    return (a + b) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)


def blocks(band: int) -> int:
    """Blocks of the sketches that meet in a band (sizes up to 2**band): more than differences, and some to choose from."""
    top = 1 << band
    return max(64, reach(top, top) + 1, -(-3 * top // 10))


def bands(n: int) -> list[tuple[int, int]]:
    """(band, most differences) of the bands in which a set of n tokens meets its partners: its own, and the next if partners reach it."""
    own = max(0, (n - 1).bit_length())
    high = largest(n)
    found = [(own, reach(n, min(high, 1 << own)))]
    if high > 1 << own:
        found.append((own + 1, reach(n, high)))
    return found


def signatures(hashes: np.ndarray) -> np.ndarray:
    """Keys under which a set meets every set that it may be linked to.

    In a band the sketch is cut into blocks, and a block's word is the XOR of its tokens' hashes: a hash of the block's parity
    bits. Two sets that differ in d tokens have all but d blocks in common. Put into one order, the same for all sets, the
    first d + 1 blocks of either share one of these; the order takes blocks of many tokens first, as chance seldom repeats them.
    """
    out = []
    for band, most in bands(len(hashes)):
        b = blocks(band)
        at = ((hashes >> np.uint64(32)) % np.uint64(b)).astype(np.int64)
        words, held = np.zeros(b, np.uint64), np.bincount(at, minlength=b)
        np.bitwise_xor.at(words, at, hashes)
        key = mix(words + mix(np.arange(b, dtype=np.uint64) * _P1 + np.uint64(band + 1)))
        first = np.lexsort((key, -held))[: most + 1]
        out.append(key[first] & np.uint64(~63 & (1 << 64) - 1) | np.uint64(band))
    return np.concatenate(out)


def sketch_bits(band: int) -> int:
    return max(64, 2 << band)


def sketch(hashes: np.ndarray) -> bytes:
    """The dense parity sketch of the largest band that the set takes part in; its halves XORed are that of the band below."""
    bits = sketch_bits(bands(len(hashes))[-1][0])
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(data: bytes, band: int) -> np.ndarray:
    v = np.frombuffer(data, np.uint64)
    while len(v) > sketch_bits(band) // 64:
        v = v[: len(v) // 2] ^ v[len(v) // 2 :]
    return v


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * (DENOMINATOR + NUMERATOR) >= NUMERATOR * (len(a) + len(b))


ROWS = "doc_id long, n long, node long, proof long, sketch binary, keys array<long>"


def shingle_rows(docs: DataFrame, text: str = "text", size: int = SHINGLE) -> DataFrame:
    """For each document its set's size, the set's 64-bit digest (null if empty), a second digest, its sketch and its keys.

    A task gives sketch and keys of a set once, however many copies it reads, so a set's copies send at most a row for each task and key.
    """

    def run(batches):
        words, seen = _Words(), set()
        for part, texts in text_blocks(batches, 1):
            n, node, proof, sketches, keys = [], [], [], [], []
            for t in texts:
                h = tokens(t, words, size)
                n.append(len(h))
                if not len(h):
                    node.append(None), proof.append(None), sketches.append(None), keys.append(None)
                    continue
                d = xxhash.xxh3_128_digest(h.tobytes())
                a, b = (int.from_bytes(d[i : i + 8], "little", signed=True) for i in (0, 8))
                node.append(a), proof.append(b)
                if a in seen:
                    sketches.append(None), keys.append(None)
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(a)
                sketches.append(sketch(h)), keys.append(signatures(h).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(proof, pa.int64()), pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n", "node", "proof", "sketch", "keys"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, ROWS)


def _neighbours(batches):
    """From (key, n, node) sorted so: buckets of two sets or more, each member with the one before it if their sizes fit."""
    wait = None  # the last row, whose bucket may have more: key, n, node, size and node before it, whether those are of its bucket
    for batch in batches:
        key, n, node = (batch.column(i).to_numpy() for i in range(3))
        if not len(key):
            continue
        k0, n0, node0 = (v[0] for v in wait[:3]) if wait else (~key[0], 0, 0)
        was_n, was = np.append(n0, n[:-1]), np.append(node0, node[:-1])
        same = np.append(k0, key[:-1]) == key
        new = ~(same & (was == node))  # not one more copy
        rows = [v[new] for v in (key, n, node, was_n, was, same)]
        rows = [np.append(x, y) for x, y in zip(wait, rows, strict=True)] if wait else rows
        if len(rows[0]):
            shared = rows[5].copy()
            shared[:-1] |= rows[5][1:]
            shared[-1] = False
            yield _pairs(*[v[shared] for v in rows])
            wait = [v[-1:] for v in rows]
    if wait:
        yield _pairs(*[v[wait[5]] for v in wait])


def _pairs(key, n, node, prev_n, prev, same):
    near = same & (NUMERATOR * n <= DENOMINATOR * prev_n) & (NUMERATOR * prev_n <= DENOMINATOR * n)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(node), pa.array(prev, pa.int64(), mask=~near)], names=["key", "n", "node", "prev"])


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, text: str, size: int) -> DataFrame:
    """The pairs (a, b) of sets that are truly linked, by intersecting their token sets; written.

    The sets come from one text each: the texts of the nodes' first documents are read again, and only their sets are shuffled.
    Both sides of the pairs take them from the same shuffle.
    """
    asked = materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes, "node").select("node", "first"), "asked")
    known, n = asked.select(F.col("first").alias("_first")).distinct(), asked.count()
    known = F.broadcast(known) if n <= BROADCAST_UP_TO else known

    def sets(batches):
        words = _Words()
        for _, texts in text_blocks(batches, 0):
            node, found = [], []
            for t in texts:
                h = tokens(t, words, size)
                if len(h):
                    node.append(int.from_bytes(xxhash.xxh3_128_digest(h.tobytes())[:8], "little", signed=True))
                    found.append(h.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(found, pa.binary())], names=["node", "set"])

    own = docs.select(docs["doc_id"].cast("long").alias("_id"), docs[text].cast("string").alias("_text"))
    texts = own.join(known, F.col("_id").eqNullSafe(F.col("_first")), "left_semi").select("_text")
    found = texts.mapInArrow(sets, "node long, set binary").join(asked.select("node"), "node", "left_semi")
    found = found.groupBy("node").agg(F.first("set").alias("set"))

    def test(batches):
        for batch in batches:
            ok = [i for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)) if linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64))]
            yield pa.RecordBatch.from_arrays([c.take(pa.array(ok, pa.int64())) for c in batch.columns[:2]], names=["a", "b"])

    side = lambda k: found.select(F.col("node").alias(k), F.col("set").alias(f"set_{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b")
    out = materialize(both.mapInArrow(test, "a long, b long"), "linked-sets")
    drop(asked)
    return out


def _compare(forest: bool):
    """From members sorted by (key, tile): pairs of different components, of fitting sizes, whose sketches are near enough.

    With ``forest`` groups of over SMALL members give at most one pair for each two components that they hold.
    """

    def fits(n, comp, slices, i, j, two):
        return (comp[j] != comp[i]) & (NUMERATOR * n[j] <= DENOMINATOR * n[i]) & (NUMERATOR * n[i] <= DENOMINATOR * n[j]) & ((slices[j] != slices[i]) | ~two)

    def near(v, w, n, m):
        return np.bitwise_count(v ^ w).sum(axis=1) <= reach(n, m)

    def given(node, i, j):
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], names=["a", "b"])

    def small(band, slices, node, n, comp, data, group, two):
        """All groups of one batch: rows k apart are compared for all of them at once, a pair of sets once however many groups it shares."""
        found = [(np.zeros(0, int), np.zeros(0, int))]
        for k in range(1, SMALL):
            i = np.flatnonzero(group[k:] == group[:-k])
            if not len(i):
                break
            i = i[fits(n, comp, slices, i, i + k, two[i])]
            found.append((i, i + k))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        _, once = np.unique(np.stack([band[i], np.minimum(node[i], node[j]), np.maximum(node[i], node[j])]), axis=1, return_index=True)
        i, j = i[once], j[once]
        for b in np.unique(band[i]).tolist():
            for at in range(0, len(p := np.flatnonzero(band[i] == b)), 4096):
                x, y = i[p[at : at + 4096]], j[p[at : at + 4096]]
                ok = near(*(np.stack([folded(data[r].as_py(), b) for r in rows.tolist()]) for rows in (x, y)), n[x], n[y])
                yield given(node, x[ok], y[ok])

    def large(band, slices, node, n, comp, data, two):
        v, comp = np.stack([folded(d.as_py(), band) for d in data]), comp.copy()
        for i in range(len(node) - 1):
            j = np.arange(i + 1, len(node))
            j = j[fits(n, comp, slices, i, j, two)]
            j = j[near(v[j], v[i], n[j], n[i])]
            if forest and len(j):
                others, first = np.unique(comp[j], return_index=True)
                j = j[first]
                comp[np.isin(comp, others)] = comp[i]
            if len(j):
                yield given(node, np.full(len(j), i), j)

    def whole(t):
        """t: rows of whole groups."""
        key, tile, slices, node, n, comp = (t.column(k).to_numpy() for k in range(6))
        first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])))
        sizes = np.diff(np.append(first, len(key)))
        group = np.repeat(np.arange(len(first)), sizes)
        two = np.repeat(np.minimum.reduceat(slices, first) != np.maximum.reduceat(slices, first), sizes)
        little = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
        if len(little):
            yield from small(key[little] & 63, *(v[little] for v in (slices, node, n, comp)), t.column(6).take(pa.array(little)), group[little], two[little])
        for k in np.flatnonzero(sizes > SMALL).tolist():
            own = slice(first[k], first[k] + sizes[k])
            yield from large(int(key[first[k]]) & 63, *(v[own] for v in (slices, node, n, comp)), t.column(6).slice(first[k], sizes[k]), two[first[k]])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            key, tile = t.column(0).to_numpy(), t.column(1).to_numpy()
            cut = len(key) - int(np.argmin(((key == key[-1]) & (tile == tile[-1]))[::-1])) if (key != key[-1]).any() or (tile != tile[-1]).any() else 0
            if cut:
                yield from whole(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None and held.num_rows:
            yield from whole(held)

    return run


def _mixed(shared: DataFrame, comps: DataFrame) -> DataFrame:
    """key, n, node, comp, _n, _s: buckets whose sets are in different components, with their size and slices; written.

    Of buckets that hold the same sets, told by their number and two XORs of 64 bits, one stays, of the largest band: they give the same pairs.
    """
    m = shared.select("key", "n", "node").join(comps, "node", "left").select("key", "n", "node", F.coalesce("root", "node").alias("comp"))
    held = [F.count("*").alias("_n"), F.bit_xor("node").alias("_x"), F.bit_xor(F.xxhash64("node")).alias("_y")]
    mixed = m.groupBy("key").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), *held).where("_lo <> _hi")
    mixed = mixed.groupBy("_n", "_x", "_y").agg(F.max_by("key", F.struct(F.col("key").bitwiseAND(63), "key")).alias("key"))
    return materialize(m.join(mixed.select("key", "_n", F.ceil(F.col("_n") / TILE).cast("long").alias("_s")), "key"), "mixed")


def _across(m: DataFrame, sketches: DataFrame, forest: bool) -> tuple[DataFrame, bool]:
    """a, b: co-bucketed sets of different components that the sketches leave open, and whether these are all of them.

    Buckets of over TILE sets are compared in tiles of two of their slices.
    """
    slices = F.pmod(F.xxhash64("node"), F.col("_s"))
    m2 = m.join(sketches, "node").withColumn("slice", slices).withColumn("_t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_s") - 1)))
    m2 = m2.select("key", (F.least("slice", "_t") * F.col("_s") + F.greatest("slice", "_t")).alias("tile"), "slice", "node", "n", "comp", "sketch")
    out = m2.repartition("key", "tile").sortWithinPartitions("key", "tile", "n", "node").mapInArrow(_compare(forest), "a long, b long").distinct()
    out = materialize(out, "open")
    largest_one = m.agg(F.max("_n")).first()[0] or 0
    return out, not forest or largest_one <= SMALL


def components(docs: DataFrame, text: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id: the size of each row's set and the smallest doc_id reachable over links of Jaccard 0.8 or more.

    Copies of a set are one node. A first round verifies, for each node, its likeliest neighbour in the buckets; later rounds
    only look at buckets whose members are still in different components, each among those that the round before left, and the
    last one verifies every pair there that the sketches leave open, so no connection is lost. Null text counts as empty; an empty set is linked with nothing and is its
    own component. A null doc_id keeps its row and names a component only if no other id is there; repeated rows stay. Only
    doc_id and the text column are read. Two sets with the same 64-bit digest are an error, found by a second digest.
    """
    rows = materialize(shingle_rows(docs, text, size), "shingles")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.min("proof").alias("_p"), F.max("proof").alias("_q"))
    clash = F.when(F.col("_p") != F.col("_q"), F.raise_error(F.lit("two sets share a digest")).cast("long"))
    nodes = materialize(nodes.select(F.coalesce(clash, F.col("node")).alias("node"), "first", "copies"), "set-nodes")
    sent = rows.where("sketch is not null").select(F.explode("keys").alias("key"), "node", "n")  # the two random columns side by side compress better
    met = sent.repartition("key").sortWithinPartitions("key", "n", "node").select("key", "n", "node")
    shared = materialize(met.mapInArrow(_neighbours, "key long, n long, node long, prev long"), "shared")
    best = shared.where("prev is not null").groupBy("node", "prev").agg(F.count("*").alias("_c")).groupBy("node").agg(F.max_by("prev", F.struct("_c", "prev")).alias("prev"))
    edges = [verified(docs, nodes, best.select(F.col("node").alias("a"), F.col("prev").alias("b")), text, size)]
    sketches = None
    for forest in (True, False):
        comps = connected(edges[0] if len(edges) == 1 else edges[0].union(edges[1]))
        mixed = _mixed(shared, comps)
        drop(shared)
        if sketches is None:
            known = rows.where("sketch is not null").select("node", "sketch").join(mixed.select("node").distinct(), "node", "left_semi")
            sketches = materialize(known.dropDuplicates(["node"]), "sketches")
        more, every = _across(mixed, sketches, forest)
        shared = mixed
        if not more.isEmpty():
            edges.append(verified(docs, nodes, more, text, size))
        if every or len(edges) < 2:
            break
    links = edges[0]
    for e in edges[1:]:
        links = links.union(e)
    placed = nodes.join(connected(links), "node", "left").select("node", "first", "copies", F.coalesce("root", "node").alias("root"))
    placed = materialize(placed, "placed")
    ids = placed.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("copies").alias("_rows"))
    named = placed.join(ids, "root").select("node", "component_id", "copies")
    out = _attach(rows.select("doc_id", "n", "node"), named)
    for t in (shared, sketches, placed):
        drop(t)
    return out


def _attach(rows: DataFrame, named: DataFrame) -> DataFrame:
    """Each row with its node's component. Nodes of over a thousandth of all rows, a thousand at most, are broadcast; the others are joined by key."""
    named = materialize(named, "named")
    floor = max(1, rows.count() // 1000)
    hot = F.broadcast(named.where(F.col("copies") > floor).select("node", F.col("component_id").alias("_hot"), F.lit(True).alias("_is")))
    rows = rows.join(hot, "node", "left")
    out = lambda r, c: r.select("doc_id", F.col("n").alias("n_shingles"), c.alias("component_id"))
    rest = rows.where("_is is null and node is not null").join(named.where(F.col("copies") <= floor), "node")
    return out(rows.where("node is null"), F.col("doc_id")).union(out(rows.where("_is"), F.col("_hot"))).union(out(rest, F.col("component_id")))
