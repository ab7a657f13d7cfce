"""SimHash near-duplicates: segment popcounts, a grid range join under Manhattan distance, exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected
from .common import drop, materialize, text_blocks

SEGMENTS, BITS = 16, 4
#: Members of a grid cell up to which its pairs are compared one by one.
PAIRS_UP_TO = 128


def shingle_hashes(text: str, size: int = 3) -> list[int]:
    words = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return []
    joined, at, ends = b" ".join(words), 0, []
    for w in words:
        at += len(w)
        ends.append(at)
        at += 1
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, 42)]
    starts = [0, *[e + 1 for e in ends]]
    return [xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[size - 1 :], strict=False)]


def fingerprints(texts: list[str], size: int = 3, chunk: int = 100_000) -> np.ndarray:
    """64-bit SimHash of each text: bit 1 where over half its shingle hashes have it; zero without words."""
    total, counts = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held: list[int] = []
    owners: list[tuple[int, int]] = []

    def flush():
        if held:
            bits = np.unpackbits(np.array(held, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at = 0
            for k, n in owners:
                total[k] += bits[at : at + n].sum(axis=0, dtype=np.int32)
                at += n
            held.clear()
            owners.clear()

    for k, text in enumerate(texts):
        h = shingle_hashes(text, size)
        counts[k] = len(h)
        for a in range(0, len(h), chunk):
            held.extend(part := h[a : a + chunk])
            owners.append((k, len(part)))
            if len(held) >= chunk:
                flush()
    flush()
    return np.packbits(total * 2 > counts[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprint_column(docs: DataFrame, text: str = "text", size: int = 3, digest: bool = False) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long), and the text's SHA-256 if asked for. Null text counts as empty."""

    def run(batches):
        for part, texts in text_blocks(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints(texts, size).view(np.int64)), *part.columns[2:]], names=["doc_id", "fp", *["digest"] * digest])

    column = docs[text].cast("string")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), column.alias("text"), *[text_digest(column).alias("digest")] * digest).mapInArrow(run, "doc_id long, fp long" + ", digest string" * digest)


def text_digest(column):
    return F.sha2(F.coalesce(column, F.lit("")).cast("binary"), 256)


def grid_cells(fps: DataFrame) -> DataFrame:
    """fp, cell: the grid points at Manhattan distance 1 or less from a fingerprint's segment popcounts.

    Flipping a bit moves one popcount by one, so the Manhattan distance of two embeddings never exceeds their
    Hamming distance. Two points at most 2 apart have a grid point within 1 of each: they meet in a cell.
    """
    mask = (1 << BITS) - 1
    counts = [F.bit_count(F.shiftrightunsigned("fp", BITS * i).bitwiseAND(F.lit(mask).cast("long"))).cast("long") for i in range(SEGMENTS)]
    fps = fps.select("fp", *[c.alias(f"c{i}") for i, c in enumerate(counts)])
    home = sum((F.shiftleft(f"c{i}", 3 * i) for i in range(1, SEGMENTS)), F.col("c0"))
    step = lambda i: F.lit(1 << 3 * i).cast("long")
    near = [F.col("home")]
    for i in range(SEGMENTS):
        near += [F.when(F.col(f"c{i}") > 0, F.col("home") - step(i)), F.when(F.col(f"c{i}") < BITS, F.col("home") + step(i))]
    return fps.withColumn("home", home).select("fp", F.explode(F.array_compact(F.array(*near))).alias("cell"))


def _verify(distance: int, most: int):
    """From rows sorted by cell: links (a, b, false) of pairs verified exactly; of larger cells their members (fp, fp, true)."""

    def emit(a, b, hub):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), hub))], names=["a", "b", "hub"])

    def groups(cells, fps):
        first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
        sizes = np.diff(np.append(first, len(cells)))
        large = np.repeat(sizes > most, sizes)
        if large.any():
            yield emit(fps[large], fps[large], True)
            cells, fps = cells[~large], fps[~large]
        for k in range(1, most):
            if len(cells) <= k:
                break
            same = np.flatnonzero(cells[k:] == cells[:-k])
            if not len(same):
                break
            a, b = fps[same], fps[same + k]
            ok = (np.bitwise_count((a ^ b).view(np.uint64)) <= distance) & (a != b)
            if ok.any():
                yield emit(a[ok], b[ok], False)

    def run(batches):
        cells, fps, hub = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            c, f = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if hub is not None:  # the rest of a large cell
                n = int(np.searchsorted(c, hub, "right"))
                yield emit(f[:n], f[:n], True)
                c, f = c[n:], f[n:]
                if not len(c):
                    continue
                hub = None
            cells, fps = np.concatenate([cells, c]), np.concatenate([fps, f])
            if not len(cells):
                continue
            last = int(np.searchsorted(cells, cells[-1], "left"))
            if last:
                yield from groups(cells[:last], fps[:last])
            cells, fps = cells[last:], fps[last:]
            if len(cells) > most:
                yield emit(fps, fps, True)
                hub, cells, fps = int(cells[-1]), cells[:0], fps[:0]
        if len(cells):
            yield from groups(cells, fps)

    return run


def links(fps: DataFrame, distance: int = 2, most: int = PAIRS_UP_TO) -> DataFrame:
    """a, b: links between distinct fingerprints that join exactly the groups which Hamming distances up to 2 join.

    Small cells give their verified pairs. In a cell of over ``most`` fingerprints, each names the 65 bit
    strings within one bit of it; those that share one are at most 2 bits apart, at most 65 can, and linking them to the
    smallest keeps every connection with rows in proportion to the members instead of their pairs.
    """
    if distance != 2:
        raise ValueError("the grid and its large cells are laid out for distance 2")
    cells = grid_cells(fps).select("cell", "fp").repartition("cell").sortWithinPartitions("cell", "fp")
    found = materialize(cells.mapInArrow(_verify(distance, most), "a long, b long, hub boolean"), "links")
    ball = F.array(F.col("a"), *[F.col("a").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")) for k in range(64)])
    balls = found.where("hub").select("a").distinct().select("a", F.explode(ball).alias("b"))  # once a fingerprint, however many large cells it is in
    stars = balls.groupBy("b").agg(F.collect_list("a").alias("members")).where(F.size("members") > 1)
    stars = stars.select(F.array_min("members").alias("b"), F.explode("members").alias("a")).select("a", "b").where("a <> b")
    out = materialize(found.where("not hub").select("a", "b").union(stars).distinct(), "linked")
    drop(found)
    return out


def _placed(rows: DataFrame) -> DataFrame:
    """fp, first (its smallest doc_id), root (one fingerprint for each linked group)."""
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    linked = links(nodes.select("fp"))
    roots = connected(linked)
    placed = materialize(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "placed")
    for t in (nodes, linked):
        drop(t)
    return placed


def near_duplicates(docs: DataFrame, text: str = "text", size: int = 3) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links of at most 2 differing bits.

    Copies share a fingerprint and are one node however many they are. Documents without words have fingerprint
    zero and link like any other. A null doc_id keeps its row and is never a component's id unless no
    other is there. Only doc_id and the text column are read.
    """
    rows = materialize(fingerprint_column(docs, text, size), "fingerprints")
    placed = _placed(rows)
    ids = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(ids, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def first_rows(docs: DataFrame, text: str = "text", size: int = 3) -> DataFrame:
    """doc_id, digest of each linked group's first row: the smallest by doc_id, then by the SHA-256 of its text. Groups are told apart even if rows of several share an id."""
    rows = materialize(fingerprint_column(docs, text, size, digest=True), "fingerprints")
    return rows.join(_placed(rows).select("fp", "root"), "fp").groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("row")).select("row.*")
