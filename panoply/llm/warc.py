"""WARC files and a Merkle audit that compares replicas and goes down only where they differ."""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, materialize, shared_dir, write_file

#: Children of a tree node, and compressed bytes after which a file is closed.
FANOUT, FILE_BYTES = 16, 32_000_000
DATE = "2024-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes) -> bytes:
    """A resource record. Absent id or address: that header is left out."""
    lines = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {url}')}>", f"WARC-Date: {DATE}"]
    lines += [] if url is None else ["WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A")]
    lines += [] if page_id is None else [f"X-Page-Id: {page_id}"]
    lines += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers (lower-cased names) and payload; None if it is no whole record."""
    head, sep, body = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or not lines[0].startswith(b"WARC/1."):
        return None
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    size = headers.get("content-length", "")
    if not size.isdigit() or len(body) < int(size):
        return None
    return headers, body[: int(size)]


def read_records(data: bytes):
    """(offset, length, record bytes or None) of each gzip member; what doesn't decompress is one range up to the next member that does, None."""
    at, n = 0, len(data)
    bad = None
    while at < n:
        d = zlib.decompressobj(31)
        try:
            raw = d.decompress(memoryview(data)[at:]) + d.flush()
            ok = d.eof
        except zlib.error:
            ok = False
        if not ok:
            bad = at if bad is None else bad
            nxt = data.find(b"\x1f\x8b\x08", at + 1)
            at = nxt if nxt >= 0 else n
            continue
        if bad is not None:
            yield bad, at - bad, None
            bad = None
        size = n - at - len(d.unused_data)
        yield at, size, raw
        at += size
    if bad is not None:
        yield bad, n - bad, None


def catalog(data: bytes) -> list[int]:
    """Where a file's records end, for files that were not written here."""
    return [start + length for start, length, _ in read_records(data)]


def write_replicas(pages: DataFrame, damaged=None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes each page as a record, gzip member by member, to replica folders a and b; returns file, a, b (paths) and ends, the catalog of where its records end.

    ``damaged(page_id)``: whether one stored byte of replica b's record is changed, as a drill. Pages are written where they are read,
    without a shuffle. Null html is an empty payload.
    """
    folder = shared_dir(pages.sparkSession, "warc")

    def run(batches):
        part, count, held, ends = TaskContext.get().partitionId(), 0, ([], []), []

        def close():
            name = f"{part:06d}-{count:06d}.warc.gz"
            for side, data in zip("ab", held, strict=True):
                write_file(f"{folder}/{side}/{name}", b"".join(data))
            return pa.RecordBatch.from_pylist([{"file": name, "a": f"{folder}/a/{name}", "b": f"{folder}/b/{name}", "ends": ends}], pa.schema([("file", pa.string()), ("a", pa.string()), ("b", pa.string()), ("ends", pa.list_(pa.int64()))]))

        size = 0
        for batch in batches:
            for page, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                payload = (html or "").encode("utf-8", "replace")
                member = gzip.compress(record(page, url, payload), 6, mtime=0)
                other = member
                if damaged is not None and page is not None and damaged(page):
                    half = len(member) // 2
                    other = member[:half] + bytes([member[half] ^ 1]) + member[half + 1 :]
                held[0].append(member)
                held[1].append(other)
                size += len(member)
                ends.append(size)
                if size >= file_bytes:
                    yield close()
                    count, held, ends, size = count + 1, ([], []), [], 0
        if ends:
            yield close()

    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return materialize(rows.mapInArrow(run, "file string, a string, b string, ends array<long>"), "warc-files")


def tree(digests: list[bytes], fanout: int = FANOUT) -> list[list[bytes]]:
    """Levels from the leaves to one root; a node hashes its children's digests in order, with their count."""
    levels = [digests or [hashlib.sha256(b"").digest()]]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([hashlib.sha256(len(below[i : i + fanout]).to_bytes(2, "big") + b"".join(below[i : i + fanout])).digest() for i in range(0, len(below), fanout)])
    return levels


def hash_trees(files: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """For each file and replica, its tree's nodes: file, side, level (0: records), node, digest, height, and on leaves start, length, page_id, record_bytes, payload_sha256.

    Leaves are the catalog's offset ranges, hashed with their place and stored bytes, so damage that breaks a record's own framing moves no
    other leaf; bytes past the catalog are one more leaf. One file is in memory at a time.
    """
    schema = pa.schema([("file", pa.string()), ("side", pa.string()), ("level", pa.int32()), ("node", pa.int64()), ("digest", pa.binary()), ("height", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("record_bytes", pa.int64()), ("payload_sha256", pa.string())])

    def run(batches):
        for batch in batches:
            for name, side, path, ends in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                store, p = filesystem(path)
                with store.open_input_file(p) as f:
                    data = f.read()
                leaves, rows = [], []
                for k, (start, end) in enumerate(zip([0, *ends], [*ends, len(data)], strict=True)):
                    past = bool(ends) and k == len(ends)
                    if past and start >= end:
                        continue
                    stored = data[start:end]
                    leaves.append(hashlib.sha256(start.to_bytes(8, "big") + end.to_bytes(8, "big") + stored).digest())
                    raw = next((r for _, _, r in read_records(stored)), None) if side == "a" or past else None
                    got = parse_record(raw) if raw is not None else None
                    page = got[0].get("x-page-id") if got else None
                    rows.append((start, end - start, int(page) if page and page.lstrip("-").isdigit() else None, len(raw) if raw is not None else None, hashlib.sha256(got[1]).hexdigest() if got else None))
                levels = tree(leaves, fanout)
                for level, nodes in enumerate(levels):
                    n = len(nodes)
                    extra = list(zip(*rows, strict=True)) if level == 0 and rows else [[None] * n] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([[name] * n, [side] * n, [level] * n, range(n), nodes, [len(levels) - 1] * n, *extra], schema.types, strict=True)], schema=schema)

    spark = files.sparkSession
    sides = files.select("file", F.explode(F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array("a", "b"))).alias("side", "path"), "ends")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return materialize(sides.repartition(parts, "path").mapInArrow(run, "file string, side string, level int, node long, digest binary, height int, start long, length long, page_id long, record_bytes long, payload_sha256 string"), "trees")


def mismatches(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """file, node of the leaves that differ. Roots are compared first; a level below reads only the children of nodes that differ.

    Trees of unequal height or width differ wherever one side has no such node.
    """
    a, b = (nodes.where(F.col("side") == s) for s in "ab")
    top = nodes.agg(F.max("height")).first()[0]
    bad, found = None, None
    for level in range(top if top is not None else 0, -1, -1):
        x, y = (n.where(F.col("level") == level).select("file", "node", "digest", "height") for n in (a, b))
        x, y = (n if bad is None else n.join(bad, (n["file"] == bad["f"]) & (F.floor(n["node"] / fanout) == bad["up"]), "left_semi").union(n.where(F.col("height") == level)) for n in (x, y))
        x, y = x.distinct(), y.distinct()
        y = y.select(F.col("file").alias("file2"), F.col("node").alias("node2"), F.col("digest").alias("digest2"))
        both = x.join(y, (F.col("file") == F.col("file2")) & (F.col("node") == F.col("node2")), "full_outer").where(~F.col("digest").eqNullSafe(F.col("digest2")))
        found = materialize(both.select(F.coalesce("file", "file2").alias("file"), F.coalesce("node", "node2").alias("node")), f"differ-{level}")
        bad = found.select(F.col("file").alias("f"), F.col("node").alias("up"))
    return found


def audit(files: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """One row for each leaf of either replica: file, node, start, length, page_id, record_bytes, payload_sha256, damaged (the replicas differ), side.

    Side is both, or the one replica that has the leaf: bytes past the catalog are a leaf of their own, and damage. What a row says of the
    record is read from replica a if that has the leaf.
    """
    nodes = hash_trees(files, fanout)
    bad = mismatches(nodes, fanout).withColumn("damaged", F.lit(True))
    said = ["start", "length", "page_id", "record_bytes", "payload_sha256"]
    a, b = (nodes.where((F.col("side") == s) & (F.col("level") == 0) & F.col("start").isNotNull()).select("file", "node", F.struct(*said).alias(s)) for s in "ab")
    side = F.when(F.col("a").isNull(), "b").when(F.col("b").isNull(), "a").otherwise("both")
    leaves = a.join(b, ["file", "node"], "full_outer").select("file", "node", F.coalesce("a", "b").alias("leaf"), side.alias("side"))
    return leaves.join(bad, ["file", "node"], "left").select("file", "node", *[f"leaf.{x}" for x in said], F.coalesce("damaged", F.lit(False)).alias("damaged"), "side")
