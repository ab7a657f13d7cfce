"""Pose text files of any size, read by Spark's own line splits.

A record is two lines, and the second may be blank or look like anything, so where a split begins can't be told from its lines alone.
But reading has only two states (a record's head is due, or its points are), so a first pass notes for each split what it would do
in either. Put in the order of the file, these notes give every split the state it begins in; a second pass then parses all of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD, POINTS = 0, 1


def lines(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    """value, path, split (its first byte), in the order of the file inside each split."""
    reader = spark.read.option("recursiveFileLookup", "true")
    text = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    return text.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"))


def _splits(batches) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """(path, split) and some of its lines, in order; a split may come in several turns."""
    for batch in batches:
        value, path, split = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
        if not value:
            continue
        turns = pc.or_(pc.not_equal(split[1:], split[:-1]), pc.not_equal(path[1:], path[:-1]))
        ends = [*(np.flatnonzero(turns.to_numpy(zero_copy_only=False)) + 1).tolist(), len(value)]
        for at, end in zip([0, *ends], ends, strict=False):
            yield (path[at].as_py(), split[at].as_py()), value[at:end]


def empty(line: str) -> bool:
    """Passed over where a head is due."""
    return not (s := line.strip()) or s.startswith("#")


def _note(batches):
    """path, split, lines, and for either state at its start: the state at its end, the heads in it and the last of them."""
    held, key = None, None

    def row():
        (n, states) = held
        return pa.RecordBatch.from_pylist([{"path": key[0], "split": key[1], "lines": n, "ends": [s[0] for s in states], "heads": [s[1] for s in states], "last": [s[2] for s in states]}], schema=pa.schema(NOTE))

    for own, values in _splits(batches):
        if own != key:
            if key:
                yield row()
            key, held = own, [0, ((HEAD, 0, None), (POINTS, 0, None))]
        held[0] += len(values)
        (one, n, last), (two, m, latest) = held[1]
        for line in values:
            passed = (one == HEAD or two == HEAD) and empty(line)
            if one == POINTS:
                one = HEAD
            elif not passed:
                one, n, last = POINTS, n + 1, line
            if two == POINTS:
                two = HEAD
            elif not passed:
                two, m, latest = POINTS, m + 1, line
        held[1] = (one, n, last), (two, m, latest)
    if key:
        yield row()


NOTE = [("path", pa.string()), ("split", pa.int64()), ("lines", pa.int64()), ("ends", pa.list_(pa.int32())), ("heads", pa.list_(pa.int64())), ("last", pa.list_(pa.string()))]


def starts(spark: SparkSession, text: DataFrame) -> dict[tuple[str, int], tuple[int, str | None, int]]:
    """For each split: the state it begins in, the head whose points are due, and the lines before it. One small row a split comes to the driver."""
    notes = text.mapInArrow(_note, "path string, split long, lines long, ends array<int>, heads array<long>, last array<string>")
    plain = lambda p: re.sub("^file:/+", "/", p)  # noqa: E731  both ways of writing a local file's URI
    out, heads = {}, dict.fromkeys(map(plain, text.inputFiles()), 0)
    path, state, head, before = None, HEAD, None, 0
    for r in sorted(notes.collect(), key=lambda r: (r["path"], r["split"])):  # an orderBy would read the text twice
        if r["path"] != path:
            path, state, head, before = r["path"], HEAD, None, 0
        out[path, r["split"]] = state, head, before
        heads[plain(path)] = heads.get(plain(path), 0) + r["heads"][state]
        head, state, before = r["last"][state], r["ends"][state], before + r["lines"]
        head = head if state == POINTS else None
    if bare := sorted(p for p, n in heads.items() if not n):
        raise ValueError(f"no poses in {bare[0]}")
    return out


def head_fields(line: str, number: int) -> tuple[int, list[float], str]:
    """image id, quaternion and translation, image name."""
    fields = line.split(maxsplit=9)
    if len(fields) != 10:
        raise ValueError(f"line {number}: a pose needs ten fields")
    try:
        int(fields[8])
        return int(fields[0]), [float(x) for x in fields[1:8]], fields[9].strip()
    except ValueError as e:
        raise ValueError(f"line {number}: {e}") from e


def records(spark: SparkSession, path: str, glob: str | None, parse, schema: str) -> DataFrame:
    """parse(path, line number, head, points) -> rows as tuples, for each head (points None) and each points line (with its head)."""
    text = lines(spark, path, glob)
    begins = starts(spark, text)
    kinds = spark.createDataFrame([], schema).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, key = to_arrow_schema(kinds), None
        for own, values in _splits(batches):
            if own != key:
                key = own
                if own not in begins:
                    raise ValueError(f"{own[0]} changed while it was read")
                state, head, number = begins[own]
            out = []
            for line in values:
                number += 1
                if state == POINTS:
                    out += parse(own[0], number, head, line)
                    state = HEAD
                elif not empty(line):
                    state, head = POINTS, line.strip()
                    out += parse(own[0], number, head, None)
            columns = zip(*out, strict=True) if out else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return text.mapInArrow(run, schema)


def poses(spark: SparkSession, path: str, glob: str = "images.txt") -> DataFrame:
    """path, image_id, image_name, q, t of every pose."""

    def parse(p, number, head, points):
        if points is not None:
            return []
        image, numbers, name = head_fields(head, number)
        return [(p, image, name, numbers[:4], numbers[4:])]

    return records(spark, path, glob, parse, "path string, image_id long, image_name string, q array<double>, t array<double>")


def observations(spark: SparkSession, path: str, glob: str = "images.txt") -> DataFrame:
    """path, image_id, image_name, ordinal, u, v, point3d_id; unmatched ones have -1."""

    def parse(p, number, head, points):
        image, _, name = head_fields(head, number if points is None else number - 1)
        x = [] if points is None else points.split()
        if len(x) % 3:
            raise ValueError(f"line {number}: observations come in threes")
        return [(p, image, name, k // 3, float(x[k]), float(x[k + 1]), int(x[k + 2])) for k in range(0, len(x), 3)]

    return records(spark, path, glob, parse, "path string, image_id long, image_name string, ordinal int, u double, v double, point3d_id long")
