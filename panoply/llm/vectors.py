"""Vector searches: indexed candidate blocks and query slices as files, met in tasks that stream the slices past one block."""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import delete, drop, filesystem, materialize, shared_dir, write_file

#: Vectors in a candidate block and queries in a slice: what one task holds.
BLOCK, QUERIES = 65_536, 2048
#: Blocks of the first round of a search; later rounds together double what was searched.
FIRST_BLOCKS = 8
#: Vectors from which a block is worth its index, where cores are idle.
SMALL_BLOCK = 16_384


def usable(df: DataFrame, vector: str, nonzero: bool = False) -> DataFrame:
    """Rows whose vector is not null and holds no null, NaN or infinity; with ``nonzero`` some component other than 0 too."""
    ok = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return df.where(ok & F.exists(vector, lambda x: x != 0)) if nonzero else df.where(ok)


def matrix(column: pa.ListArray | pa.ChunkedArray, dtype=None, width: int = 0) -> np.ndarray:
    """Rows of lists as a matrix of their own type or ``dtype``; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    flat = flat if dtype is None else flat.astype(dtype)
    width = max(width, int(sizes.max(initial=0)))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), flat.dtype)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def same_width(*parts: np.ndarray) -> list[np.ndarray]:
    """All with the widest one's columns, zeros at the end."""
    width = max(x.shape[1] for x in parts)
    return [x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in parts]


def save(uri: str, arrays: dict[str, np.ndarray]) -> None:
    held = io.BytesIO()
    np.savez(held, **arrays)
    write_file(uri, held.getvalue())


def load(uri: str) -> dict[str, np.ndarray]:
    store, path = filesystem(uri)
    with store.open_input_file(path) as f:
        with np.load(io.BytesIO(f.read())) as z:
            return dict(z)


def files_of(rows: DataFrame, folder: str, most: int, build: Callable[[np.ndarray, np.ndarray], dict]) -> DataFrame:
    """Writes distinct (id, v) rows to files of up to ``most`` rows, each with what ``build(ids, vectors)`` makes of it: path, rows, ids (distinct)."""
    n = rows.count()
    parts = max(1, -(-n // most), min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // SMALL_BLOCK)))

    def run(batches):
        part, count, held, n = TaskContext.get().partitionId(), 0, [], 0

        def close():
            t = pa.concat_tables(held)
            ids, v = t.column("id").to_numpy(), matrix(t.column("v"))
            uri = f"{folder}/{part:06d}-{count:06d}.npz"
            save(uri, build(ids, v))
            return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([len(ids)], pa.int64()), pa.array([np.unique(ids)], pa.list_(pa.int64()))], names=["path", "rows", "ids"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, most - n)
                held.append(pa.table([piece.column(0), piece.column(1)], names=["id", "v"]))
                n, at = n + piece.num_rows, at + piece.num_rows
                if n == most:
                    yield close()
                    count, held, n = count + 1, [], 0
        if n:
            yield close()

    return rows.dropDuplicates(["id", "v"]).select("id", "v").coalesce(parts).mapInArrow(run, "path string, rows long, ids array<long>")


def search_blocks(candidates: DataFrame, queries: DataFrame, index, search, k: int, score_type: str, block: int = BLOCK, per: int = QUERIES, first: int = FIRST_BLOCKS) -> DataFrame:
    """query_id, rank, vec_id, score from (id, v) and (id, v): the k best, larger scores first, ties to the smaller id.

    Candidates are written once, in blocks of up to ``block`` rows with ``index(ids, vectors)``; queries in slices. A task reads one
    block and streams slices past it: ``search(index, query ids, query vectors, floors)`` gives places of queries, ids and scores,
    at most k ids for each query row, none under its floor. Nothing but ids and scores is shuffled after the writing.

    Blocks come in rounds, each as large as all before it. A round's k best so far are its floors: the k-th score of each
    query, shared with every block of the next round, so a query meets about k rows a round and not k a block.

    An id takes one rank however many rows it has, with the best score of any of them; so does an id among the queries.
    """
    spark = candidates.sparkSession
    kind = pa.int64() if score_type == "long" else pa.float64()
    folder = shared_dir(spark, "search")
    blocks = materialize(files_of(candidates, f"{folder}/blocks", block, index), "blocks")
    slices = materialize(files_of(queries, f"{folder}/queries", per, lambda ids, v: {"ids": ids, "v": v}), "slices")
    # One path for each block and each slice: a file listing, smaller than the tables by the rows that a file holds.
    block_paths, slice_paths = (sorted(r["path"] for r in t.select("path").toLocalIterator()) for t in (blocks, slices))
    best = spark.createDataFrame([], f"query_id long, rank int, vec_id long, score {score_type}")
    done, round_, cores = 0, 0, spark.sparkContext.defaultParallelism
    while done < len(block_paths) and slice_paths:
        some = block_paths[done : done + max(first, done)]
        parts = min(len(slice_paths), max(1, -(-2 * cores // len(some))))  # tasks for each block: enough for every core
        if done:
            write_floors(best.where(F.col("rank") == k), slices, slice_paths, f"{folder}/floors-{round_}", score_type)
        sent = spark.sparkContext.broadcast((some, slice_paths))
        floors, n_slices = f"{folder}/floors-{round_}" if done else None, len(slice_paths)

        def run(batches, sent=sent, parts=parts, floors=floors, n_slices=n_slices):
            some, paths = sent.value
            for batch in batches:
                for task in batch.column(0).to_pylist():
                    own, part = divmod(task, parts)
                    held = load(some[own])
                    for s in range(part * n_slices // parts, (part + 1) * n_slices // parts):
                        q = load(paths[s])
                        at, ids, scores = search(held, q["ids"], q["v"], floor_of(floors, s, q["ids"], kind))
                        yield pa.RecordBatch.from_arrays([pa.array(q["ids"][at], pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, kind)], names=["query_id", "vec_id", "score"])

        n = len(some) * parts
        found = spark.range(0, n, 1, n).mapInArrow(run, f"query_id long, vec_id long, score {score_type}")
        found = found.union(best.select("query_id", "vec_id", "score")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        before, best = best, materialize(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "best")
        drop(before)
        done, round_ = done + len(some), round_ + 1
    for t in (blocks, slices):
        drop(t)
    delete(spark, folder)
    return best


def write_floors(kth: DataFrame, slices: DataFrame, slice_paths: list[str], folder: str, score_type: str) -> None:
    """A file for each slice with the k-th scores of its queries that have one."""
    number = {p: i for i, p in enumerate(slice_paths)}
    sent = kth.sparkSession.sparkContext.broadcast(number)

    def put(key, t):
        ids = t.column("query_id").to_numpy()
        order = np.argsort(ids)
        save(f"{folder}/{sent.value[key[0].as_py()]:06d}.npz", {"ids": ids[order], "scores": t.column("score").to_numpy()[order]})
        return pa.table({"n": pa.array([len(ids)], pa.int64())})

    members = slices.select("path", F.explode("ids").alias("query_id"))
    kth.select("query_id", "score").join(members, "query_id").groupBy("path").applyInArrow(put, "n long").write.format("noop").mode("overwrite").save()


def floor_of(folder: str | None, number: int, ids: np.ndarray, kind: pa.DataType) -> np.ndarray:
    """For each query the score that a row must reach; the type's least where there is none yet."""
    least = np.iinfo(np.int64).min if kind == pa.int64() else -np.inf
    out = np.full(len(ids), least, np.int64 if kind == pa.int64() else np.float64)
    if folder is None:
        return out
    try:
        held = load(f"{folder}/{number:06d}.npz")
    except FileNotFoundError:
        return out
    at = np.minimum(np.searchsorted(held["ids"], ids), len(held["ids"]) - 1)
    hit = held["ids"][at] == ids
    out[hit] = held["scores"][at[hit]]
    return out


def best_rows(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of each id's largest score."""
    order = np.lexsort((-scores, ids))
    return order[np.diff(ids[order], prepend=ids[order[:1]] - 1) != 0]


def best_of_each(owner: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int, repeated: bool = True) -> np.ndarray:
    """Places of each owner's k best, larger scores first, ties to the smaller id; an id counts once, by its best."""
    if repeated:
        order = np.lexsort((-scores, ids, owner))
        first = np.append(True, (np.diff(ids[order]) != 0) | (np.diff(owner[order]) != 0))[: len(order)]
        some = order[first]
    else:
        some = np.arange(len(owner))
    some = some[np.lexsort((ids[some], -scores[some], owner[some]))]
    starts = np.flatnonzero(np.append(True, np.diff(owner[some]) != 0)[: len(some)])
    place = np.arange(len(some)) - np.repeat(starts, np.diff(np.append(starts, len(some))))
    return some[place < k]
