"""Token-id files of directly addressable codes: ids cut into chunk levels with continuation bitmaps and rank directories."""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filesystem, materialize, shared_dir, text_blocks, write_file
from .pieces import LINE, START, Memory, joinable, piece

MAGIC = b"DACTOK01"
#: Bits between two entries of a rank directory.
STRIDE = 512
#: A file is closed once it holds so many tokens; a document never spans files.
TOKENS_PER_FILE = 4_000_000
#: Marks after a word, and words beyond ASCII, whose bounds as pre-tokens need no pattern.
MARKS = r"""!"#$%&()*+,-./:;<=>?@[\]^_`{|}~"""
LATIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
BEFORE_MARKS = f"(?s)^.*[^{re.escape(MARKS)}]"


class DirectCodes:
    """Unsigned ints as levels of 8-bit chunks, lowest first.

    Level k holds the k-th chunk of every value that has one. A level's bitmap marks the values that go on, and its
    rank directory counts the marks before every STRIDE-th value, so value i's place in the next level is one
    lookup and a popcount of less than STRIDE bits away: no block is decoded to reach it.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]]):
        self.levels = levels

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @classmethod
    def build(cls, values: np.ndarray) -> DirectCodes:
        levels, rest = [], np.ascontiguousarray(values, dtype=np.uint32)
        while True:
            chunk, high = rest.astype(np.uint8), rest >> 8
            more = high != 0
            if not more.any():
                levels.append((chunk, None, None))
                return cls(levels)
            bits = np.packbits(more, bitorder="little")
            counts = np.add.reduceat(more, np.arange(0, len(more), STRIDE), dtype=np.uint64)
            levels.append((chunk, bits, np.append(np.uint64(0), np.cumsum(counts)[:-1]).astype(np.uint64)))
            rest = high[more]

    @staticmethod
    def _rank(bits: np.ndarray, directory: np.ndarray, i: int) -> int:
        """Marks before value i."""
        block, low = divmod(i, STRIDE)
        start = block * (STRIDE // 8)
        whole = bits[start : start + low // 8]
        count = int(directory[block]) + int(np.bitwise_count(whole).sum())
        return count + ((int(bits[start + low // 8]) & ((1 << low % 8) - 1)).bit_count() if low % 8 else 0)

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (chunk, bits, directory) in enumerate(self.levels):
            value |= int(chunk[i]) << 8 * k
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(bits, directory, i)
        return value

    def range(self, start: int, end: int) -> np.ndarray:
        """Values start to end, exclusive."""
        chunk, bits, directory = self.levels[0]
        out = chunk[start:end].astype(np.uint32)
        at = None  # the places in out that the present level's slice belongs to
        for k in range(1, len(self.levels)):
            if start == end:
                break
            first = start >> 3
            marks = np.unpackbits(bits[first : (end + 7) >> 3], bitorder="little")[start - 8 * first : end - 8 * first].view(bool)
            lo = self._rank(bits, directory, start)
            start, end = lo, lo + int(np.count_nonzero(marks))
            at = np.flatnonzero(marks) if at is None else at[marks]
            chunk, bits, directory = self.levels[k]
            out[at] |= chunk[start:end].astype(np.uint32) << np.uint32(8 * k)
        return out

    def dump(self) -> tuple[list, bytes]:
        shape, parts = [], []
        for chunk, bits, directory in self.levels:
            shape.append([len(chunk), 0 if bits is None else len(bits), 0 if directory is None else len(directory)])
            parts += [chunk.tobytes()] if bits is None else [chunk.tobytes(), bits.tobytes(), directory.astype("<u8").tobytes()]
        return shape, b"".join(parts)

    @classmethod
    def parse(cls, shape: list, data: memoryview) -> DirectCodes:
        levels, at = [], 0
        for chunks, bits, directory in shape:
            chunk = np.frombuffer(data, np.uint8, chunks, at)
            at += chunks
            if bits:
                b = np.frombuffer(data, np.uint8, bits, at)
                d = np.frombuffer(data, "<u8", directory, at + bits)
                at += bits + 8 * directory
                levels.append((chunk, b, d))
            else:
                levels.append((chunk, None, None))
        return cls(levels)


def pack(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """One file: magic, header length, JSON header, document ids and their presence, token ends, levels."""
    ends = np.cumsum([len(x) for x in ids], dtype="<i8") if ids else np.zeros(0, "<i8")
    codes = DirectCodes.build(np.concatenate(ids) if ids else np.zeros(0, np.uint32))
    shape, body = codes.dump()
    header = json.dumps({"docs": len(doc_ids), "tokens": int(ends[-1]) if len(ends) else 0, "levels": shape}).encode()
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, numbers.tobytes(), known.tobytes(), ends.tobytes(), body])


class TokenFile:
    """A packed file in memory: documents in order, and any token by its place."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        size = struct.unpack_from("<I", data, 8)[0]
        header = json.loads(data[12 : 12 + size])
        n, at = header["docs"], 12 + size
        numbers, known = np.frombuffer(data, "<i8", n, at), np.frombuffer(data, np.uint8, n, at + 8 * n)
        self.doc_ids = [d if k else None for d, k in zip(numbers.tolist(), known.tolist(), strict=True)]
        self.ends = np.frombuffer(data, "<i8", n, at + 9 * n)
        self.codes = DirectCodes.parse(header["levels"], memoryview(data)[at + 17 * n :])

    def document(self, k: int) -> np.ndarray:
        return self.codes.range(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def open_file(uri: str) -> TokenFile:
    store, path = filesystem(uri)
    with store.open_input_file(path) as f:
        return TokenFile(f.read())


class StoredTokens:
    """Any token of a file where it lies, by its place in the file or in a document.

    Beside the header, read once, a token costs for each of its levels one chunk byte, one byte of marks, one directory entry and the
    marks between that entry and the value: at most STRIDE / 8 + 10 bytes, however large the file is.
    """

    def __init__(self, uri: str):
        store, path = filesystem(uri)
        self.file = store.open_input_file(path)
        if self._read(0, 8) != MAGIC:
            raise ValueError("not a token file")
        size = struct.unpack("<I", self._read(8, 4))[0]
        header = json.loads(self._read(12, size))
        self.docs, self.tokens, at = header["docs"], header["tokens"], 12 + size
        self.ends_at = at + 9 * self.docs
        at += 17 * self.docs
        self.levels = []  # where a level's chunks, marks and directory start; no marks on the last one
        for chunks, bits, directory in header["levels"]:
            self.levels.append((at, at + chunks if bits else None, at + chunks + bits))
            at += chunks + bits + 8 * directory

    def _read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def __len__(self) -> int:
        return self.tokens

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value = 0
        for k, (chunks, marks, directory) in enumerate(self.levels):
            value |= self._read(chunks + i, 1)[0] << 8 * k
            if marks is None:
                break
            block = i // STRIDE
            before = self._read(marks + block * (STRIDE // 8), i // 8 - block * (STRIDE // 8) + 1)  # up to the byte with value i's mark
            if not before[-1] >> (i & 7) & 1:
                break
            rank = struct.unpack("<Q", self._read(directory + 8 * block, 8))[0]
            i = rank + (int.from_bytes(before, "little") & ((1 << i - block * STRIDE) - 1)).bit_count()
        return value

    def of_document(self, k: int, i: int) -> int:
        """Token i of the k-th document of the file."""
        if not 0 <= k < self.docs:
            raise IndexError(k)
        start, end = struct.unpack("<2q", self._read(self.ends_at + 8 * (k - 1), 16)) if k else (0, struct.unpack("<q", self._read(self.ends_at, 8))[0])
        if not 0 <= i < end - start:
            raise IndexError(i)
        return self[start + i]

    def close(self) -> None:
        self.file.close()


def token(uri: str, i: int) -> int:
    """Token i of a stored file."""
    held = StoredTokens(uri)
    try:
        return held[i]
    finally:
        held.close()


@functools.lru_cache(maxsize=2)
def _encoder(path: str, added_tokens: bool = False) -> Memory:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # pieces are cut without regard to added tokens; texts that hold one go to an untouched tokenizer
    vocabulary = t.get_vocab()
    size = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each token: the byte-level alphabet has a character for each
    for token, i in vocabulary.items():
        size[i] = len(token)
    level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    spelled = lambda x: "".join(part for part, _ in level.pre_tokenize_str(x))
    letters, blank = {c: spelled(chr(c)) for c in range(0xC0, 0x100)}, spelled(" ")
    # The same model behind a split at newlines, for pre-tokens that are known and spelled already.
    words = Tokenizer(t.model)
    words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
    plain = isinstance(t.pre_tokenizer, pre_tokenizers.ByteLevel) and not t.pre_tokenizer.add_prefix_space and t.pre_tokenizer.use_regex and t.normalizer is None and t.post_processor is None

    def in_rows(encoder, keys: list[str], sizes, row) -> tuple[dict[str, bytes], list[str]]:
        """Ids of the keys, many in one text: the tokens' lengths tell them apart. And the keys of rows where they don't."""
        out, failed = {}, []
        rows = [keys[i : i + 500] for i in range(0, len(keys), 500)]
        for r, e in zip(rows, encoder.encode_batch_fast([row(r) for r in rows], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.cumsum(sizes(r))
            token_ends = np.cumsum(size[ids])
            at = np.searchsorted(token_ends, ends)
            if len(ids) == 0 or token_ends[-1] != ends[-1] or (token_ends[np.minimum(at, len(ids) - 1)] != ends).any():
                failed += r
                continue
            data, bounds = ids.tobytes(), [0, *((at + 1) * 4).tolist()]
            out.update(zip(r, [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)], strict=True))
        return out, failed

    n_bytes = lambda extra: lambda r: np.fromiter((len(k.encode()) + extra for k in r), np.int64, len(r))
    row = lambda r: blank + f"\n{blank}".join(r)

    def parted(todo: list[str]) -> list[bytes | None]:
        """Ids of the keys that are plain words with marks after them: distinct words and distinct marks are encoded, then put together. None for others."""
        keys = pa.array(todo, pa.large_string())
        w = pc.utf8_rtrim(keys, characters=MARKS)
        wide = pc.invert(pc.string_is_ascii(w))
        letters_only = pc.and_(pc.utf8_is_alpha(w), pc.or_(pc.invert(wide), pc.match_substring_regex(w, LATIN)))
        at = pc.indices_nonzero(letters_only)
        if not len(at):
            return [None] * len(todo)
        w, m = w.take(at), pc.replace_substring_regex(keys.take(at), BEFORE_MARKS, "")
        words_, marks_ = pc.dictionary_encode(w), pc.dictionary_encode(m)
        distinct = words_.dictionary.to_pylist()
        narrow = [k for k in distinct if k.isascii()]
        known = in_rows(words, narrow, lambda r: np.fromiter(map(len, r), np.int64, len(r)) + 1, row)[0]
        if len(narrow) < len(distinct):
            known |= in_rows(words, [k for k in distinct if not k.isascii()], n_bytes(1), lambda r: row(r).translate(letters))[0]
        distinct_marks = marks_.dictionary.to_pylist()
        ends = in_rows(words, [k for k in distinct_marks if k], n_bytes(0), "\n".join)[0] | {"": b""}
        put = pc.binary_join_element_wise(pa.array(map(known.get, distinct), pa.large_binary()).take(words_.indices), pa.array(map(ends.get, distinct_marks), pa.large_binary()).take(marks_.indices), pa.scalar(b"", pa.large_binary()))
        out = np.full(len(todo), None, object)
        out[at.to_numpy()] = np.array(put.to_pylist() + [None], object)[:-1]
        return out.tolist()

    def encode(todo: list[str]) -> list[bytes]:
        inner = [k for k in todo if k[:1] != START] if plain else []
        out = {k: v for k, v in zip(inner, parted(inner), strict=True) if v is not None} if inner else {}
        # The others go through the whole tokenizer, in rows where they keep their bounds.
        rest = [k for k in todo if k not in out] if len(out) < len(todo) else []
        kinds = [[], [], []]  # after a blank, after a line end, alone
        for k in rest:
            kinds[2 if k[:1] == START else 0 if k[:1] != LINE else 2 if k[-1:].isspace() or k == LINE else 1].append(k)
        inner, lines, alone = kinds
        groups = [inner[i : i + 500] for i in range(0, len(inner), 500)]
        alone += [k for r in groups if not joinable(r) for k in r]
        for keys, extra in (([k for r in groups if joinable(r) for k in r], 1), (lines, 0)):
            found, failed = in_rows(t, keys, n_bytes(extra), lambda r: "".join(map(piece, r)))
            out.update(found)
            alone += failed
        for k, e in zip(alone, t.encode_batch_fast([piece(k) for k in alone], add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, "<u4").tobytes()
        return [out[k] for k in todo]

    if not added_tokens:
        return Memory(encode, limit=400_000)
    untouched = functools.cache(lambda: Tokenizer.from_file(path))
    whole = lambda texts: [np.array(e.ids, "<u4") for e in untouched().encode_batch_fast(texts, add_special_tokens=False)]
    return Memory(encode, limit=400_000, whole=whole, added=[a.content for a in t.get_added_tokens_decoder().values()])


def write_tokens(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, tokens_per_file: int = TOKENS_PER_FILE, added_tokens: bool = False) -> DataFrame:
    """Encodes the texts and writes token files in ascending doc_id order; returns part, file, path, docs, tokens, base.

    Range partitions by doc_id (nulls first, equal ids by a hash of the text, so that rows without an id are dealt out too) are
    written side by side; base counts the ids in all earlier files. Each text gets end_id after its own ids, so null and empty texts have that id alone.
    ``added_tokens``: the file's added tokens (<|endoftext|>) get their own id wherever a text holds them, as the
    library does by itself; otherwise special ones are encoded as the plain text they are.
    """
    import public_tokenizers

    spark = docs.sparkSession
    path, folder = tokenizer or public_tokenizers.path("byte_bpe_50k.json"), shared_dir(spark, "tokens")

    def run(batches):
        memory, part = _encoder(path, added_tokens), TaskContext.get().partitionId()
        ended = np.array([end_id], "<u4")
        numbers, held, size, count = [], [], 0, 0

        def close():
            uri = f"{folder}/{part:06d}-{count:06d}.tok"
            write_file(uri, pack(numbers, held))
            return pa.RecordBatch.from_pylist([{"part": part, "file": count, "path": uri, "docs": len(numbers), "tokens": size}], pa.schema([("part", pa.int32()), ("file", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

        for block, texts in text_blocks(batches, 1, 8_000_000):
            for number, own in zip(block.column(0).to_pylist(), memory.ids(texts), strict=True):
                ids = np.append(own, ended)
                numbers.append(number)
                held.append(ids)
                size += len(ids)
                if size >= tokens_per_file:
                    yield close()
                    numbers, held, size, count = [], [], 0, count + 1
        if numbers:
            yield close()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    files = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").mapInArrow(run, "part int, file int, path string, docs long, tokens long")
    files = materialize(files, "token-files")
    # One row a range partition, then the files inside each: neither window holds more than a task's share of files.
    parts = files.groupBy("part").agg(F.sum("tokens").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    within = F.sum("tokens").over(Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    return files.join(parts.select("part", "before"), "part").select("part", "file", "path", "docs", "tokens", (F.coalesce("before", F.lit(0)) + F.coalesce(within, F.lit(0))).alias("base"))


def read_tokens(spark: SparkSession, files: DataFrame, ids: bool = False) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32, and the ids if asked for."""

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = open_file(path)
                starts = np.append(0, f.ends[:-1])
                crc, all_ids = [], []
                for k in range(len(f.doc_ids)):
                    x = f.document(k)
                    crc.append(zlib.crc32(x.astype("<u4", copy=False).tobytes()))
                    if ids:
                        all_ids.append(x)
                cols = [pa.array(f.doc_ids, pa.int64()), pa.array(starts + base, pa.int64()), pa.array(f.ends - starts, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(all_ids, pa.list_(pa.int64()))] * ids, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.select("path", "base").repartition(n, "path").mapInArrow(run, schema)
