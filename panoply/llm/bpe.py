"""Byte-level BPE encoding and decoding through a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import functools
import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import text_blocks
from .pieces import Memory, piece, pieces

NONE = np.int32(2**31 - 1)
#: Bytes of pre-tokens that share a queue.
QUEUE_BYTES = 1_500_000


class RankQueue:
    """Buckets of linked-list positions, one for each merge rank; a tree of 64-bit words says which hold any.

    push() sets one bit a level, first() finds the lowest set bit from the top down. Entries are never taken
    out when a merge makes them obsolete: whoever takes a bucket skips those whose pair has changed.
    """

    def __init__(self, n: int):
        self.buckets: dict[int, list] = {}
        self.levels = []
        while True:
            n = (n + 63) // 64
            self.levels.append([0] * n)
            if n == 1:
                break

    def push(self, rank: int, positions) -> None:
        held = self.buckets.get(rank)
        if held is not None:
            held.append(positions)
            return
        self.buckets[rank] = [positions]
        for level in self.levels:
            at, bit = rank >> 6, rank & 63
            word = level[at]
            level[at] = word | (1 << bit)
            if word:
                break
            rank = at

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Every position into its rank's bucket."""
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        at = 0
        for rank, end in zip(ranks[np.append(0, cuts)].tolist(), [*cuts.tolist(), len(ranks)], strict=True):
            self.push(rank, positions[at:end])
            at = end

    def take(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank with a bucket, and its positions; None if all are empty."""
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            if not word:
                return None
            at = at << 6 | (word & -word).bit_length() - 1
        rank, held = at, self.buckets.pop(at)
        for level in self.levels:
            up, bit = at >> 6, at & 63
            level[up] &= ~(1 << bit)
            if level[up]:
                break
            at = up
        return rank, held[0] if len(held) == 1 else np.concatenate(held)


class ByteBPE:
    """A rank file's vocabulary. ``encode_words`` merges many pre-tokens in one queue; barriers keep them apart."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.size = max(ranks.values()) + 1
        self.bytes = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.numbers = list(range(self.size))  # one object for each id, whatever holds it
        self.decimal = [str(i) for i in range(self.size)]
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * (self.size + 1) + right] = rank
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int32)
        self.memory = Memory(self._encode_pieces)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank at which two neighbouring tokens merge, or NONE."""
        if not len(self.keys):
            return np.full(len(left), NONE)
        key = left.astype(np.int64) * (self.size + 1) + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of non-empty words, one after the other, and the bounds of each word in them."""
        ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words))) - 1
        n = int(ends[-1]) + 1
        wall = self.size  # the id of a barrier: no pair with it merges
        ids = np.append(self.single[np.frombuffer(b"\0".join(words) + b"\0", np.uint8)], np.int32(wall))
        ids[ends] = wall
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[n], before[0] = n, n
        alive = np.ones(n + 1, bool)
        rank_at = np.append(self.pair_ranks(ids[:-1], ids[1:]), NONE)
        queue = RankQueue(self.size)
        some = np.flatnonzero(rank_at != NONE)
        queue.push_all(rank_at[some], some)
        odd: list[np.ndarray] = []
        while (got := queue.take()) is not None:
            rank, at = got
            at = at[rank_at[at] == rank]  # stale entries
            if not len(at):
                continue
            if len(at) > 1:
                at = np.unique(at)
                touching = after[at[:-1]] == at[1:]
                if touching.any():  # in a run of overlapping pairs every second merges, from the left
                    index = np.arange(len(at))
                    start = np.maximum.accumulate(np.where(np.append(True, ~touching), index, 0))
                    at = at[(index - start) % 2 == 0]
            right = after[at]
            beyond = after[right]
            ids[at] = rank
            after[at] = beyond
            before[beyond] = at
            alive[right] = False
            rank_at[right] = NONE
            prior = before[at]
            where = np.concatenate([prior, at])
            new = self.pair_ranks(ids[where], ids[after[where]])
            rank_at[where] = new
            found = new != NONE
            if found.any():
                where, new = where[found], new[found]
                queue.push_all(new, where)
                if (low := new < rank).any():
                    odd.append(where[low])
        keep = alive & (ids != wall)
        count = np.append(0, np.cumsum(keep[:n]))
        bounds = np.append(0, count[ends])
        flat = ids[keep]
        if odd:  # a pair came up that should have gone before: such words go through again, one merge at a time
            again = np.unique(np.searchsorted(ends, np.concatenate(odd)))
            parts = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            for k in again.tolist():
                parts[k] = self._one_by_one(words[k])
            flat = np.concatenate(parts)
            bounds = np.append(0, np.cumsum([len(p) for p in parts]))
        return flat, bounds

    def _one_by_one(self, word: bytes) -> np.ndarray:
        """The same queue with one merge for each step, lowest rank and then leftmost first."""
        n = len(word)
        ids = [int(self.single[b]) for b in word] + [self.size]
        after, before = [*range(1, n + 1), n], [*range(-1, n)]
        pair = lambda i: int(self.pair_ranks(np.array([ids[i]]), np.array([ids[after[i]]]))[0]) if i >= 0 and after[i] < n else int(NONE)
        rank_at = [pair(i) for i in range(n)]
        queue = RankQueue(self.size)
        for i, r in enumerate(rank_at):
            if r != NONE:
                queue.push(r, np.array([i]))
        alive = [True] * n
        while (got := queue.take()) is not None:
            rank, at = got
            at = np.unique([i for i in at.tolist() if alive[i] and rank_at[i] == rank]).astype(np.int64)
            if not len(at):
                continue
            if len(at) > 1:
                queue.push(rank, at[1:])
            i = int(at[0])
            r = after[i]
            ids[i], after[i], alive[r], rank_at[r] = rank, after[r], False, int(NONE)
            if after[i] < n:
                before[after[i]] = i
            for j in (before[i], i):
                if j >= 0:
                    rank_at[j] = pair(j)
                    if rank_at[j] != NONE:
                        queue.push(rank_at[j], np.array([j]))
        return np.array([ids[i] for i in range(n) if alive[i]], dtype=np.int64)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each pre-token; one that is a token itself stays whole."""
        raw = [w.encode("utf-8", "replace") for w in words]
        out: list = [None] * len(raw)
        todo = []
        for k, w in enumerate(raw):
            if (rank := self.ranks.get(w)) is not None:
                out[k] = [rank]
            elif w:
                todo.append(k)
            else:
                out[k] = []
        at = 0
        while at < len(todo):  # one queue for about QUEUE_BYTES of pre-tokens
            end, size = at, 0
            while end < len(todo) and (end == at or size < QUEUE_BYTES):
                size += len(raw[todo[end]])
                end += 1
            flat, bounds = self.merge([raw[k] for k in todo[at:end]])
            flat, bounds = list(map(self.numbers.__getitem__, flat.tolist())), bounds.tolist()
            for j, k in enumerate(todo[at:end]):
                out[k] = flat[bounds[j] : bounds[j + 1]]
            at = end
        return out

    def _encode_pieces(self, todo: list[str]) -> list[tuple[int, ...]]:
        split = [self.pattern.findall(piece(k)) for k in todo]
        words = list(dict.fromkeys(chain.from_iterable(split)))
        ids = dict(zip(words, self.encode_words(words), strict=True))
        return [tuple(chain.from_iterable(map(ids.__getitem__, s))) for s in split]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        memory = self.memory.learn(texts)
        out = [list(chain.from_iterable(map(memory.__getitem__, pieces(t)))) for t in texts]
        memory.forget_long()
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBPE:
    """Reads a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return ByteBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)


def default_model() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, model: tuple[str, str] | None = None, text: str = "text", ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids themselves if asked for.

    No shuffle: each row is encoded where it is read. Null and empty texts have no tokens; their digests are those of
    no bytes. Rows stay as they are, repeated or without an id; other columns are not read.
    """
    path, pattern = model or default_model()

    def run(batches):
        bpe = load(path, pattern)
        dec = bpe.decimal.__getitem__
        for part, texts in text_blocks(batches, 1, 8_000_000):
            memory = bpe.memory.learn(texts)
            n, a, b, all_ids = [], [], [], []
            for t in texts:
                got = list(chain.from_iterable(map(memory.__getitem__, pieces(t))))
                n.append(len(got))
                a.append(hashlib.sha256(" ".join(map(dec, got)).encode()).hexdigest())
                b.append(hashlib.sha256(bpe.decode(got)).hexdigest())
                if ids:
                    all_ids.append(np.array(got, np.int32))
            memory.forget_long()
            columns = [part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(all_ids, pa.list_(pa.int32()))] * ids, names=names + ["ids"] * ids)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, schema)
