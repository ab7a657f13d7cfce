"""Cuts texts into pieces that a byte-level tokenizer encodes alone, and remembers each piece's result.

The pre-tokenizer pattern never joins a non-space to white space after it, and a blank binds to what follows.
So every place between a non-space character and a blank is a boundary of pre-tokens, and what lies between two such
places is encoded alike in any text. Words repeat, so each distinct piece is encoded once for each worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: A blank after white space that no visible character follows: there a plain split at blanks would part a run of white space.
_RUN = regex.compile(r"\s (?!\S)")
_CUT = regex.compile(r"(?<=\S)(?= )", regex.V1)


#: Marks the key of a piece without a leading blank; no text from Spark can hold it.
START = "\ud800"
#: Marks the key of a piece that starts with a line end instead of a blank, in texts that don't hold this character.
LINE = "\0"
#: A line end after one of these is a boundary too: a visible character never joins the white space after it.
LINE_ENDS = ".,:!?"


def pieces(text: str) -> list[str]:
    """The keys of a text's pieces, in order. Every piece but the first starts with a blank, which its key leaves out."""
    if _RUN.search(text):
        first, *rest = (p for p in _CUT.split(text) if p)
        out = [p[1:] for p in rest]
        return [first[1:] if first[0] == " " else START + first, *out]
    out = text.split(" ")
    if out[0]:
        out[0] = START + out[0]
        return out
    return out[1:]


def piece(key: str) -> str:
    return key[1:] if key[:1] == START else "\n" + key[1:] if key[:1] == LINE else " " + key


def joinable(todo: list[str]) -> bool:
    """Whether these pieces, each with its leading blank, keep their bounds when they stand in a row."""
    return not _RUN.search(" ".join(["", *todo])) and not any(k[:1] == START for k in todo)


class Memory(dict):
    """key of a piece -> encoded, for two generations of ``limit`` pieces: rare ones are forgotten and encoded again if they return."""

    def __init__(self, encode: Callable[[list[str]], Iterable], limit: int = 180_000, longest: int = 64, whole: Callable[[list[str]], list[np.ndarray]] | None = None, added: Iterable[str] = ()):
        """Texts that hold one of ``added`` aren't cut: ids() gives them to ``whole``."""
        super().__init__()
        self.encode, self.limit, self.longest, self.old, self.long, self.whole, self.added = encode, limit, longest, {}, [], whole, list(added)

    def __missing__(self, key: str):
        (value,) = self.encode([key])
        return value

    def learn(self, texts: list[str]) -> dict:
        """Makes every piece of these texts present. Pieces over ``longest`` are kept for these texts only."""
        new: set[str] = set()
        for text in texts:
            new.update(pieces(text))
        return self.learn_keys(new)

    def learn_keys(self, new: set[str]) -> dict:
        if len(self) > self.limit:
            self.forget_long()
            self.old = dict(self)
            self.clear()
        new = new.difference(self)  # walks the new keys; difference_update() would walk all that is remembered
        again = {k: self.old[k] for k in new if k in self.old}
        self.update(again)
        new.difference_update(again)
        todo = list(new)
        self.long += [k for k in todo if len(k) > self.longest]
        self.update(zip(todo, self.encode(todo), strict=True))
        return self

    def forget_long(self) -> None:
        for k in self.long:
            self.pop(k, None)
        self.long = []

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids, for an ``encode`` that gives little-endian unsigned 32-bit ints as bytes.

        Splitting, finding the distinct pieces and laying out the ids go over all texts at once; only distinct
        pieces are handled one by one.
        """
        out = [np.zeros(0, "<u4")] * len(texts)
        uncut = {i for a in self.added for i, t in enumerate(texts) if a in t}
        if uncut:
            for i, x in zip(uncut, self.whole([texts[i] for i in uncut]), strict=True):
                out[i] = x
        odd = [i for i, t in enumerate(texts) if i not in uncut and (LINE in t or _RUN.search(t))]
        for i in odd:
            keys = [START + texts[i]] if LINE in texts[i] else pieces(texts[i])
            self.learn_keys(set(keys))
            out[i] = np.frombuffer(b"".join(map(self.__getitem__, keys)), "<u4")
        usual = sorted(set(range(len(texts))).difference(odd, uncut))
        if usual:
            cut = [texts[i] for i in usual]
            for mark in LINE_ENDS:
                cut = [t.replace(mark + "\n", f"{mark} {LINE}") for t in cut]
            split = pc.split_pattern(pa.array(cut, pa.large_string()), " ")
            first = split.offsets.to_numpy()[:-1]
            distinct = pc.dictionary_encode(split.flatten())
            keys, at = distinct.dictionary.to_pylist(), distinct.indices.to_numpy().astype(np.int64)
            # No blank stands before a text's first piece; an empty one is no piece.
            heads = [START + keys[k] if keys[k] else START for k in at[first].tolist()]
            at[first] = np.arange(len(keys), len(keys) + len(heads))
            keys += heads
            self.learn_keys(set(keys))
            encoded = pa.array(map(self.__getitem__, keys), pa.large_binary())
            laid = encoded.take(pa.array(at))  # every piece's bytes, one after the other
            _, offsets, data = laid.buffers()
            flat, bounds = np.frombuffer(data or b"", "<u4"), np.frombuffer(offsets, np.int64)[: len(at) + 1] // 4
            bounds = bounds[np.append(first, len(at))].tolist()
            for i, a, b in zip(usual, bounds, bounds[1:], strict=False):
                out[i] = flat[a:b].copy()
        self.forget_long()
        return out
