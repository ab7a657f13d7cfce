"""Secret scans with structural confirmation of encoded keys and signed tokens."""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_blocks

# The base patterns and the least length of what each must match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs are maximal, so the shorter ones can be left out of the match itself.
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: Kinds by rank at equal starts: the base ones, then those that structure confirms.
KINDS = ("assign", "access", "hex", "pem", "jwt", "der", "ssh", "nested")

# The method's own candidates; the base patterns above stay as they are. In JSON and source strings a line break is a backslash and a letter,
# and a slash, plus or equals sign may be escaped too.
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s,:\\]++|-(?!----))*+)-----END \1-----")
JWT = re.compile(r"(?<![A-Za-z0-9_-])(ey[A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]*)")
BREAK = r"(?:\\+[rnt])++|[\x20\t]*+(?:\r\n?|\n)[\x20\t]*+"
_BREAK = re.compile(BREAK)
#: Characters of the shortest nested secret, 18 bytes.
BASE64_LEAST, HEX_LEAST = 24, 36


def _runs(chars: str, least: int, escaped: str = "", tail: str = "") -> re.Pattern:
    """Maximal runs of these characters, joined over line breaks: a long one, or any that goes on behind a break."""
    begin, other = (rf"(?={chars}|{escaped})", rf"|{escaped}") if escaped else (rf"(?={chars})", "")
    more = rf"(?:(?:(?:{BREAK}){begin}{other}){chars}*+)"
    return re.compile(rf"(?<!{chars})(?:{chars}{{{least},}}+{more}*+|{chars}++{more}++){tail}")


BASE64_RUN = _runs("[A-Za-z0-9+/_-]", BASE64_LEAST, r"\\+(?:/|u002[bBfF])", r"(?:=|\\+u003[dD]){0,2}")
#: Either case; then, inside such runs, each case alone.
HEX_RUN, *HEX_CASES = (_runs(chars, HEX_LEAST) for chars in ("[0-9A-Fa-f]", "[0-9a-f]", "[0-9A-F]"))
_ESCAPED = re.compile(r"\\+(u00[0-9A-Fa-f]{2}|[rnt/])")
_PRINTED = re.compile(rb"[\t\n\r\x20-\x7e]+")
# Signature bytes of the token algorithms (None: any length of 64 or more).
SIGNATURE = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64, "RS256": None, "RS384": None, "RS512": None, "PS256": None, "PS384": None, "PS512": None, "none": 0}
SSH_MAGIC = b"openssh-key-v1\0"


def unbase64(text: str) -> bytes | None:
    """Either alphabet, padded or not; None if it isn't base64."""
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def unescaped(text: str) -> str:
    """Escaped line breaks, slashes and \\u00XX as the characters they stand for."""
    return _ESCAPED.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" else m[1] if m[1] == "/" else "\n", text) if "\\" in text else text


def der_items(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, content start, content end) of the elements that fill data[start:end] exactly; None if they don't."""
    items = []
    while start < end:
        if end - start < 2:
            return None
        tag, size, start = data[start], data[start + 1], start + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or start + n > end:
                return None
            size = int.from_bytes(data[start : start + n], "big")
            if size < 0x80:
                return None
            start += n
        if size > end - start:
            return None
        items.append((tag, start, start + size))
        start += size
    return items


def is_der_key(data: bytes) -> bool:
    """A sequence whose length is the data's, with the members of a private key, lengths nested without a rest. Public keys are no secrets."""
    outer = der_items(data, 0, len(data))
    if outer is None or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    items = der_items(data, *outer[0][1:])
    if not items:
        return False
    tags = [t for t, _, _ in items]

    def algorithm(item) -> bool:
        inner = der_items(data, *item[1:]) if item[0] == 0x30 else None
        return bool(inner) and inner[0][0] == 0x06 and inner[0][2] > inner[0][1]

    small = tags[0] == 0x02 and items[0][2] - items[0][1] == 1
    if small and len(tags) >= 9 and set(tags[:9]) == {0x02}:
        return True  # RSA: version and eight integers
    if small and tags == [0x02] * 6:
        return True  # DSA: version, p, q, g, public and private integer
    if small and len(tags) >= 3 and tags[1] == 0x30 and tags[2] == 0x04:
        return algorithm(items[1])  # version, algorithm, octet string
    if small and len(tags) >= 2 and tags[1] == 0x04 and set(tags[2:]) <= {0xA0, 0xA1}:
        return items[1][2] - items[1][1] in range(16, 80)  # elliptic-curve key
    return tags == [0x30, 0x04] and algorithm(items[0])  # encrypted key


def ssh_size(read) -> int | None:
    """Bytes of the key that read(start, end) gives parts of: the magic, then strings by 32-bit lengths: cipher, kdf, options, a count of keys, as many public keys and the private block."""
    at = len(SSH_MAGIC)
    if read(0, at) != SSH_MAGIC:
        return None

    def number() -> int | None:
        nonlocal at
        four, at = read(at, at + 4), at + 4
        return int.from_bytes(four, "big") if four is not None and len(four) == 4 else None

    for k in range(3):
        size = number()
        if size is None or k == 0 and not size:
            return None
        at += size
    count = number()
    if count is None or not 1 <= count <= 64:
        return None
    for _ in range(count + 1):  # the public keys, then the private block
        size = number()
        if size is None:
            return None
        at += size
    return at


def is_ssh_key(data: bytes) -> bool:
    return ssh_size(lambda a, b: data[a:b]) == len(data)


def is_signed_token(header: str, claims: str, signature: str) -> bool:
    """A JSON header that names a known algorithm, JSON claims, and a signature of that algorithm's length."""
    head, body, sign = unbase64(header), unbase64(claims), unbase64(signature)
    if head is None or body is None or sign is None:
        return False
    try:
        head, body = json.loads(head), json.loads(body)
    except (ValueError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(body, dict) or not isinstance(head.get("alg"), str) or head["alg"] not in SIGNATURE:
        return False
    least = SIGNATURE[head["alg"]]
    return len(sign) >= 64 if least is None else len(sign) == least


def _is_nested(data: bytes | None, seen: dict[bytes, bool]) -> bool:
    """Whether it is text with a base secret, or a confirmed one, in it. ``seen`` holds what is known of texts by their digests, as neighbouring
    candidates often decode to the same text."""
    if not data or not _PRINTED.fullmatch(data):
        return False
    digest = hashlib.blake2b(data, digest_size=16).digest()
    if digest not in seen:
        inner = data.decode("ascii")
        seen[digest] = any(k != "hex" for k, _, _ in base_spans(inner)) or bool(confirmed(inner, seen))
    return seen[digest]


class Run:
    """A run of encoded characters as one string, with the places where its lines start and end in it and in the text."""

    def __init__(self, text: str, start: int, end: int, decode, unit: tuple[int, int], heads: set[str]):
        # The letter of an escape just before the run is no part of it: no key or text starts with it in either encoding.
        start += text[start - 1 : start] == "\\" and text[start] in "rnt"
        self.decode, (self.chars, self.bytes), self.heads = decode, unit, heads
        self.lines, at, parts = [], 0, []  # (start, end) in the joined string and in the text
        for a, b in self._lines(text, start, end):
            part = unescaped(text[a:b])
            parts.append(part)
            size = len(part.rstrip("="))
            self.lines.append((at, at + size, a, b))
            at += size
        self.joined, self.ends = "".join(parts), {line[1]: k for k, line in enumerate(self.lines)}
        self.places, self.width, self.alike = list(self.ends), [b - a for a, b, _, _ in self.lines], list(range(len(self.lines)))
        for k in range(len(self.lines) - 2, -1, -1):  # the last of the lines from here on that are as wide as this one
            if self.width[k] == self.width[k + 1]:
                self.alike[k] = self.alike[k + 1]

    @staticmethod
    def _lines(text: str, start: int, end: int):
        for m in _BREAK.finditer(text, start, end):
            if m.start() > start:
                yield start, m.start()
            start = m.end()
        if end > start:
            yield start, end

    def read(self, start: int, a: int, b: int) -> bytes | None:
        """Bytes a to b of what starts at this place."""
        first = a // self.bytes
        data = self.decode(self.joined[start + first * self.chars : start - (-b // self.bytes) * self.chars])
        return None if data is None else data[a - first * self.bytes : b - first * self.bytes]

    def key(self, k: int) -> tuple[str, int] | None:
        """Kind and last line of the key that starts with line k. Its own lengths say where it ends, and that has to be the end of a line."""
        start = self.lines[k][0]
        if self.joined[start : start + 1] not in self.heads:
            return None
        head = self.read(start, 0, 6)
        if not head or len(head) < 6:
            return None
        kind, size = None, None
        if head[0] == 0x30:
            n = head[1] & 0x7F if head[1] & 0x80 else 0
            kind, size = "der", 2 + n + int.from_bytes(head[2 : 2 + n], "big") if n else 2 + head[1]
            if n > 4:
                return None
        elif SSH_MAGIC.startswith(head):
            kind, size = "ssh", ssh_size(lambda a, b: self.read(start, a, b))
        if size is None or size < 16:
            return None
        end = start - (-size * self.chars // self.bytes)
        last = self.ends.get(end)
        if last is None:
            return None
        data = self.decode(self.joined[start:end])
        return (kind, last) if data and (is_der_key(data) if kind == "der" else is_ssh_key(data)) else None

    def text(self, k: int, seen: dict[bytes, bool]) -> tuple[int | None, int]:
        """The last line of the encoded text with a secret that starts with line k, if there is one: lines of one width and a shorter last one,
        as far as they are text, or line k alone. And the last line whose characters have been searched with it, from line k's place on."""
        lines = self.lines
        start, first_end = lines[k][:2]
        head = self.decode(self.joined[start : start + self.chars])
        if not head or not _PRINTED.fullmatch(head):
            return None, k
        full = self.alike[k + (k + 1 < len(lines) and self.width[k] < self.width[k + 1])]
        last = min(full + (full + 1 < len(lines) and self.width[full + 1] < self.width[full]), len(lines) - 1)
        good, stop, step = start, lines[last][1], 64
        while good < stop:  # as far as the bytes are printed ones
            end, step = min(good + step, stop), min(2 * step, 65_536)
            data = self.decode(self.joined[good : end - ((end - good) % self.chars == 1)])
            m = _PRINTED.match(data) if data else None
            if data and m and m.end() == len(data):
                good = end
                continue
            good += m.end() * self.chars // self.bytes if m else 0
            break
        if first_end > good:
            return None, k
        last = bisect.bisect_right(self.places, good) - 1
        for j in sorted({last, max(last - 1, k), k}, reverse=True):
            if _is_nested(self.decode(self.joined[start : lines[j][1]]), seen):
                return j, j
        return None, last

    def found(self, seen: dict[bytes, bool]):
        """(kind, start, end) in the text."""
        k, n = 0, len(self.lines)
        searched = [-1] * self.chars  # the last line searched by the place in its unit where a line starts: such a line's text is the end of one searched before
        while k < n:
            got, place = self.key(k), self.lines[k][0] % self.chars
            if got is None and k > searched[place]:
                # A short line before a wider one is more often a word above the block than its first line.
                above = k + 1 < n and self.lines[k][1] - self.lines[k][0] < self.lines[k + 1][1] - self.lines[k + 1][0]
                if not (above and (self.key(k + 1) or self.text(k + 1, seen)[0] is not None)):
                    last, searched[place] = self.text(k, seen)
                    got = None if last is None else ("nested", last)
            if got:
                yield got[0], self.lines[k][2], self.lines[got[1]][3]
                k = got[1]
            k += 1


def unhex(text: str) -> bytes | None:
    return bytes.fromhex(text) if len(text) % 2 == 0 else None


#: Characters and bytes of a unit of each encoding, and the characters that a key's first byte (a sequence's tag, the magic's "o") can start with.
BASE64_UNIT, HEX_UNIT = ((4, 3), {"M", "b"}), ((2, 1), {"3", "6"})


def confirmed(text: str, seen: dict[bytes, bool] | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the encoded candidates that parse as keys or signed tokens, or decode to text that has some.

    Encodings may lie around one another as often as they like: each decoding leaves three quarters of its characters at most, so the
    search ends by itself, some 65 deep for the longest string. An empty text has none. ``seen`` is the search's own memory.
    """
    out, seen = [], {} if seen is None else seen
    if "-----BEGIN" in text:
        for m in PEM.finditer(text):
            inner = unescaped(m[2])
            bodies = [inner] if ":" not in inner else ["".join(x for x in inner.split("\n") if ":" not in x), inner.rpartition(",")[2]]
            for data in (unbase64(re.sub(r"\s", "", x)) for x in bodies):
                if data and (is_der_key(data) or is_ssh_key(data) or "ENCRYPTED" in m[2] and len(data) % 8 == 0):
                    out.append(("pem", m.start(), m.end()))
                    break
    for m in JWT.finditer(text) if "ey" in text else ():
        if is_signed_token(*m.groups()):
            out.append(("jwt", m.start(), m.end()))

    def add(m: re.Match, decode, unit: tuple[tuple[int, int], set[str]]) -> None:
        out.extend([f for f in Run(text, *m.span(), decode, *unit).found(seen) if not any(s <= f[1] < e for _, s, e in out)])

    for m in BASE64_RUN.finditer(text):
        if m.end() - m.start() >= BASE64_LEAST:
            add(m, unbase64, BASE64_UNIT)
    for m in HEX_RUN.finditer(text):
        if m.end() - m.start() >= HEX_LEAST:
            add(m, unhex, HEX_UNIT)
            for pattern in HEX_CASES:
                for part in pattern.finditer(text, *m.span()):
                    if part.end() - part.start() >= HEX_LEAST and part.span() != m.span():
                        add(part, unhex, HEX_UNIT)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def scan_text(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and base with confirmed ones: (kind, start, end) in code points by start, then kind."""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(base_spans(text), key=order)
    return base, sorted(base + confirmed(text), key=order)


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row, n_confirmed. Null and empty texts have no spans.

    Each text is searched whole where it is read; nothing is shuffled. Other columns are not read.
    """

    def run(batches):
        for part, texts in text_blocks(batches, 1):
            found = [scan_text(t) for t in texts]
            count = [[sum(s[0] == k for s in base) for base, _ in found] for k in KINDS[:3]]
            cols = [part.column(0), *[pa.array(c, pa.int64()) for c in count]]
            cols += [pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b, _ in found], pa.string()), pa.array([_joined(a) for _, a in found], pa.string()), pa.array([len(a) - len(b) for b, a in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")


def redact_text(text: str, mark: str = "[secret]") -> str:
    """The text with each maximal stretch that spans cover replaced by the mark."""
    _, spans = scan_text(text)
    out, at = [], 0
    for _, a, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:] if spans else text


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with the secrets in the text column replaced; null stays null, other columns stay."""
    schema, at = docs.schema, docs.columns.index(text)

    def run(batches):
        for batch in batches:
            for part, texts in text_blocks([batch], at):
                valid = part.column(at).is_valid().to_pylist()
                new = pa.array([redact_text(t, mark) if v else None for t, v in zip(texts, valid, strict=True)], part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(part.columns)], schema=part.schema)

    return docs.mapInArrow(run, schema)
