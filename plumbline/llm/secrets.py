"""Secret scans: a keyword automaton finds candidates, anchored expressions confirm them near hits, checksums validate.

One Aho-Corasick automaton over the lower-cased bytes holds every kind's keywords. Kinds without a keyword (runs of hex
digits) get one by folding: the text is mapped to one letter per character class, and the keyword is the least run of that
letter. An expression is tried only where a keyword begins, left to right and past the kind's last match, so the matches are
the leftmost non-overlapping ones of the whole text.

Defined results: null and empty texts have no spans; repeated rows are scanned alike; offsets are code points, end exclusive;
bytes that aren't UTF-8 count one code point for each byte that isn't a continuation byte.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name

_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc32(body: bytes) -> bytes:
    """The CRC-32 of ``body`` as six base-62 digits, as some issuers append to their tokens."""
    n, out = zlib.crc32(body), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _BASE62[d] + out
    return out.encode()


def _crc_tail(m: re.Match) -> bool:
    return base62_crc32(m[1]) == m[2]


def _json_head(m: re.Match) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(m[1] + b"=" * (-len(m[1]) % 4)))
    except (ValueError, binascii.Error):
        return False
    return isinstance(head, dict) and "alg" in head


def _luhn(m: re.Match) -> bool:
    digits = [x - 48 for x in m[0] if 48 <= x <= 57][::-1]
    return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0


@dataclass(frozen=True)
class Kind:
    """keywords: lower-case bytes with which every match begins. valid: what a match must also satisfy."""

    name: str
    keywords: tuple[bytes, ...]
    pattern: re.Pattern
    valid: Callable[[re.Match], bool] = bool
    #: A byte to fold to ``fold_to``; all other bytes fold to a space. Such a kind has one keyword, in folded text.
    fold: bytes = b""
    #: A class whose run, from where the expression fails, holds no other match: starts in it are passed over, so that scans stay linear.
    run: re.Pattern | None = None


#: Base kinds first, in the order in which equal starts are listed.
KINDS = (
    Kind("assign", (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"), re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    Kind("access", (b"akia",), re.compile(rb"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    Kind("hex", (b"x" * 24,), re.compile(rb"[0-9a-f]+"), lambda m: len(m[0]) >= 24, b"0123456789abcdef"),
    Kind("forge_token", (b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_"), re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), _crc_tail),
    Kind("registry_token", (b"npm_",), re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), _crc_tail),
    Kind("web_token", (b"eyj",), re.compile(rb"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)"), _json_head, run=re.compile(rb"[A-Za-z0-9_-]*")),
    Kind("private_key", (b"-----begin ",), re.compile(rb"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----"), bool),
    Kind("card", (b"9" * 13, b"9999 9999 9999 9", b"9999-9999-9999-9"), re.compile(rb"[0-9]{13,19}(?![0-9])|[0-9]{4}(?:([ -])[0-9]{4})(?:\1[0-9]{4})\1[0-9]{1,7}(?![0-9])"), _luhn, b"0123456789"),
)
BASE = ("assign", "access", "hex")
_SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long"))
RANK = {k.name: n for n, k in enumerate(KINDS)}


def _fold(kind: Kind) -> bytes:
    """A table to fold bytes by: the class to its keyword's letter, other bytes to themselves if a keyword has them, else to 0."""
    letter = kind.keywords[0][0]
    used = {c for word in kind.keywords for c in word} - {letter}
    return bytes(letter if c in kind.fold else c if c in used else 0 for c in range(256))


class Scanner:
    """Scans texts for ``kinds``; built once for each worker."""

    def __init__(self, kinds: tuple[Kind, ...] = KINDS):
        self.kinds = kinds
        self.rank = {k.name: n for n, k in enumerate(kinds)}
        self.groups: list[tuple[bytes | None, ahocorasick.Automaton]] = []
        by_fold: dict[bytes | None, list[tuple[int, bytes]]] = {}
        for n, kind in enumerate(kinds):
            for word in kind.keywords:
                by_fold.setdefault(_fold(kind) if kind.fold else None, []).append((n, word))
        for table, words in by_fold.items():
            auto = ahocorasick.Automaton()
            at: dict[bytes, list[int]] = {}
            for n, word in words:
                at.setdefault(word, []).append(n)
            for word, ns in at.items():
                auto.add_word(word.decode("latin-1"), (len(word), ns))
            auto.make_automaton()
            self.groups.append((table, auto))

    def candidates(self, text: bytes) -> dict[int, list[int]]:
        """The byte offsets where a keyword begins, by kind. A folded run counts once, where it begins."""
        out: dict[int, list[int]] = {}
        for table, auto in self.groups:
            folded = text.lower() if table is None else text.translate(table)
            if table is not None:
                words = [w for w in auto.keys()]
                if not any(w.encode("latin-1") in folded for w in words):
                    continue
            for end, (size, ns) in auto.iter(folded.decode("latin-1")):
                start = end - size + 1
                for n in ns:
                    out.setdefault(n, []).append(start)
        return out

    def spans(self, text: bytes) -> list[tuple[str, int, int]]:
        """(kind, start, end) in bytes, by start, then kind."""
        found = []
        for n, starts in self.candidates(text).items():
            kind, past = self.kinds[n], 0
            for start in starts if len(kind.keywords) == 1 else sorted(starts):
                if start < past:
                    continue
                if kind.fold and start and text[start - 1] in kind.fold:
                    continue  # the run's beginning had its turn
                if m := kind.pattern.match(text, start):
                    past = m.end()
                    if kind.valid(m):
                        found.append((kind.name, start, past))
                elif kind.run:
                    past = kind.run.match(text, start).end()
        return sorted(found, key=lambda s: (s[1], self.rank[s[0]], s[2]))


def code_points(text: bytes, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Byte spans as code-point spans."""
    if not spans or text.isascii():
        return spans
    lead = (np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(lead)])
    return [(k, int(before[a]), int(before[b])) for k, a, b in spans]


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """docs' columns (or ``keep``) with ``secrets``, an array of (kind, start, end) in code points, by start, then kind."""
    own = list(docs.columns) if keep is None else keep
    body, found = free_name(docs, "body"), free_name(docs.select(*own), "secrets")
    wide = docs.select(*[F.col(f"`{c}`") for c in own], F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias(body))
    kind_type = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(kinds)
        for batch in batches:
            rows = []
            for x in batch.column(len(own)):
                t = x.as_py()
                rows.append([{"kind": k, "start": a, "end": b} for k, a, b in code_points(t, scanner.spans(t))])
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(own))], pa.array(rows, pa.list_(kind_type))], names=[*batch.schema.names[: len(own)], found])

    return wide.mapInArrow(scanned, wide.drop(body).schema.add(found, _SPANS))


def redact(text: bytes, spans: list[tuple[str, int, int]]) -> bytes:
    """The text with each byte span, overlapping ones united, replaced by ``[kind]`` of its first."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]".encode()]
        at = max(at, b)
    return b"".join([*out, text[at:]])


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
