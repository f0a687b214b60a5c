"""Quality rules as a short-circuit cascade: cheap rules that reject much run first.

Each rule reads a ``View`` of one text, which computes a feature when a rule first asks for it. On a sample, every rule is
timed on fresh views and its rejections are counted; rules then run by rejections per second, and a text's rules stop at the
first rejection. The order changes the cost only: a text is kept if no rule rejects it.

Defined results: a null text has no words, like an empty one; repeated rows are judged alike; an empty table gives an empty
result; other columns of any name pass through, and a result column that clashes gets leading underscores.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Rows of the sample that rules are timed on, as expected; it sets the order of the rules only, never a verdict.
SAMPLE_ROWS = 400


class View:
    """The features of one text (UTF-8 bytes), each computed once."""

    def __init__(self, text: bytes):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        joined = b"".join(self.words)
        return len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.text.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words that lie in a window of 8 words which the text has twice or more."""
        words = self.words
        n = len(words) - WINDOW + 1
        if n < 2:
            return 0
        ids = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
        h = ids[:n] * _SALT[0]
        for k in range(1, WINDOW):
            h = h + ids[k : k + n] * _SALT[k]
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        if not same.any():  # equal windows have equal hashes
            return 0
        maybe = np.zeros(n, dtype=bool)
        maybe[order[1:][same]] = maybe[order[:-1][same]] = True
        seen: dict[tuple, list[int]] = {}
        for i in np.flatnonzero(maybe).tolist():
            seen.setdefault(tuple(words[i : i + WINDOW]), []).append(i)
        hit = np.zeros(len(words) + 1, dtype=np.int64)
        for at in seen.values():
            if len(at) > 1:
                np.add.at(hit, at, 1)
                np.add.at(hit, np.asarray(at) + WINDOW, -1)
        return int((np.cumsum(hit) > 0).sum())


_SALT = np.random.Generator(np.random.PCG64(8)).integers(0, 2**64, WINDOW, dtype=np.uint64) | np.uint64(1)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[View], bool]


#: The production rules. The thresholds leave room around ordinary prose, so that clean documents stay.
RULES = (
    Rule("few_words", lambda v: v.n_words < 20),
    Rule("repeated_windows", lambda v: 100 * v.n_repeat_words > 30 * v.n_words),
    Rule("many_symbols", lambda v: 2 * v.n_symbols > v.n_words),
    Rule("word_length", lambda v: v.n_words > 0 and not 2 * v.n_words <= v.word_chars <= 20 * v.n_words),
    Rule("duplicate_lines", lambda v: len(v.lines) >= 4 and 2 * v.n_dup_lines > len(v.lines)),
)
BASE_RULES = ("few_words", "repeated_windows")


def _rule(name: str, rules: tuple[Rule, ...]) -> Rule:
    return next(r for r in rules if r.name == name)


def measure(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds a text, share rejected) of each rule over about ``rows`` texts, drawn where they are: no rows move.

    Only these figures come to the driver. An empty table gives no figures, and a sample that misses leaves the given order.
    """
    share = min(1.0, rows / max(1, docs.count()))
    sample = docs.where(F.rand(9) < share).select(F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("t"))

    def timed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, hits, n = [0.0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                n += 1
                for k, rule in enumerate(rules):
                    began = time.perf_counter()
                    hits[k] += rule.rejects(View(x))
                    spent[k] += time.perf_counter() - began
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([r.name for r in rules]), pa.array(spent), pa.array(hits, pa.int64()), pa.array([n] * len(rules), pa.int64())], names=["rule", "s", "hits", "n"])

    got: dict[str, list[float]] = {}
    for row in sample.mapInArrow(timed, "rule string, s double, hits long, n long").groupBy("rule").agg(F.sum("s").alias("s"), F.sum("hits").alias("hits"), F.sum("n").alias("n")).collect():
        got[row["rule"]] = [row["s"] / row["n"], row["hits"] / row["n"]]
    return [(r.name, *got[r.name]) for r in rules if r.name in got]


def ordered(rules: tuple[Rule, ...], figures: list[tuple[str, float, float]]) -> tuple[Rule, ...]:
    """Rules by rejections per second, most first; rules that reject nothing go by cost; unmeasured rules keep their place at the end."""
    by = {name: (s, share) for name, s, share in figures}
    rank = {r.name: k for k, r in enumerate(rules)}
    return tuple(sorted(rules, key=lambda r: (r.name not in by, -by[r.name][1] / max(by[r.name][0], 1e-9) if r.name in by else 0, by.get(r.name, (0, 0))[0], rank[r.name])))


def cascade(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, signals: bool = False, keep: list[str] | None = None) -> DataFrame:
    """docs' columns (or those in ``keep``) with ``kept``, the cascade's verdict, over whole texts.

    ``signals`` adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of every row, computed after
    the verdict from the same views.
    """
    order = ordered(rules, measure(docs, text, rules))
    few, repeated = _rule(BASE_RULES[0], rules), _rule(BASE_RULES[1], rules)
    own = list(docs.columns) if keep is None else keep
    # A text that passes through is read where it stands, not sent twice.
    body = text if text in own and docs.schema[text].dataType == T.StringType() else free_name(docs, "body")
    names = [free_name(docs.select(*own), c) for c in (["kept"] + ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"] * signals)]
    extra = [] if body == text else [F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias(body)]
    wide = docs.select(*[F.col(f"`{c}`") for c in own], *extra)
    at = own.index(text) if body == text else len(own)
    types = ["boolean"] + ["long"] * 5 + ["boolean"]
    schema = docs.select(*[F.col(f"`{c}`") for c in own]).schema
    for name, kind in zip(names, types):
        schema = schema.add(name, kind)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k) for k in range(len(own))]
            out: list[list] = [[] for _ in names]
            for x in batch.column(at).cast(pa.binary()):
                view = View(x.as_py() or b"")
                out[0].append(not any(r.rejects(view) for r in order))
                if signals:
                    for k, v in enumerate((view.n_words, view.word_chars, view.n_symbols, view.n_dup_lines, view.n_repeat_words, few.rejects(view) or repeated.rejects(view))):
                        out[k + 1].append(v)
            made = [pa.array(v, pa.int64() if kind == "long" else pa.bool_()) for v, kind in zip(out, types)]
            yield pa.RecordBatch.from_arrays([*columns, *made], names=[*batch.schema.names[: len(own)], *names])

    return wide.mapInArrow(judged, schema)
