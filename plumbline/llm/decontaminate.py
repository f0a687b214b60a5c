"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' normalised tokens go into one automaton (a block of items at a time, see below). A training text streams through it:
at each token the automaton gives the length of the longest suffix that occurs in some item. A suffix of ``window`` tokens or
more is a hit on its last ``window`` tokens; an item of fewer tokens is hit where it occurs whole.

The items are read in blocks of at most ``BLOCK_WORDS`` words (a longer item stands alone), so what one broadcast holds is
bounded whatever the size of the benchmark; with several blocks every text streams through each, and the hits are united.

Defined results: null and empty texts and items have no words, hit nothing and are never contaminated; items that repeat under
one id count once; repeated documents are judged alike; empty tables give empty or clean results; other columns pass through,
and a result column that clashes gets leading underscores.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, stored

WINDOW = 10
#: Most words of items in one automaton: about 2 states a word, each some hundred bytes.
BLOCK_WORDS = 200_000
#: A text of which at least this share of words is hit goes as a whole.
MAX_COVERAGE = 0.8

#: ASCII letters in lower case and digits stay, other ASCII bytes separate words, bytes of other characters belong to words.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def normal_words(text: bytes | None) -> list[bytes]:
    return text.translate(NORMAL).split() if text else []


class Automaton:
    """A generalised suffix automaton over token ids, with the items that hold each state's strings."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.size = [0]
        #: States whose longest string is a whole item shorter than the window: its length and items.
        self.short: dict[int, list[str]] = {}
        walked = []
        for name, words in items:
            tokens = [self.ids.setdefault(w, len(self.ids)) for w in words]
            state = 0
            for t in tokens:
                state = self._extend(state, t)
            walked.append((name, tokens, state))
        # The items of a state: each item marks, from each of its prefixes up the links, what it has not marked yet.
        self.items: list[list[str] | None] = [None] * len(self.next)
        seen = [-1] * len(self.next)
        for n, (name, tokens, _) in enumerate(walked):
            state = 0
            for t in tokens:
                state = self.next[state][t]
                up = state
                while up > 0 and seen[up] != n and self.size[up] >= window:
                    seen[up] = n
                    if self.items[up] is None:
                        self.items[up] = []
                    self.items[up].append(name)
                    up = self.link[up]
            if 0 < len(tokens) < window:
                self.short.setdefault(state, []).append(name)
        #: The nearest state on the way up the links, itself included, that is in ``short``; 0 if none.
        self.short_up = [0] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.size.__getitem__):
            self.short_up[s] = s if s in self.short else self.short_up[self.link[s]]

    def _extend(self, last: int, t: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        if t in nxt[last]:
            q = nxt[last][t]
            return q if size[q] == size[last] + 1 else self._split(last, q, t)
        new = self._add({}, -1, size[last] + 1)
        p = last
        while p >= 0 and t not in nxt[p]:
            nxt[p][t] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = nxt[p][t]
            link[new] = q if size[q] == size[p] + 1 else self._split(p, q, t)
        return new

    def _add(self, to: dict[int, int], link: int, size: int) -> int:
        self.next.append(to)
        self.link.append(link)
        self.size.append(size)
        return len(self.next) - 1

    def _split(self, p: int, q: int, t: int) -> int:
        copy = self._add(dict(self.next[q]), self.link[q], self.size[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(t) == q:
            self.next[p][t] = copy
            p = self.link[p]
        return copy

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The hit word ranges (start, end exclusive; in order, disjoint, not touching) and the items that occur."""
        nxt, link, size, window, short_up = self.next, self.link, self.size, self.window, self.short_up
        ranges: list[list[int]] = []
        items: set[str] = set()
        any_short = bool(self.short)
        state = length = 0
        for i, t in enumerate(map(self.ids.get, words)):
            if t is None:
                state = length = 0
                continue
            step = nxt[state].get(t)
            if step is None:
                while state > 0 and step is None:
                    state = link[state]
                    step = nxt[state].get(t)
                length = size[state]
                if step is None:
                    length = 0
                    continue
            state = step
            length += 1
            width = 0
            if length >= window:
                width = window
                up = state
                while size[link[up]] >= window:
                    up = link[up]
                items.update(self.items[up])
            if any_short and (up := short_up[state] if size[state] == length or short_up[state] != state else short_up[link[state]]) > 0:
                width = max(width, size[up])
                while up > 0:
                    items.update(self.short[up])
                    up = short_up[link[up]]
            if width:
                start = i + 1 - width
                while ranges and ranges[-1][1] >= start:
                    start = min(start, ranges.pop()[0])
                ranges.append([start, i + 1])
        return [(a, b) for a, b in ranges], items


def blocks(items: DataFrame, item_id: str = "item_id", text: str = "text", most: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items with words, as (id as text, words), in blocks of at most ``most`` words; rows come to the driver one partition at a time."""
    block: list[tuple[str, list[bytes]]] = []
    held = 0
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(text).cast("binary").alias("t")).where("t is not null").distinct().orderBy("i", "t")
    for row in rows.toLocalIterator():
        words = normal_words(bytes(row["t"]))
        if not words:
            continue
        if block and held + len(words) > most:
            yield block
            block, held = [], 0
        block.append((row["i"], words))
        held += len(words)
    if block:
        yield block


_FOUND = "n_words long, hits array<struct<start:int,end:int>>, items array<string>"


def find(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs' columns (or ``keep``) with ``found``: n_words, the hit word ranges and the ids of occurring items, both in order."""
    spark = docs.sparkSession
    own = list(docs.columns) if keep is None else keep
    wide = docs.select(*[F.col(f"`{c}`") for c in own])
    out, body = free_name(wide, "found"), free_name(docs, "body")
    df = docs.select(*[F.col(f"`{c}`") for c in own], F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias(body))
    df = df.withColumn(out, F.lit(None).cast(f"struct<{_FOUND.replace(' long', ':bigint').replace(' array', ':array')}>"))
    schema = T.StructType([f for f in df.schema if f.name != body] + [df.schema[body]])
    df = df.select(*schema.names)
    cuts = 0
    for automaton in (Automaton(b, window) for b in blocks(items, item_id, item_text, block_words)):
        if cuts:
            df = stored(df, "hits")  # else one stage would hold several automata
        df = df.mapInArrow(_streamed(spark.sparkContext.broadcast(automaton), schema.names.index(out), len(schema) - 1), schema)
        cuts += 1
    if not cuts:
        df = df.mapInArrow(_streamed(spark.sparkContext.broadcast(Automaton([], window)), schema.names.index(out), len(schema) - 1), schema)
    return df.drop(body)


_FOUND_TYPE = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))])


def _streamed(shared, at: int, body: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            found = []
            for x, before in zip(batch.column(body), batch.column(at).to_pylist()):
                words = x.as_py().translate(NORMAL).split()
                ranges, names = automaton.hits(words)
                if before:
                    ranges = united([*ranges, *((h["start"], h["end"]) for h in before["hits"])])
                    names |= set(before["items"])
                found.append({"n_words": len(words), "hits": [{"start": a, "end": b} for a, b in ranges], "items": sorted(names, key=lambda s: s.encode())})
            columns = list(batch.columns)
            columns[at] = pa.array(found, _FOUND_TYPE)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


def united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """The text without the words in ``ranges`` and what stands between them; a line end marks each cut."""
    if not ranges:
        return text
    normal = text.translate(NORMAL)
    spans, at = [], 0
    for word in normal.split():
        at = normal.index(word, at)
        spans.append((at, at + len(word)))
        at += len(word)
    out, past = [], 0
    for a, b in ranges:
        out.append(text[past : spans[a][0]])
        past = spans[b - 1][1]
    out.append(text[past:])
    return b"\n".join(part for part in (x.strip(b" \t\r\n\v\f") for x in out) if part)


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_coverage: float = MAX_COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the hit spans, and without documents of which ``max_coverage`` or more of the words are hit.

    Removing a span can bring words together that form a window again, so what was cut is searched again until nothing hits.
    With one block of items this happens in one pass; with several, a pass over each block follows the others until none cuts.
    Untouched documents keep their text as it is; a null text stays null.
    """
    spark = docs.sparkSession
    at = docs.columns.index(text)
    gone = free_name(docs, "gone")
    n_words = free_name(docs.withColumn(gone, F.lit(0)), "words_before")
    df = docs.withColumn(gone, F.lit(0).cast("long")).withColumn(n_words, F.lit(None).cast("long"))
    schema = df.schema

    def cutting(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = shared.value
            for batch in batches:
                texts, cut, total = [], batch.column(len(schema) - 2).to_pylist(), batch.column(len(schema) - 1).to_pylist()
                for k, x in enumerate(batch.column(at)):
                    body = x.as_py()
                    raw = body.encode() if body is not None else b""
                    words = raw.translate(NORMAL).split()
                    if total[k] is None:
                        total[k] = len(words)
                    touched = False
                    while words and (ranges := automaton.hits(words)[0]):
                        touched = True
                        cut[k] += sum(b - a for a, b in ranges)
                        raw = without(raw, ranges)
                        words = raw.translate(NORMAL).split()
                    texts.append(raw.decode("utf-8", "replace") if touched else body)
                columns = list(batch.columns)
                columns[at] = pa.array(texts, batch.schema.field(at).type)
                columns[-2:] = [pa.array(cut, pa.int64()), pa.array(total, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        return run

    shared = [spark.sparkContext.broadcast(Automaton(b, window)) for b in blocks(items, item_id, item_text, block_words)]
    before = None
    while shared:
        for k, one in enumerate(shared):
            df = df.mapInArrow(cutting(one), schema)
            if len(shared) > 1:
                df = stored(df, "cut")
        if len(shared) == 1:
            break
        total = df.agg(F.sum(gone)).first()[0]
        if total == before or not total:
            break
        before = total
    words, lost = F.col(f"`{n_words}`"), F.col(f"`{gone}`")
    return df.where(lost.eqNullSafe(0) | (lost < max_coverage * words)).drop(gone, n_words)
