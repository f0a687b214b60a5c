"""LM scoring with Brown class-based n-grams: P(word | previous word) = P(class | previous class) * P(word | class).

Training counts every word and every pair of neighbours of every training document. All words of the training documents are put
into ``CLASSES`` classes by exchange clustering. First the ``CLUSTERED`` most frequent words: each in turn moves to the class that
raises the likelihood of the corpus most, until a pass moves few. Then the rest of the head, the ``HEAD`` most frequent words at
most, all at once in ``HEAD_PASSES`` passes over their contexts, each from no class at first. Then all other words, which begin
in one class of their own, in one pass over their contexts: classes, the end, or that class. Words of the head that stand beside
such words only go with them. Only words that training never saw have classes by ending, ``SHAPES`` of them. The end of a
document is a token in a class of its own, and the context of its first word. Transitions are counted over all pairs and smoothed
by ``ALPHA``; a class's emissions get one more count for each of its words and one for all unseen ones.

Texts are cut into words twice: to count them, and to store each text as the head's numbers with its rare words beside them; all
later steps read the stored numbers. Numbers lie in binary columns, a value for each text (see _binaries): Spark then moves texts,
not words, and lists of them are put together in Python, a partition at a time. Counts and classes of rare words don't fit anywhere at scale, so each document sends its
rare words, with the classes beside them, to a join, once: what comes back gives the transitions and then the scores. A rare word
has less than one in ``HEAD`` of all tokens, so none is hot.

Defined results: null and empty texts have one token, the end; a null id counts as the empty text in the split; repeated rows are
scored alike, each on its own; without training documents every count is 0 and scores stay finite (no words: all classes alike);
where words tie at the head's edge, all of them stay out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, stored

HELD_OUT = (7, 2)
CLUSTERED, CLASSES, SHAPES = 1000, 64, 32
HEAD = 1 << 17
ALPHA = 0.1
PASSES, FEW_MOVES = 6, 0.005
#: Passes in which the rest of the head moves, and words that move at once.
HEAD_PASSES, MOVED = 3, 512
#: Distinct words that a task counts before it sends them on.
HELD_WORDS = 400_000
#: Pairs of head words that a task holds before it sends them on; below 1 << 27 (see _contexts, which takes a HEAD of up to 1 << 17).
HELD_PAIRS = 1_500_000
#: Rows of one Arrow batch that a step sends, and texts whose numbers it takes at once.
SENT, TEXTS = 80_000, 512
#: Parts of the head's ids that move together to where contexts are put together, as a power of two.
SLICE_BITS, ID_BITS = 12, 17
#: A spot of a rare word: the classes before, of and after it (NONE after it: a rare word's, which has a spot of its own), its count.
SPOT, NONE = np.dtype([("before", "u1"), ("mine", "u1"), ("after", "u1"), ("n", "<u4")]), 255
#: The class in which rare words begin.
RARE = CLASSES + 1
#: The end of a document; no word has a space.
END = b" "


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % HELD_OUT[0] == HELD_OUT[1], F.lit(False))


def shape(word: bytes) -> int:
    """The shape class of a word that training never saw: by its last three bytes."""
    return zlib.crc32(word[-3:]) % SHAPES


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), held_out(F.col(f"`{doc_id}`")).alias("held_out"), body.alias("body"))


def _words(col: pa.BinaryArray) -> tuple[np.ndarray, pa.BinaryArray]:
    """How many words each text has, and all of them in order, ASCII letters in lower case."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(col.view(pa.string())))
    words, lengths = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(words), 0)  # white space at a text's edge leaves an empty one
    text = np.repeat(np.arange(len(lengths)), lengths)[full.to_numpy(zero_copy_only=False)]
    return np.bincount(text, minlength=len(lengths)), words.filter(full).view(pa.binary())


def _added(tables: list[pa.Table]) -> pa.Table:
    """Tables of (word, n) as one, each word once."""
    return pa.concat_tables(tables).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])


def count_words(rows: DataFrame) -> DataFrame:
    """(word, n) over training documents; counted in each task first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ends = [], 0, 0
        for batch in (piece for whole in batches for piece in pieces(whole, 0)):
            words = _words(batch.column(0))[1].value_counts()
            held.append(pa.table({"word": words.field(0), "n": words.field(1)}))
            size += len(words)
            ends += batch.num_rows
            if size > 2 * HELD_WORDS:
                held = [_added(held)]
                size = held[0].num_rows
                if size > HELD_WORDS:
                    yield from held[0].to_batches()
                    held, size = [], 0
        if ends:
            yield from _added([*held, pa.table({"word": pa.array([END], pa.binary()), "n": pa.array([ends], pa.int64())})]).to_batches()

    return rows.where("NOT held_out").select("body").mapInArrow(_lean(counted), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def exchange(pairs: dict[tuple[int, int], int] | np.ndarray, n_words: int, n_fixed: int, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """The class of each of n_words words, by exchange.

    ``pairs``: an array of (first, second, count) over ids; ids from n_words on are ``n_fixed`` tokens whose classes stay
    (classes, classes + 1, ...). Word k begins in class k mod classes. The quantity raised is
    sum N(c, d) log N(c, d) - sum N(c, .) log N(c, .) - sum N(., d) log N(., d).
    """
    first, second, count = (np.asarray(pairs, dtype=np.int64).reshape(-1, 3).T) if len(pairs) else np.zeros((3, 0), dtype=np.int64)
    total = classes + n_fixed
    of = np.concatenate([np.arange(n_words) % classes, classes + np.arange(n_fixed)])
    n = np.zeros((total, total))
    np.add.at(n, (of[first], of[second]), count)
    by_first, by_second = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    f_at, s_at = np.searchsorted(first[by_first], np.arange(n_words + 1)), np.searchsorted(second[by_second], np.arange(n_words + 1))

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1))

    for _ in range(passes):
        moved = 0
        for w in range(n_words):
            right, left = by_first[f_at[w] : f_at[w + 1]], by_second[s_at[w] : s_at[w + 1]]
            own = int(count[right][second[right] == w].sum())
            r = np.bincount(of[second[right]], count[right], total)
            l = np.bincount(of[first[left]], count[left], total)  # noqa: E741
            if not r.any() and not l.any():
                continue
            a = of[w]
            r[a] -= own
            l[a] -= own
            n[a] -= r
            n[:, a] -= l
            n[a, a] -= own
            rows, cols = n.sum(1), n.sum(0)
            out, into = r.sum() + own, l.sum() + own
            gain = (f(n + r) - f(n)).sum(1) + (f(n + l[:, None]) - f(n)).sum(0)
            d = np.diagonal(n)
            gain -= f(d + r) - f(d) + f(d + l) - f(d)
            gain += f(d + r + l + own) - f(d)
            rows, cols = rows + l, cols + r  # what stands before and after the word counts for its neighbours wherever it goes
            gain -= f(rows + out) - f(rows) + f(cols + into) - f(cols)
            b = int(np.argmax(gain[:classes]))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moved += b != a
            of[w] = b
            n[b] += r
            n[:, b] += l
            n[b, b] += own
        if moved <= FEW_MOVES * n_words:
            break
    return of[:n_words]


def moves(n: np.ndarray, of: np.ndarray, word: np.ndarray, ctx: np.ndarray, count: np.ndarray, own: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The best class of each word of a batch, with all others where they are; the step of ``exchange`` for many words at once.

    ``n`` counts class pairs, those that no word moves to (the end's, CLASSES, and perhaps RARE) last; ``of`` has the words' classes (-1: not in n yet). Entry e says that
    word[e] stands count[e] times before class ctx[e] // 2, or after it if ctx[e] is odd; own is how often a word follows itself.
    A word without contexts stays, or begins in ``start``.
    """
    size, total = len(of), len(n)
    right = ctx % 2 == 0
    to = ctx // 2

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1))

    sides = [np.bincount(word[s] * total + to[s], count[s], size * total).reshape(size, total) for s in (right, ~right)]
    known = of >= 0
    each, mine = np.arange(size)[known], of[known]
    rows, cols = np.tile(n.sum(1)[:CLASSES], (size, 1)), np.tile(n.sum(0)[:CLASSES], (size, 1))
    out, into = sides[0].sum(1) + own, sides[1].sum(1) + own
    rows[each, mine] -= out[known]
    cols[each, mine] -= into[known]
    gain = -(f(rows + out[:, None]) - f(rows) + f(cols + into[:, None]) - f(cols))
    for side, other, table in ((sides[0], sides[1], n), (sides[1], sides[0], n.T)):
        w, d = np.nonzero(side)
        k = side[w, d]
        at = table[:CLASSES, d].T.copy()
        is_known = of[w] >= 0
        e = np.flatnonzero(is_known)
        at[e, of[w[e]]] -= k[e]
        e = np.flatnonzero(is_known & (d == of[w]))
        at[e] -= other[w[e], :CLASSES]
        at[e, of[w[e]]] -= own[w[e]]
        change = f(at + k[:, None]) - f(at)
        begins = np.flatnonzero(np.diff(w, prepend=-1))
        if len(begins):
            gain[w[begins]] += np.add.reduceat(change, begins, axis=0)
    r, l = (x[:, :CLASSES] for x in sides)  # noqa: E741
    diagonal = np.tile(np.diagonal(n)[:CLASSES], (size, 1))
    diagonal[each, mine] -= r[each, mine] + l[each, mine] + own[known]
    gain -= f(diagonal + r) + f(diagonal + l) - f(diagonal) - f(diagonal + r + l + own[:, None])
    best = np.argmax(gain, axis=1)
    best[each] = np.where(gain[each, best[known]] > gain[each, mine] + 1e-9, best[known], mine)
    lone = out + into == 0
    return np.where(lone, np.where(known, of, start), best)


@dataclass
class Model:
    """What scoring a document needs besides the counts and classes of rare words; of fixed size."""

    head: dict[bytes, int]
    #: Of each head word, the end last: log10(count + 1) and class.
    logs: np.ndarray
    classes: np.ndarray
    #: The same, but -1 for words that are scored as rare ones are.
    known: np.ndarray
    #: log10 P(class | previous class), and log10 of the emissions' denominators.
    steps: np.ndarray
    below: np.ndarray
    train_tokens: int
    vocabulary: int


def _lean(step):
    """step, which gives back the memory that Arrow holds in reserve when it ends: workers live on for other tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        pa.default_memory_pool().release_unused()

    return run


def _binaries(values: np.ndarray, ends: np.ndarray) -> pa.BinaryArray:
    """The bytes of values, cut at ``ends`` (which begin with 0)."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _values(col: pa.BinaryArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """How many values each row of _binaries has, and all of them in order."""
    kind = np.dtype(kind)
    ends = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int32)
    data = col.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.diff(ends) // kind.itemsize, flat.view(kind)


def _halves(values: np.ndarray, ends: np.ndarray) -> list[pa.BinaryArray]:
    """Whole numbers below 1 << 48 as two columns; the second is nearly all zeros, and so takes no room in Parquet."""
    return [_binaries(part, ends) for part in ((values & 0xFFFF).astype("<u2"), (values >> 16).astype("<u4"))]


def _whole(low: pa.BinaryArray, high: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    lengths, low_ = _values(low, "<u2")
    return lengths, low_.astype(np.int64) | _values(high, "<u4")[1].astype(np.int64) << 16


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


def _fed(df: DataFrame, f, schema: str) -> DataFrame:
    """f over slices of df's batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, MOVED):
                yield f(batch.slice(at, MOVED))

    return df.mapInArrow(_lean(run), schema)


def _summed(df: DataFrame, add, size: int, sliced: bool = False) -> np.ndarray:
    """The sum over df's batches of add(batch), (places, counts), as an array of size; tasks add up first. ``sliced``: a few texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size)
        for batch in _sliced(batches) if sliced else batches:
            places, counts = add(batch)
            held += np.bincount(places, counts, size)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at].astype(np.int64))], names=["at", "n"])

    got = df.mapInArrow(_lean(run), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size)
    out[got["at"].to_numpy()] = got["n"].to_numpy()
    return out


def _edge(counts: DataFrame, vocabulary: int) -> int:
    """The least count with which HEAD words or fewer are in the head; found by histograms, not by sorting."""
    if vocabulary <= HEAD:
        return 1
    words = counts.where(F.col("word") != END).select("n")

    def fill(cells: DataFrame, room: int) -> tuple[int, int]:
        """The first cell, from the top, that no longer fits, and the room before it."""
        for r in cells.groupBy("cell").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("cell")).collect():
            if r["k"] > room:
                return r["cell"], room
            room -= r["k"]
        return -1, room

    octave, room = fill(words.select(F.floor(F.log2("n")).cast("int").alias("cell")), HEAD)
    if octave < 0:
        return 1
    low = 1 << octave
    step = max(1, low >> 12)
    cell, _ = fill(words.where((F.col("n") >= low) & (F.col("n") < 2 * low)).select(F.floor((F.col("n") - low) / step).cast("int").alias("cell")), room)
    return low + (cell + 1) * step


def fit(rows: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and (word, n, class) of all training words that are scored as rare, as a stored table."""
    return _learnt(rows)[:2]


def _learnt(rows: DataFrame) -> tuple[Model, DataFrame, DataFrame, DataFrame]:
    """What ``fit`` returns, with the stored tokens (see _tokens) and the places of rare words (see _resolved)."""
    spark = rows.sparkSession
    counts = stored(count_words(rows), "lm-counts")
    total, vocabulary = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.where((F.col("word") != END) & (F.col("n") >= _edge(counts, vocabulary))).toArrow()
    ranked = sorted(zip(top["n"].to_pylist(), top["word"].to_pylist()), key=lambda x: (-x[0], x[1]))
    words, often = [w for _, w in ranked], np.array([n for n, _ in ranked], dtype=np.int64)
    head = {w: k for k, w in enumerate(words)}
    ends = int(counts.where(F.col("word") == END).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    n_head, n_words, n_all = len(words), min(len(words), CLUSTERED), CLASSES + 1
    width = n_head + 1
    tokens = stored(_tokens(rows, spark.sparkContext.broadcast(head)), "lm-tokens")
    train = tokens.where("NOT held_out")
    pairs = stored(_bigrams(train, n_head), "lm-bigrams")

    # The most frequent words: exchange one by one, with the others in classes by ending.
    start = np.concatenate([np.arange(n_words), [n_words + shape(w) for w in words[n_words:]], [n_words + SHAPES]]).astype(np.int64)
    few = n_words + SHAPES + 1

    def codes(ids: np.ndarray, wide: int):
        shared = spark.sparkContext.broadcast(ids)

        def add(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            code, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            a, b = shared.value[code // width], shared.value[code % width]
            on = (a >= 0) & (b >= 0)
            return a[on] * wide + b[on], n[on]

        return add

    held = _summed(pairs, codes(start, few), few * few)
    at = np.flatnonzero(held)
    of = np.full(width, -1, dtype=np.int64)
    of[:n_words] = exchange(np.stack([at // few, at % few, held[at]], axis=1).astype(np.int64), n_words, SHAPES + 1)
    of[-1] = CLASSES

    # The rest of the head: all words move at once, the first time from no class.
    contexts = stored(_contexts(pairs, width, n_words, True), "lm-contexts")
    for _ in range(HEAD_PASSES):
        now_counts = _summed(pairs, codes(of, n_all), n_all * n_all).reshape(n_all, n_all)
        shared = spark.sparkContext.broadcast((now_counts, of.copy()))

        def moved(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, now = shared.value
            ids = batch.column(0).to_numpy().astype(np.int64)
            lengths, ctx = _whole(batch.column(1), batch.column(2))
            word, count = np.repeat(np.arange(len(ids)), lengths), _whole(batch.column(3), batch.column(4))[1]
            itself = ctx // 2 == ids[word]
            own = np.bincount(word[itself & (ctx % 2 == 0)], count[itself & (ctx % 2 == 0)], len(ids))
            on = ~itself & (now[ctx // 2] >= 0)
            best = moves(n, now[ids], word[on], now[ctx[on] // 2] * 2 + ctx[on] % 2, count[on], own, ids % CLASSES)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(best)], names=["id", "class"])

        got = _fed(contexts, moved, "id long, class long").toArrow()
        changed = int((of[got["id"].to_numpy()] != got["class"].to_numpy()).sum())
        of[got["id"].to_numpy()] = got["class"].to_numpy()
        if changed <= FEW_MOVES * n_head:
            break

    # All other words.
    known = spark.sparkContext.broadcast((of, {int(k): words[k] for k in np.flatnonzero(of < 0)}))
    size = RARE + 1

    def sides(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        seq = _sequence(batch.column(0), batch.column(1), known.value[0])[0]
        seq = np.where(seq < 0, RARE, seq)
        return seq[:-1] * size + seq[1:], np.ones(len(seq) - 1)

    seen = _summed(train.select("low", "high"), sides, size * size, True).reshape(size, size)
    rare = stored(_rare_classes(_spots(train, known), seen), "lm-rare")
    n_classes = CLASSES + SHAPES + 1
    spots = stored(_resolved(_spots(tokens, known), rare, n_classes - 1), "lm-spots")
    place = np.append(np.arange(CLASSES), n_classes - 1)

    def steps_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        _, before, after, mine, _ = _runs(batch.column(0))
        out = np.concatenate([before * n_classes + mine, mine[after >= 0] * n_classes + after[after >= 0]])
        return out, np.ones(len(out))

    step = _summed(spots.where("NOT held_out").select("spots"), steps_of, n_classes * n_classes, True).reshape(n_classes, n_classes)
    step[np.ix_(place, place)] += seen[:n_all, :n_all]
    steps = np.log10((step + ALPHA) / (step.sum(1, keepdims=True) + ALPHA * n_classes))
    scored = np.append(place, -1)[of]  # -1 stays
    on = scored >= 0
    mass, types = np.bincount(scored[on], np.append(often, ends)[on], n_classes), np.bincount(scored[on], minlength=n_classes)
    for r in rare.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect():
        mass[r["class"]] += r["n"]
        types[r["class"]] += r["types"]
    classes = scored.copy()
    if not on.all():
        late = spark.createDataFrame([(words[k],) for k in np.flatnonzero(~on)], "late binary")
        for r in rare.join(F.broadcast(late), F.col("word") == F.col("late")).select("word", "class").collect():
            classes[head[bytes(r["word"])]] = r["class"]
    logs = np.log10(np.append(often, ends).astype(float) + 1)
    return Model(head, logs, classes, scored, steps, np.log10(mass + types + 1), int(total), int(vocabulary)), rare, tokens, spots


def _tokens(rows: DataFrame, head) -> DataFrame:
    """(row, doc_id, held_out, low, high, rare) of each row: one more than its words' numbers in the head, halved, 0 for others, which ``rare`` has in order with spaces between."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = head.value.get
        for batch in (piece for whole in batches for piece in pieces(whole, 3)):
            lengths, words = _words(batch.column(3))
            coded = words.dictionary_encode()
            # Each distinct word is looked up once.
            number = np.fromiter(map(get, coded.dictionary.to_numpy(zero_copy_only=False), repeat(-1)), np.int32, len(coded.dictionary))
            ids = number[coded.indices.to_numpy(zero_copy_only=False)]
            rare = ids < 0
            n_rare = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[rare], minlength=len(lengths))
            ends, rare_ends = (np.concatenate([[0], np.cumsum(n)]) for n in (lengths, n_rare))
            others = pa.ListArray.from_arrays(pa.array(rare_ends, pa.int32()), words.filter(pa.array(rare)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *_halves(ids.astype(np.int64) + 1, ends), pc.binary_join(others, END)], names=["row", "doc_id", "held_out", "low", "high", "rare"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "body")
    return numbered.mapInArrow(_lean(cut), f"row long, doc_id {id_type}, held_out boolean, low binary, high binary, rare binary")


def _sequence(low: pa.BinaryArray, high: pa.BinaryArray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A batch's texts as one sequence of ``of`` of each word, the end's (of's last) before, between and after them; -1 for rare words.

    Also the places of the words in it, the text to which each place but the first belongs, and the words' numbers.
    """
    lengths, flat = _whole(low, high)
    flat -= 1
    text = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(flat)) + text + 1
    seq = np.full(len(flat) + len(lengths) + 1, of[-1], dtype=np.int64)
    seq[at] = np.where(flat < 0, -1, of[flat])
    return seq, at, np.repeat(np.arange(len(lengths)), lengths + 1), flat


def _contexts(pairs: DataFrame, width: int, first: int, halved: bool = False) -> DataFrame:
    """(id, xs) of the head words from id ``first`` on, xs being a list of (ctx, n) over the ids beside them; ``halved``: as _halves of both.

    An id, a ctx and a count share one long on the way to the partition of the id's slice, which then holds all of the id's entries.
    """
    rest = ID_BITS - SLICE_BITS

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            e = np.sort(np.concatenate(held))
            held, size = [], 0
            slices = e >> 46 + rest
            begins = np.flatnonzero(np.diff(slices, prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array(slices[begins], pa.int32()), _binaries(e, np.append(begins, len(e)))], names=["slice", "e"])

        for batch in batches:
            code, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            a, b = code // width, code % width
            for x, ctx in ((a, b * 2), (b, a * 2 + 1)):
                on = (x >= first) & (x < width - 1)
                # The slice comes first, so that sorting puts it together.
                x = (x & ((1 << SLICE_BITS) - 1)) << rest | x >> SLICE_BITS
                held.append(x[on] << 46 | ctx[on] << 27 | n[on])
                size += len(held[-1])
            if size > HELD_PAIRS:
                yield from sent()
        if size:
            yield from sent()

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_values(batch.column(1), np.int64)[1] for batch in batches]
        if not held:
            return
        e = np.concatenate(held)
        held.clear()
        e.sort()
        key = e >> 27
        at = np.flatnonzero(np.diff(key, prepend=-1))
        n, key = np.add.reduceat(e & ((1 << 27) - 1), at), key[at]
        ids = key >> 19
        begins = np.append(np.flatnonzero(np.diff(ids, prepend=-1)), len(ids))
        ids = (ids & ((1 << rest) - 1)) << SLICE_BITS | ids >> rest
        for k in range(0, len(begins) - 1, MOVED):
            part = begins[k : k + MOVED + 1]
            ctx, count, ends = key[part[0] : part[-1]] & ((1 << 19) - 1), n[part[0] : part[-1]], part - part[0]
            if halved:
                yield pa.RecordBatch.from_arrays([pa.array(ids[part[:-1]]), *_halves(ctx, ends), *_halves(count, ends)], names=["id", "low", "high", "n_low", "n_high"])
            else:
                entries = pa.StructArray.from_arrays([pa.array(ctx, pa.int32()), pa.array(count)], names=["ctx", "n"])
                yield pa.RecordBatch.from_arrays([pa.array(ids[part[:-1]]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)], names=["id", "xs"])

    rows = pairs.mapInArrow(_lean(turned), "slice int, e binary")
    return rows.repartition("slice").mapInArrow(_lean(grouped), "id long, low binary, high binary, n_low binary, n_high binary" if halved else "id long, xs array<struct<ctx:int,n:long>>")


def _bigrams(train: DataFrame, n_head: int) -> DataFrame:
    """(code, n): how often two head words stand together, first * (n_head + 1) + second, the end being n_head.

    Tasks have added up what they held; the same pair can occur again.
    """
    width = n_head + 1

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            code, n = np.unique(np.concatenate(held), return_counts=True)
            held, size = [], 0
            for at in range(0, len(code), SENT):
                part = slice(at, at + SENT)
                yield pa.RecordBatch.from_arrays([pa.array(code[part]), pa.array(n[part], pa.int64())], names=["code", "n"])

        ids = np.arange(width)
        for batch in _sliced(batches):
            seq = _sequence(batch.column(0), batch.column(1), ids)[0]
            on = (seq[:-1] >= 0) & (seq[1:] >= 0)
            held.append(seq[:-1][on] * width + seq[1:][on])
            size += len(held[-1])
            if size > HELD_PAIRS:
                yield from sent()
        if held:
            yield from sent()

    return train.select("low", "high").mapInArrow(_lean(counted), "code long, n long")


def _spots(tokens: DataFrame, known) -> DataFrame:
    """(row, held_out, pos, before, after, word) of each rare word: its place in the text and the classes beside it, -1 if rare.

    ``known`` has the classes of the head's words and the end, and the words of those without one, which count as rare.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, open_ = known.value
        extra, place = pa.array(list(open_.values()), pa.binary()), np.zeros(len(of), dtype=np.int64)
        place[list(open_)] = np.arange(len(open_))
        for batch in _sliced(batches):
            seq, at, text, flat = _sequence(batch.column(2), batch.column(3), of)
            hole = np.flatnonzero(seq[at] < 0)
            rare = _words(batch.column(4))[1]
            number = np.where(flat[hole] < 0, np.cumsum(flat[hole] < 0) - 1, len(rare) + place[flat[hole]])
            words = pa.concat_arrays([rare, extra]) if len(extra) else rare
            begins = np.searchsorted(text[at - 1], np.arange(batch.num_rows))
            for k in range(0, len(hole), SENT):
                h = hole[k : k + SENT]
                doc = text[at[h] - 1]
                spot = (h - begins[doc], seq[at[h] - 1], seq[at[h] + 1])
                row = pa.array(doc)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *[pa.array(x, pa.int32()) for x in spot], words.take(pa.array(number[k : k + SENT]))], names=["row", "held_out", "pos", "before", "after", "word"])

    return tokens.select("row", "held_out", "low", "high", "rare").mapInArrow(_lean(found), "row long, held_out boolean, pos int, before int, after int, word binary")


def _rare_classes(spots: DataFrame, seen: np.ndarray) -> DataFrame:
    """(word, n, class) of all rare words: each moves from RARE to its best class, all at once."""
    wide = RARE + 1
    shared = spots.sparkSession.sparkContext.broadcast(seen)
    code = ((F.col("before") + 1) * wide + F.col("after") + 1).cast("int").alias("code")
    def best(word: np.ndarray, code: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
        before, after = code // wide - 1, code % wide - 1
        ctx = np.concatenate([np.where(before < 0, RARE, before) * 2 + 1, np.where(after < 0, RARE, after) * 2]).astype(np.int64)
        none = np.full(size, -1)
        return moves(shared.value, none, np.concatenate([word, word]), ctx, np.concatenate([count, count]), np.zeros(size), none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches, schema).combine_chunks()
        if not held.num_rows:
            return
        coded = held["word"].chunk(0).dictionary_encode()
        key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * (wide * wide) + held["code"].to_numpy()
        words = coded.dictionary
        del held, coded
        key, count = np.unique(key, return_counts=True)
        word, code = key // (wide * wide), key % (wide * wide)
        total = np.bincount(word, count, len(words)).astype(np.int64)
        out = np.zeros(len(words), dtype=np.int64)
        # Words that occur once: their class rests on their place only.
        once = (total == 1)[word]
        new, which = np.unique(code[once], return_inverse=True)
        for at in range(0, len(new), MOVED):
            part = new[at : at + MOVED]
            new[at : at + MOVED] = best(np.arange(len(part)), part, np.ones(len(part)), len(part))
        out[word[once]] = new[which]
        word, code, count = word[~once], code[~once], count[~once]
        several = np.flatnonzero(total > 1)
        for at in range(0, len(several), MOVED):
            part = several[at : at + MOVED]
            mine = slice(*np.searchsorted(word, (part[0], part[-1] + 1)))
            out[part] = best(np.searchsorted(part, word[mine]), code[mine], count[mine], len(part))
        for at in range(0, len(words), SENT):
            part = slice(at, at + SENT)
            yield pa.RecordBatch.from_arrays([words[part], pa.array(total[part]), pa.array(out[part])], names=["word", "n", "class"])

    # A word's places are all in its partition, and no rare word has many.
    schema = pa.schema([("word", pa.binary()), ("code", pa.int32())])
    return spots.select("word", code).repartition("word").mapInArrow(_lean(run), "word binary, n long, class long")


def _resolved(spots: DataFrame, rare: DataFrame, end: int) -> DataFrame:
    """(row, held_out, spots) of each text with rare words: SPOTs in order; ``end`` is the end's class."""
    unseen = CLASSES + F.expr(f"crc32(substring(word, greatest(1, length(word) - 2), 3)) % {SHAPES}")  # shape() of the word
    fields = ("row", "held_out", "pos", "before", "after")
    found = spots.join(rare, "word", "left").select(*fields, F.coalesce(F.col("class"), unseen).cast("int").alias("class"), F.coalesce("n", F.lit(0)).alias("n"))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[batch.column(k).to_numpy(zero_copy_only=False) for k in range(7)] for batch in batches if batch.num_rows]
        if not held:
            return
        row, out, pos, before, after, mine, n = (np.concatenate(x) for x in zip(*held))
        held.clear()
        if n.max() > np.iinfo("u4").max:
            raise OverflowError("a rare word's count has more than 32 bits")
        order = np.lexsort((pos, row))
        row, out = row[order], out[order]
        all_ = np.empty(len(order), SPOT)
        all_["mine"], all_["n"] = mine[order], n[order]
        before, after = np.where(before == CLASSES, end, before)[order], np.where(after == CLASSES, end, after)[order]
        # Before a spot of -1 is the spot ahead of it.
        all_["before"], all_["after"] = np.where(before < 0, np.concatenate([[0], all_["mine"][:-1]]), before), np.where(after < 0, NONE, after)
        begins = np.append(np.flatnonzero(np.diff(row, prepend=-1)), len(row))
        for k in range(0, len(begins) - 1, TEXTS):
            part = begins[k : k + TEXTS + 1]
            yield pa.RecordBatch.from_arrays([pa.array(row[part[:-1]]), pa.array(out[part[:-1]]), _binaries(all_[part[0] : part[-1]], part - part[0])], names=["row", "held_out", "spots"])

    return found.repartition("row").mapInArrow(_lean(together), "row long, held_out boolean, spots binary")


def _runs(spots: pa.BinaryArray) -> tuple[np.ndarray, ...]:
    """(text, before, after, class, n) of each spot in order; ``after`` is -1 where a spot follows."""
    lengths, flat = _values(spots, SPOT)
    before, after, mine, n = (flat[k].astype(np.int64) for k in ("before", "after", "mine", "n"))
    return np.repeat(np.arange(len(lengths)), lengths), before, np.where(after == NONE, -1, after), mine, n


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of each row of docs."""
    rows = _rows(docs, doc_id, text)
    model, _, tokens, spots = _learnt(rows)
    shared = rows.sparkSession.sparkContext.broadcast((model.known, model.logs, model.steps, model.below))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs, steps, below = shared.value
        for batch in _sliced(batches):
            size = batch.num_rows
            seq, at, text, flat = _sequence(batch.column(3), batch.column(4), known)
            gain = np.full(len(seq), logs[-1])
            gain[at] = np.where(flat < 0, 0, logs[flat])
            right, left = seq[1:], seq[:-1]
            on = right >= 0
            both = on & (left >= 0)
            sums = [np.bincount(text, minlength=size), np.bincount(text[on], gain[1:][on] > 0, size), np.bincount(text[on], gain[1:][on], size), np.bincount(text[both], steps[left[both], right[both]], size), np.bincount(text[on], below[right[on]], size)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *[pa.array(x.astype(float)) for x in sums]], names=["row", "doc_id", "held_out", *_SUMS])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, steps, below = shared.value
        for batch in _sliced(batches):
            doc, before, after, of, n = _runs(batch.column(1))
            step = steps[before, of] + np.where(after >= 0, steps[of, after], 0)
            sums = [np.bincount(doc, x, batch.num_rows) for x in (n > 0, np.log10(n + 1.0), step, below[of])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.float64()) for x in sums]], names=["r_row", *[f"r_{c}" for c in _SUMS[1:]]])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    mine = tokens.select("row", "doc_id", "held_out", "low", "high").mapInArrow(_lean(scored), f"row long, doc_id {id_type}, held_out boolean, " + ", ".join(f"{c} double" for c in _SUMS))
    theirs = spots.select("row", "spots").mapInArrow(_lean(added), "r_row long, " + ", ".join(f"r_{c} double" for c in _SUMS[1:]))
    joined = mine.join(theirs, F.col("row") == F.col("r_row"), "left")
    one = joined.select("doc_id", "held_out", F.col("n_tokens").cast("bigint").alias("n"), *[(F.col(c) + F.coalesce(f"r_{c}", F.lit(0.0))).alias(c) for c in _SUMS[1:]])
    width = float(np.log10(model.train_tokens + model.vocabulary + 1))
    total = F.col("steps") + F.col("logs") - F.col("below")
    return one.select(
        "doc_id",
        "held_out",
        F.col("n").alias("n_tokens"),
        F.col("n_known").cast("bigint").alias("n_known"),
        F.lit(model.train_tokens).cast("bigint").alias("train_tokens"),
        (F.col("logs") - F.col("n") * width).alias("base_score"),
        total.alias("score"),
        F.pow(F.lit(10.0), -total / F.col("n")).alias("perplexity"),
    )


#: What a text's score is made of, as sums over its tokens.
_SUMS = ("n_tokens", "n_known", "logs", "steps", "below")
