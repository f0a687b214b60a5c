"""The operators against brute force, on the small tables and on rows made to be awkward."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import chat, classlm, common, decontaminate, extract, linededup, mixing, neardup, quality, queries, secrets, warc
from plumbline.llm.common import shared_dir, table

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
A = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
ODD = [
    (1, A, "en", "s", 1), (1, A, "en", "s", 1), (2, A.upper(), "en", "s", 1), (3, None, None, None, None), (4, "", "en", "t", 0), (5, "\n \t\n", "en", "t", 3),
    (6, "é" * 50 + " token = 'abcdef123456' " + "ab12" * 8, "fr", "s", 9), (None, A + " more words here", "en", None, 5), (7, ("w " * 5000).strip(), "en", "t", 2), (8, A.replace("ten", "TEN x"), "en", "s", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, D, "documents")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().lower().split()


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_quality_signals(spark, docs, odd, empty):
    got = rows(queries.op9_quality_rules(spark, D))
    for r in docs.collect():
        w = (r.text or "").encode().split()
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        seen = collections.Counter(grams)
        hit = {i + j for i, g in enumerate(grams) if seen[g] > 1 for j in range(8)}
        lines = [x for x in (r.text or "").split("\n") if x.encode().strip()]
        n = got[r.doc_id]
        base = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        assert (n.n_words, n.n_repeat_words, n.n_dup_lines, n.base_failed) == (len(w), len(hit), len(lines) - len(set(lines)), base)
        assert n.word_chars == sum(len(x.decode()) for x in w) and n.n_symbols == sum(c in "#*$%&|<>" for c in r.text or "")
        assert not (base and n.kept)
    assert quality.cascade(odd.withColumn("kept", F.lit(0)), signals=True).count() == len(ODD)
    assert quality.cascade(empty).count() == 0


def test_cascade_order():
    order = quality.ordered(quality.RULES, [("few_words", 1.0, 0.1), ("many_symbols", 0.1, 0.1), ("repeated_windows", 1.0, 0.0)])
    assert [r.name for r in order][:3] == ["many_symbols", "few_words", "repeated_windows"]


def test_automaton():
    rng = random.Random(3)
    for _ in range(300):
        w = rng.choice([2, 3, 4])
        letters = [b"a", b"b", b"c"][: rng.choice([2, 3])]
        items = [(str(k), [rng.choice(letters) for _ in range(rng.randint(0, 7))]) for k in range(rng.randint(0, 4))]
        doc = [rng.choice([*letters, b"z"]) for _ in range(rng.randint(0, 25))]
        hit, names = set(), set()
        for name, it in items:
            for g in {tuple(it)} if 0 < len(it) < w else {tuple(it[i : i + w]) for i in range(len(it) - w + 1)}:
                for i in range(len(doc) - len(g) + 1):
                    if g and tuple(doc[i : i + len(g)]) == g:
                        names.add(name)
                        hit.update(range(i, i + len(g)))
        ranges, got = decontaminate.Automaton(items, w).hits(doc)
        assert {j for a, b in ranges for j in range(a, b)} == hit and got == names


def test_decontamination(spark, docs, odd, empty):
    items = table(spark, D, "benchmark")
    whole = rows(queries.op3_decontamination(spark, D))
    assert sum(r.contaminated for r in whole.values()) > 0
    parts = decontaminate.find(docs, items, keep=["doc_id"], block_words=200)
    assert {r.doc_id: len(r.found["items"]) for r in parts.collect()} == {k: r.n_items for k, r in whole.items()}
    cleaned = decontaminate.clean(docs, items)
    assert decontaminate.find(cleaned, items, keep=["doc_id"]).where("size(found.hits) > 0").count() == 0
    clean_ids = {k for k, r in whole.items() if not r.contaminated}
    before = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text == before[r.doc_id] for r in cleaned.collect() if r.doc_id in clean_ids)
    assert clean_ids <= {r.doc_id for r in cleaned.collect()}
    assert decontaminate.clean(odd, items.limit(0)).count() == len(ODD) and decontaminate.clean(empty, items).count() == 0


def test_line_dedup(spark, docs, odd, empty):
    got = rows(linededup.dedup_lines(docs))
    index, sets = collections.defaultdict(list), []
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        kept = []
        for line in r.text.split("\n"):
            s = frozenset(re.findall(r"[^\x20\x09-\x0D]+", line.lower()))
            met = collections.Counter(k for w in s for k in index[w])
            if not s or not any(10 * n >= 9 * (len(s) + len(sets[k]) - n) for k, n in met.items()):
                kept.append(line)
            if s:
                for w in s:
                    index[w].append(len(sets))
                sets.append(s)
        assert got[r.doc_id].text == "\n".join(kept)
    out = linededup.dedup_lines(odd.withColumn("removed_lines", F.lit(1)))
    assert out.count() == len(ODD) and {r.text for r in out.where("doc_id = 3").collect()} == {None}
    assert linededup.dedup_lines(empty).count() == 0


def test_line_dedup_computes_words_once(spark, docs):
    plan = linededup.prefixes(docs, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    # Neither the words' hashes, nor the cut into lines, nor the table of ranks stands in a filter too.
    assert plan.count("array_distinct(") == 1 and plan.count("split(text") == 1 and len(plan) < 2_000_000
    blank = spark.createDataFrame([(1, " \t\x0b\n\r\x0c\na b\n\u00a0\n\n\t\u00a0 "), (2, "A\tb\n "), (3, None)], "doc_id long, text string")
    got = rows(linededup.dedup_lines(blank))
    assert got[1].text == " \t\x0b\n\r\x0c\na b\n\u00a0\n" and got[1].removed_lines == 1
    assert got[2].text == " " and got[2].removed_lines == 1 and got[3].text is None


def test_line_dedup_sorts_longs(spark):
    texts = [(1, "b  a b\n\tC a\x0b\x0bb \n c  B a \na\n  \t"), (2, "x"), (3, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    out = linededup.prefixes(df, "doc_id", "text")
    assert not out.schema["prefix"].dataType.containsNull
    got = {(r.doc, r.line): r for r in out.collect()}
    assert {k: r.n for k, r in got.items()} == {(1, 0): 2, (1, 1): 3, (1, 2): 3, (1, 3): 1, (2, 0): 1}
    assert (got[1, 1].h1, got[1, 1].h2, got[1, 1].parity) == (got[1, 2].h1, got[1, 2].h2, got[1, 2].parity)
    assert all(r.prefix == sorted(r.prefix) and len(set(r.prefix)) == len(r.prefix) for r in got.values())


def test_line_dedup_verifies_pairs_once(spark, docs, monkeypatch):
    plans, stored = [], linededup.stored
    monkeypatch.setattr(linededup, "stored", lambda df, what: plans.append((what, df._jdf.queryExecution().optimizedPlan().toString())) or stored(df, what))
    linededup.dedup_lines(docs)
    # Late pairs are verified where their matches are stored, and nowhere else; the filter names the intersection once.
    assert [(what, plan.count("array_intersect(")) for what, plan in plans if what != "line-matches" and "array_intersect(" in plan] == [("line-gone", 1)]


def test_line_dedup_cuts_words_once_for_counts_and_keys(spark, docs, monkeypatch):
    plans, rarity, before = [], linededup.rarity, len(spark.sparkContext._jsc.getPersistentRDDs())
    monkeypatch.setattr(linededup, "rarity", lambda df, *more: plans.append(df._jdf.queryExecution().withCachedData().toString()) or rarity(df, *more))
    whole = linededup.dedup_lines(docs).collect()
    # Counts come from the kept hashes, and nothing that was kept on the way stays.
    assert len(plans) == 1 and plans[0].startswith("InMemoryRelation") and len(spark.sparkContext._jsc.getPersistentRDDs()) == before
    monkeypatch.setattr(linededup, "HOT", 2)
    assert sorted(map(str, linededup.dedup_lines(docs).collect())) == sorted(map(str, whole))


def test_near_dup_signatures_take_little_memory(spark, monkeypatch):
    found = []

    class Rows:
        def select(self, *columns):
            return self

        def mapInArrow(self, f, schema):
            found.append(f)

    monkeypatch.setattr(common, "_TABLES", [])
    neardup.signatures(Rows())
    texts = [" ".join(f"w{k}x{j}" for j in range(4000)) for k in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array([t.encode() for t in texts], pa.binary())], names=["doc_id", "body"])
    tracemalloc.start()
    try:
        n = sum(len(b) for b in found[0](iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 200 and peak < 40 << 20


def shingled(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_dup(spark, docs, odd, empty):
    got = rows(queries.op5_near_dup(spark, D))
    ids = sorted(got)
    sets = {r.doc_id: shingled(r.text) for r in docs.collect()}
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    assert {i: (len(sets[i]), find(i), find(i) == i) for i in ids} == {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()}
    out = neardup.link(odd).collect()
    assert len(out) == len(ODD) and {r.component_id for r in out if r.doc_id in (1, 2)} == {1}
    assert neardup.link(empty).count() == 0


def test_class_lm(spark, docs, odd, empty):
    got = rows(queries.op2_class_lm(spark, D))
    counts = collections.Counter()
    for r in docs.collect():
        if zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            counts.update([*words(r.text), b" "])
    n, v = sum(counts.values()), len(counts)
    base = better = 0.0
    for r in docs.collect():
        w = [*words(r.text), b" "]
        g = got[r.doc_id]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert math.isclose(g.base_score, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        if g.held_out:
            base, better = base + g.base_score, better + g.score
    assert better > base
    assert classlm.score(odd).count() == len(ODD) and classlm.score(empty).count() == 0


def test_class_lm_words():
    texts = [b"", b" A b\ta\x0b\x0c\r\nB ", b"\n", "É é\u00a0x\u2028y \x1c".encode(), b"a", b"  end"]
    for part in (pa.array(texts, pa.binary()), pa.array([b"before", *texts, b"after"], pa.binary()).slice(1, len(texts))):
        lengths, got = classlm._words(part)
        assert lengths.tolist() == [len(t.lower().split()) for t in texts] and got.to_pylist() == [w for t in texts for w in t.lower().split()]


def test_class_lm_emissions_sum_to_one(spark, monkeypatch):
    monkeypatch.setattr(classlm, "CLUSTERED", 40)
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("абвгдежзиклмнопрстé") for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    texts = [(k, " ".join(rng.choice(vocabulary) for _ in range(40))) for k in range(30)]
    seen = classlm._rows(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text")
    model, counts = classlm.fit(seen)[0], classlm.count_words(seen)
    mass = collections.Counter({c: 1 for c in range(len(model.below))})  # one for all unseen words
    for r in counts.collect():
        mass[int(model.classes[model.head.get(bytes(r.word), -1)])] += r.n + 1
    assert all(math.isclose(mass[c], 10**x, rel_tol=1e-9) for c, x in enumerate(model.below))


def test_class_lm_clusters_and_scores_all_words(spark, monkeypatch):
    monkeypatch.setattr(classlm, "CLUSTERED", 20)
    monkeypatch.setattr(classlm, "HEAD", 100)
    rng = random.Random(4)
    kinds = [["".join(rng.choice(letters) for _ in range(rng.randrange(3, 7))) for _ in range(400)] for letters in ("абвгдежзи", "nopqrstuv")]
    draw = lambda k: kinds[k % 2][min(int(rng.expovariate(0.01)), 399)]
    texts = [(k, " ".join(draw(j) for j in range(60)) + (" x x unseen" if k % 5 == 0 else "")) for k in range(60)]
    texts += [(100 + k, " ".join(f"q{k}a{j} lonely q{k}b{j}" for j in range(15))) for k in range(5)]  # frequent, but beside rare words only
    df = spark.createDataFrame([*texts, texts[0], texts[0], (None, "solo")], "doc_id long, text string")
    model, rare = classlm.fit(classlm._rows(df, "doc_id", "text"))
    assert b"lonely" in model.head
    learnt = {w: int(model.classes[i]) for w, i in model.head.items()} | {bytes(r.word): r["class"] for r in rare.collect()}
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    train = [[b" ", *words(t), b" "] for i, t in [*texts, texts[0], texts[0], (None, "solo")] if not out(i)]
    counts = collections.Counter(w for t in train for w in t[1:])
    assert set(learnt) == set(counts) - {b" "} and max(learnt.values()) < classlm.CLASSES and len(learnt) > 300
    last, n_classes = len(model.below) - 1, len(model.below)
    of = lambda w: last if w == b" " else learnt.get(w, classlm.CLASSES + classlm.shape(w))
    step, before, mass = collections.Counter(), collections.Counter(), collections.Counter()
    for t in train:
        for a, b in zip(t, t[1:]):
            step[of(a), of(b)] += 1
            before[of(a)] += 1
    for w, n in counts.items():
        mass[of(w)] += n + 1
    got = classlm.score(df).collect()
    assert len(got) == len(texts) + 3
    want = dict([*texts, (None, "solo")])
    for r in got:
        t = [b" ", *words(want[r.doc_id]), b" "]
        brute = sum(math.log10((step[of(a), of(b)] + classlm.ALPHA) / (before[of(a)] + classlm.ALPHA * n_classes) * (counts[b] + 1) / (mass[of(b)] + 1)) for a, b in zip(t, t[1:]))
        assert math.isclose(r.score, brute, rel_tol=1e-9) and r.n_known == sum(counts[w] > 0 for w in t[1:])


def test_class_lm_contexts_hold_the_largest_ids(spark):
    end, top = classlm.HEAD, classlm.HEAD - 1
    given = [(top, end, 4), (end, top, 5), (top, top, 6), (top, end, 1), (3, top, classlm.HELD_PAIRS), (end, end, 9)]
    pairs = spark.createDataFrame([(a * (end + 1) + b, n) for a, b, n in given], "code long, n long")
    got = {r.id: sorted((x.ctx, x.n) for x in r.xs) for r in classlm._contexts(pairs, end + 1, 4).collect()}
    assert got == {top: sorted([(end * 2, 5), (end * 2 + 1, 5), (top * 2, 6), (top * 2 + 1, 6), (7, classlm.HELD_PAIRS)])}


def test_class_lm_moves_texts_not_words(spark, docs):
    rows_ = classlm._rows(docs, "doc_id", "text")
    _, _, tokens, spots = classlm._learnt(rows_)
    pairs = spark.createDataFrame([(1, 1)], "code long, n long")
    for df in (tokens, spots, classlm._contexts(pairs, classlm.HEAD + 1, 4, True)):
        assert not any(kind.startswith(("array", "struct")) for _, kind in df.dtypes)
    values, ends = np.array([0, 65535, 65536, 1, (1 << 48) - 1, 7]), np.array([0, 0, 2, 2, 5, 6])
    low, high = classlm._halves(values, ends)
    for a, b in ((0, 5), (1, 3), (3, 5), (0, 1), (2, 2)):
        lengths, got = classlm._whole(low[a:b], high[a:b])
        assert lengths.tolist() == np.diff(ends[a : b + 1]).tolist() and got.tolist() == values[ends[a] : ends[b]].tolist()


def test_moves_raise_likelihood_as_said():
    rng = random.Random(5)
    of = [rng.randrange(4) for _ in range(12)] + [classlm.CLASSES]
    pairs = collections.Counter((rng.randrange(13), rng.randrange(13)) for _ in range(300))
    pairs[3, 3] += 9

    def likelihood(of):
        n = np.zeros((classlm.CLASSES + 1,) * 2)
        for (a, b), k in pairs.items():
            n[of[a], of[b]] += k
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(n) - f(n.sum(1)) - f(n.sum(0)), n

    for w in range(12):
        xs = [(of[b] * 2, k) for (a, b), k in pairs.items() if a == w != b] + [(of[a] * 2 + 1, k) for (a, b), k in pairs.items() if b == w != a]
        ctx, count = np.array(xs).T
        best = classlm.moves(likelihood(of)[1], np.array([of[w]]), np.zeros(len(xs), int), ctx, count, np.array([float(pairs[w, w])]), np.array([0]))[0]
        every = [likelihood([*of[:w], c, *of[w + 1 :]])[0] for c in range(classlm.CLASSES)]
        assert math.isclose(every[best], max(every), rel_tol=1e-9)


def test_exchange_raises_likelihood():
    rng = random.Random(1)
    pairs = collections.Counter()
    for _ in range(3000):  # words 0-4 come before words 5-9
        pairs[rng.randrange(5), 5 + rng.randrange(5)] += 1
        pairs[5 + rng.randrange(5), rng.randrange(5)] += 1
    of = classlm.exchange([(a, b, n) for (a, b), n in pairs.items()], 10, 1, classes=2)
    assert len(set(of[:5])) == 1 and len(set(of[5:])) == 1 and of[0] != of[5]


def test_secrets(spark, docs, odd):
    scanner = secrets.Scanner()
    for r in [*docs.collect(), *odd.collect()]:
        t = (r.text or "").encode()
        want = [("assign", m.start(), m.end()) for m in re.finditer(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
        want += [("access", m.start(), m.end()) for m in re.finditer(rb"AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
        want += [("hex", m.start(), m.end()) for m in re.finditer(rb"[0-9a-f]+", t) if m.end() - m.start() >= 24]
        assert [s for s in scanner.spans(t) if s[0] in secrets.BASE] == sorted(want, key=lambda s: (s[1], secrets.RANK[s[0]]))
    body = b"A" * 30
    token = b"ghp_" + body + secrets.base62_crc32(body)
    assert [s[0] for s in scanner.spans(b"x " + token)] == ["forge_token"] and not scanner.spans(b"x " + token[:-1] + b"!")
    assert rows(secrets.scan(odd, keep=["doc_id"]))[6].secrets[0].start == 51


def test_chat(spark):
    text = "a\\b <|end|> \\<|x \n| <"
    df = spark.createDataFrame([(1, 1, "assistant", text), (1, 0, "u|>ser", None), (2, 0, "assistant", "x"), (2, 0, "assistant", "x")], "conv_id long, turn long, role string, text string")
    got = chat.format_chat(df).select("conv_id", chat.read_back(F.col("formatted")).alias("t"), chat.masked(F.col("formatted"), F.col("loss")).alias("m")).collect()
    assert {r.conv_id: ([tuple(x) for x in r.t], r.m) for r in got} == {1: ([("u|>ser", ""), ("assistant", text)], text), 2: ([("assistant", "x")] * 2, "xx")}
    assert chat.format_chat(df.limit(0)).count() == 0
    parts = spark.sql("SELECT 1 AS conv_id, 0 AS turn, 'user' AS role, array(named_struct('type', 'image', 'text', CAST(NULL AS STRING), 'ref', 'a.png', 'units', 2L), named_struct('type', 'text', 'text', 'hi', 'ref', NULL, 'units', NULL)) AS parts")
    one = chat.format_chat(parts, parts="parts").first()
    assert one.formatted == "<|turn:user|><|image:1|>hi<|end|>\n" and one.attachments[0].ref == "a.png" and one.expanded_tokens == 514


def test_mixing(spark, docs, odd, empty):
    got = queries.op8_source_mix(spark, D).collect()
    again = queries.op8_source_mix(spark, D).collect()
    assert sorted(got) == sorted(again)
    size, taken, target, most = collections.Counter(), collections.Counter(), {}, collections.Counter()
    source = {r.doc_id: r.source for r in docs.collect()}
    for r in got:
        s = source[r.doc_id]
        size[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        most[s] = max(most[s], r.size)
        assert r.taken <= 3 * r.size
    names = sorted(size)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full, left, open_ = {}, sum(size.values()), set(names)
    while True:  # share out, fix what is above its cap, share the rest again
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * size[s]}
        if not over:
            break
        for s in over:
            full[s] = 3 * size[s]
            left -= full[s]
        open_ -= over
    for s in names:
        want = full.get(s, weight[s] * level if s in open_ else 0)
        assert math.isclose(target[s], want, rel_tol=1e-9) and abs(taken[s] - want) <= most[s]
    assert mixing.mix(odd).count() == len(ODD) and mixing.mixed(empty).count() == 0
    assert mixing.mixed(odd).columns == [*odd.columns, "copy"]


def test_mixing_draws_by_weight(spark):
    rng = random.Random(9)
    given = [(k, " ".join(["w"] * rng.randrange(1, 40)), "ab"[k % 2], rng.choice([0.5, 1.0, 2.0, 4.0])) for k in range(400)]
    df = spark.createDataFrame(given, "doc_id long, text string, source string, w double")
    sizes = {k: len(t.split()) for k, t, *_ in given}
    taken = collections.Counter()
    runs = 12
    for seed in range(runs):
        got = mixing.mix(df, weight=F.col("w"), weights=(5.0, 1.0), seed=seed).collect()
        for s in "ab":
            mine = [r for r in got if r.source == s]
            assert abs(sum(r.copies * r["size"] for r in mine) - mine[0].target) <= 40 and all(r.copies <= 3 for r in mine)
        taken.update({r.doc_id: r.copies for r in got})
    for s in "ab":
        rows_ = [(k, w) for k, _, source, w in given if source == s]
        target = next(r.target for r in got if r.source == s)
        low, high = 0.0, 100.0
        for _ in range(80):  # the level at which the expected sizes make the target
            mid = (low + high) / 2
            low, high = (mid, high) if sum(sizes[k] * min(3, mid * w) for k, w in rows_) < target else (low, mid)
        for w in (0.5, 1.0, 2.0, 4.0):
            ids = [k for k, x in rows_ if x == w]
            want = min(3, low * w)
            p = want - int(want)
            mean = sum(taken[k] for k in ids) / len(ids) / runs
            assert abs(mean - want) <= 5 * (p * (1 - p) / (len(ids) * runs)) ** 0.5 + 0.05
            if w in (0.5, 4.0):  # certain copies come in every run
                assert all(taken[k] >= int(want + 1e-9) * runs for k in ids)


def test_warc(spark):
    body = "<p>" + "x" * 200
    df = spark.createDataFrame([(5, "http://a/ b", body), (3, None, body), (3, None, body), (9, "http://c", None), (None, "http://d", body), (7, "u", "é" * 80 + "WARC/1.1\r\n\r\n"), (8, "u", "short"), (10, "u", "short")], "page_id long, url string, html string")
    path = f"{shared_dir(spark)}/test-warc-{random.random()}"
    warc.write(warc.resolve(df), path, file_bytes=500)
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.with_originals(warc.read(spark, path)).collect()), key=str)
    assert got == sorted([(5, 203, "revisit", 3), (3, 203, "response", None), (3, 203, "response", None), (9, 0, "response", None), (None, 203, "revisit", 3), (7, 172, "response", None), (8, 5, "response", None), (10, 5, "response", None)], key=str)
    kept = {r.page_id: r.payload for r in warc.read(spark, path, payloads=True).where("record_type = 'response'").collect()}
    assert bytes(kept[7]).decode() == "é" * 80 + "WARC/1.1\r\n\r\n"
    one = {r.page_id: r for r in queries.op10_warc_revisits(spark, D).collect()}
    for r in table(spark, D, "pages").collect():
        assert one[r.page_id].payload_digest == hashlib.sha256((r.html or "").encode()).hexdigest()


def test_extract(spark):
    page = lambda n, extra="": f"<html><head><title>t{n}</title></head><body><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies</div><article><h1>Title {n}</h1><p>First &amp; <b>bold</b>\n text {n}<p>Second {n}{extra}<aside>side</aside></article><div class='comments'><p>nice!</p></div><form>f</form><footer>&copy;</footer>"
    df = spark.createDataFrame([(k, f"http://h/{k}", page(k)) for k in range(12)] + [(20, None, None), (21, "x", ""), (22, "http://p/1", "<div>plain <i>words</i></div><div>more</div>"), (0, "http://h/0", page(0))], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract.extract(df).collect()}
    assert got[3] == "Title 3\nFirst & bold text 3\nSecond 3" and got[20] == got[21] == "" and got[22] == "plain words\nmore"
    assert extract.extract(df.limit(0)).count() == 0
    one, two = extract.expression(extract.parse(page(1))), extract.expression(extract.parse(page(2, "<ul><li>x<li>y</ul>")))
    wrapper, loose = extract.aligned([one, two])
    assert not loose
    article = next(i for i in wrapper if i[0] == "article")
    assert [(i[0], i[1]) for i in article[5]] == [("h1", "1"), ("p", "+"), ("ul", "?"), ("aside", "1")] or article[5][1][1] == "+"


def read_alone(page, *others):
    """A page's text under the wrapper of itself and the others."""
    shapes = {}
    for p in (page, *others):
        e = extract.expression(extract.parse(p))
        shapes[extract.shape(e)] = extract._added(shapes[extract.shape(e)], e) if extract.shape(e) in shapes else e
    return "\n".join(extract.blocks(extract.parse(page), extract.plan(*extract.aligned([shapes[k] for k in sorted(shapes)]))))


def test_extract_hostile_pages():
    assert read_alone("<div>" * 5000 + "<p>deep text<p>more" + "</div>" * 5000) == "deep text\nmore"
    assert read_alone("<article><p>" + "<b>" * 5000 + "x" + "</b>" * 5000 + "<p>y</article>") == "x\ny"
    assert read_alone("<div>" * 200 + "<nav><div><a>menu</a></div></nav><p>text" + "</div>" * 200 + "<p>end") == "text\nend"
    assert read_alone("<p title=it's>Alpha</p>") == "Alpha"
    assert read_alone("<article><p title='a>b'>x</p><p data-x=\"<p>\">y</article>") == "x\ny"
    assert read_alone('<article><a x="open <p>text') in ("text", '<a x="open\ntext')
    for page in ('<a x="' * 200_000, "<" * 300_000, "<p>a" + "</div>" * 100_000, "<p>a" + "</script " * 100_000, "<ul>" + "<li>x" * 50_000, "<h2>a</h2><p>b</p>" * 10_000):
        read_alone("<article>" + page)  # linear: seconds, not minutes
    assert read_alone("<p>" + "word " * 2_000_000) == ("word " * 2_000_000).strip()


def test_extract_keeps_what_copies_share():
    page = "<div class=content><h1>The Title</h1><p>One paragraph.</p></div>"
    assert read_alone(page, *[page] * 8) == "The Title\nOne paragraph."
    framed = lambda k: f"<div class=content><div class=strip>Same everywhere</div><h1>Title {k}</h1><p>Paragraph {k}.</p></div>"
    assert read_alone(framed(0), *map(framed, range(1, 9))) == "Title 0\nParagraph 0."
    assert read_alone("<article><header><h1>T</h1></header><div class=related-work><p>x</p></div><div class=cookie-notice>c</div><header>no</header></article>") == "T\nx"


def test_extract_groups():
    items = extract.expression(extract.parse("<h2>a</h2><p>b</p>" * 3 + "<h2>a</h2><p>b</p><p>c</p>"))
    assert [i[:2] for i in items] == [["(h2 p)", "+"]] and [i[:2] for i in items[0][5]] == [["h2", "1"], ["p", "+"]]
    once = extract.expression(extract.parse("<h2>a</h2><p>b</p><ul><li>x</ul>"))
    assert [i[:2] for i in extract.align(items, once)] == [["(h2 p)", "+"], ["ul", "?"]]
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(2))
        pairs = extract._matches(a, b)
        assert all(a[x] == b[y] for x, y in pairs) and pairs == sorted(pairs) and len({x for x, _ in pairs}) == len({y for _, y in pairs}) == len(pairs)
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert len(pairs) == best[-1][-1]


def test_extract_planted_truth_under_any_partitioning(spark, monkeypatch):
    monkeypatch.setattr(extract, "FAN", 5)
    rng = random.Random(7)
    given, want = [], {}
    for k in range(60):
        body = [f"word{rng.randrange(1000)} in paragraph {k} {j}" for j in range(rng.randrange(1, 6))]
        extra = rng.choice(["", "<ul><li>one<li>two</ul>", "<blockquote>said</blockquote>"])
        lines = [f"Head {k}", *body, *({"": [], "<ul><li>one<li>two</ul>": ["one", "two"]}.get(extra, ["said"]))]
        inner = f"<h1>Head {k}</h1>" + "".join(f"<p>{x}</p>" for x in body) + extra
        frame = ("<article>%s</article>", "<div id=content><div class=tagline>Always here</div>%s</div>", "<main>%s<div class='share'>Tell</div></main>")[k % 3]
        given.append((k, f"https://h{k % 3}.example/{k}", f"<body><nav><a>Home</a></nav>{rng.choice(['', '<div class=ad>Buy</div>'])}{frame % inner}<footer>Contact {k}</footer>"))
        want[k] = "\n".join(lines)
    given += [given[0], (100, "https://h0.example/x", None)]
    df = spark.createDataFrame(given, "page_id long, url string, html string")
    one = sorted(map(tuple, extract.extract(df.repartition(1)).collect()))
    assert one == sorted(map(tuple, extract.extract(df.repartition(7)).collect()))
    assert {r[0]: r[2] for r in one} == {**want, 100: ""} and len(one) == len(given)


def test_secrets_long_texts():
    scanner = secrets.Scanner()
    for text in (b"eyJ" * 500_000, b"eyJa.eyJb " * 100_000, b"password" * 100_000, b"token = " * 100_000, b"AKIA" * 200_000, b"0123456789abcdef" * 100_000, b"4" * 1_000_000):
        scanner.spans(text)  # linear: seconds, not minutes
    assert scanner.spans(b"AKIA" * 200_000) == [("access", 0, 800_000)]


def test_secrets_empty_table_and_clashing_names(spark, empty, odd):
    assert secrets.scan(empty).count() == 0
    out = secrets.scan(odd.withColumn("secrets", F.lit(1)).withColumn("body", F.lit(2)))
    assert out.columns[-1] == "_secrets" and out.count() == len(ODD)


def test_chat_long_conversation(spark):
    n = 50_000
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é<|x "), F.col("id").cast("string"), F.repeat(F.lit(" y"), 20)).alias("text"))
    made = chat.format_chat(turns)
    got = made.select(F.size(chat.read_back(F.col("formatted"))).alias("n"), F.sha2(chat.masked(F.col("formatted"), F.col("loss")), 256).alias("h")).first()
    assert got.n == n and got.h == hashlib.sha256("".join(f"é<|x {k}" + " y" * 20 for k in range(1, n, 2)).encode()).hexdigest()


def test_chat_numbers_attachments_over_turns(spark):
    part = lambda kind, ref, text=None: f"named_struct('type', '{kind}', 'text', {'NULL' if text is None else repr(text)}, 'ref', {'NULL' if ref is None else repr(ref)}, 'units', CAST(NULL AS BIGINT))"
    rows = [f"SELECT 1 AS conv_id, {k} AS turn, 'user' AS role, array({part('text', None, 'a <|#|> <')}, {part('image', f'i{k}')}, {part('text', None, '|#')}, {part('audio', f'a{k}')}) AS parts" for k in range(12)]
    made = chat.format_chat(spark.sql(" UNION ALL ".join(rows)), parts="parts")
    one = made.first()
    assert [a.number for a in one.attachments] == list(range(1, 25)) and [a.ref for a in one.attachments][:4] == ["i0", "a0", "i1", "a1"]
    assert [t.text for t in made.select(chat.read_back(F.col("formatted")).alias("t")).first().t] == [f"a <|#|> <<|image:{2 * k + 1}|>|#<|audio:{2 * k + 2}|>" for k in range(12)]


def test_warc_hot_digests_and_large_pages(spark):
    body, big = "<p>" + "x" * 200, "z" * 3_000_000
    df = spark.createDataFrame([(k, f"http://a/{k}", body if k % 3 else ("s" if k % 2 else big)) for k in range(60)], "page_id long, url string, html string")
    for few in (100_000, 0):  # with and without a broadcast
        warc_few, warc.BROADCAST_REVISITS = warc.BROADCAST_REVISITS, few
        try:
            path = f"{shared_dir(spark)}/test-warc-{random.random()}"
            warc.write(warc.resolve(df), path, file_bytes=2000)
            got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.with_originals(warc.read(spark, path)).collect()}
        finally:
            warc.BROADCAST_REVISITS = warc_few
        assert got == {k: (203, "revisit" if k > 1 else "response", 1 if k > 1 else None) if k % 3 else ((1, "response", None) if k % 2 else (3_000_000, "revisit" if k else "response", 0 if k else None)) for k in range(60)}
    empty = df.limit(0)
    path = f"{shared_dir(spark)}/test-warc-{random.random()}"
    warc.write(warc.resolve(empty), path)
    assert warc.read(spark, path).count() == 0


def test_pipeline_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    other = " ".join(f"word{k}" for k in range(30))
    third = " ".join(f"term{k}" for k in range(30))
    given = [(4, A), (4, A), (None, A), (None, A.upper()), (None, other), (None, other), (9, A), (9, third), (5, third), (5, third), (11, None), (11, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in given], SCHEMA)
    got = corpus_pipeline.near_dedup(spark, df, D)
    assert got.columns == df.columns
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=str) == sorted([(4, A), (None, other), (5, third), (11, None), (11, "")], key=str)


def test_pipeline_stages_by_brute_force(spark):
    """Each stage on a small table with copies, repeated rows, null ids and texts, against plain Python."""
    import corpus_pipeline

    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(400)]
    line = lambda n=12: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = line(14)
    texts = ["\n".join(line() for _ in range(4)) for _ in range(20)]
    texts += [texts[0], texts[1] + "\n" + shared, texts[2] + "\n" + shared, "few words", "# $ % " * 30, "same line\n" * 20, None, "", texts[3].upper()]
    given = [(k, t, "en", "ab"[k % 2] if k % 5 else None, 3) for k, t in enumerate(texts)]
    given += [given[4], given[4], (None, texts[5], "en", "a", 3), (None, line(30), "en", "b", 3), (3, line(40), "en", "a", 3)]
    df = spark.createDataFrame(given, SCHEMA)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    pairs = lambda out: sorted([(r.doc_id, r.text) for r in out.collect()], key=key)

    kept = []
    for i, t, *_ in given:
        view = quality.View((t or "").encode())
        if not any(r.rejects(view) for r in quality.RULES):
            kept.append((i, t))
    out = corpus_pipeline.quality_rules(spark, df, D)
    assert pairs(out) == sorted(kept, key=key) and out.columns == df.columns

    # Rows of one id and text are one row for line dedup; a null id comes first; then the text's hash.
    ids = {(r.doc_id, r.text): r.h for r in df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    seen, want = [], {}
    for i, t in sorted(ids, key=lambda r: (r[0] is not None, r[0] or 0, ids[r])):
        if t is None:
            continue
        stay = []
        for x in t.split("\n"):
            s = frozenset(re.findall(r"[^\x20\x09-\x0D]+", x.lower()))
            if not s or not any(linededup.DEN * len(s & o) >= linededup.NUM * len(s | o) for o in seen):
                stay.append(x)
            if s:
                seen.append(s)
        want[i, t] = "\n".join(stay)
    lines = [(i, want[i, t]) for i, t, *_ in given if t is not None and (want[i, t] == t or want[i, t].split())] + [(i, t) for i, t, *_ in given if t is None]
    out = corpus_pipeline.line_dedup(spark, df, D)
    assert pairs(out) == sorted(lines, key=key)
    assert all(r.n_chars == len(r.text) for r in out.where("text IS NOT NULL").collect())

    sets = [shingled(t) for _, t, *_ in given]
    up = list(range(len(given)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(given)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for k, row in enumerate(given):
        groups[find(k)].append(row)
    got = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, df, D).collect())
    assert sum(got.values()) == len(groups)
    for rows_ in groups.values():
        low = min((r[0] is None, r[0] or 0) for r in rows_)
        assert any(got[r[0], r[1]] for r in rows_ if (r[0] is None, r[0] or 0) == low)

    bench = [r.text for r in table(spark, D, "benchmark").collect()]
    dirty = spark.createDataFrame([(1, "clean words of no item at all here in this text", "en", "a", 1), (2, line(20) + " " + bench[0] + " " + line(20), "en", "a", 1), (3, bench[1], "en", "a", 1), (None, None, None, None, None)], SCHEMA)
    cleaned = {r.doc_id: r.text for r in corpus_pipeline.decontamination(spark, dirty, D).collect()}
    assert cleaned[1] == "clean words of no item at all here in this text" and None in cleaned and 3 not in cleaned
    assert bench[0] not in cleaned.get(2, "")

    mixed_ = corpus_pipeline.source_mix(spark, df, D).collect()
    copies = collections.Counter((r.doc_id, r.text) for r in mixed_)
    rows_of = collections.Counter((i, t) for i, t, *_ in given)
    assert all(n <= 3 * rows_of[r] for r, n in copies.items()) and (6, None) not in copies
    assert sorted(map(tuple, mixed_), key=str) == sorted(map(tuple, corpus_pipeline.source_mix(spark, df.repartition(3), D).collect()), key=str)
    nothing = df.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, D).count() == 0
    clashing = df.withColumn("copy", F.lit(1)).withColumn("kept", F.lit(2)).withColumn("row", F.lit(3))
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, clashing, D).columns == clashing.columns


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near-duplicates", "decontamination", "source mix"]
    out = corpus_pipeline.run(spark, D)
    assert out.columns == [*table(spark, D, "documents").columns, "copy"] and out.count() > 0
    assert decontaminate.find(out, table(spark, D, "benchmark"), keep=["doc_id"]).where("size(found.hits) > 0").count() == 0
