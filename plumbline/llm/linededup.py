"""Line deduplication by an exact set-similarity join over line tokens, in DataFrame functions only.

A line's set is its distinct words in lower case. A line is removed if an earlier line, by (doc_id, text hash, line number), has
a set whose Jaccard similarity to its own is NUM / DEN or more; whether the earlier line was removed itself doesn't matter.

Lines of equal sets are one class, which stands where its first line does; its other lines go. Between classes the join takes
tokens from rare to frequent (by the rank of their bucket, of a fixed number, by counts over the whole corpus) and uses

* the prefix filter: a pair must share a token in the longer set's first ``n - ceil(t n) + 1`` and the shorter one's first
  ``n - ceil(2 t / (1 + t) n) + 1`` tokens;
* the length filter: the shorter set has t times the longer one's tokens or more;
* the positional filter: what follows the shared token on either side must still allow the overlap;
* a parity bitmap: each token flips one of 64 bits, so bits that differ bound the sets' difference from below.

Pairs that pass are verified on the words. Tokens in ``HOT`` or more prefixes are first paired with a few early lines only;
classes that these remove need no pair among themselves, so a group of n variants doesn't make n * n / 2 pairs.

Defined results: lines without words stay; null and empty texts stay as they are; rows of one id and text count as one row and
get equal results; a null id comes first; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, stored, stored_plain

NUM, DEN = 9, 10
SPACE = r"[\x20\x09-\x0D]+"
BLANK = " \t\n\x0b\x0c\r"
#: Buckets of the frequency table, by a hash's top bits: so many counts, whatever the corpus. They fit the aggregation's fast map.
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
#: Prefixes that share a token from which its list counts as hot, and how many early lines stand for it.
HOT, CENTRES = 512, 8
#: Hot tokens up to which they are broadcast (8 bytes each); beyond, the join shuffles.
BROADCAST_TOKENS = 200_000
#: Longs of the bitmaps that say which rows may have a partner: a megabyte, whatever the corpus. Full ones only stop helping.
BITMAP_LONGS = 1 << 17
#: Parquet columns of lines and classes that are nearly all different.
UNIQUE = ["h1", "h2", "parity"]


def _pieces(text: Column) -> Column:
    """The words of a line in lower case, with empty ones. Splitting at single spaces is much cheaper than at a class, and nearly all texts need no more."""
    low = F.lower(text)
    odd = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\x0b")) | F.contains(text, F.lit("\x0c")) | F.contains(text, F.lit("\r"))
    return F.when(odd, F.split(low, SPACE)).otherwise(F.split(low, " "))


def _words(text: Column) -> Column:
    return F.array_remove(_pieces(text), "")


def _hashes(text: Column) -> Column:
    """The hashes of a line's distinct words. Empty pieces go last, as one hash: taking them from an array of strings copies each."""
    return F.array_remove(F.array_distinct(F.transform(_pieces(text), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _bucket(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BUCKET_BITS)


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), n.cast("int"))


def _every(rows: DataFrame, size: int) -> DataFrame:
    """rows of (slot, v), with a zero for each of ``size`` slots: one aggregation then has all slots, without a join to fill gaps."""
    return rows.select("slot", F.col("v").cast("bigint").alias("v")).union(rows.sparkSession.range(0, size, 1, 1).select("id", F.lit(0).cast("bigint")))


def rarity(hashed: DataFrame) -> str:
    """For each bucket of words, comma-joined, what turns a hash by XOR into a sort key: its top bits become the bucket's rank by count.

    The ranks of BUCKETS buckets come to the driver, whatever the corpus. Each line counts once for each of its words.
    """
    # The outer form: for the plain one the optimiser adds a filter on the array.
    found = hashed.select(F.explode_outer("hashes").alias("h")).select(_bucket(F.col("h")).alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("v"))
    counts = _every(found, BUCKETS).groupBy("slot").agg(F.sum("v").alias("n"))
    ranked = counts.select("slot", (F.row_number().over(Window.orderBy("n", "slot")) - 1).alias("rank"))
    # Keys are signed: the lowest rank has the lowest top bits.
    turn = F.call_function("shiftleft", (F.col("rank") - BUCKETS // 2).cast("bigint").bitwiseXOR(F.col("slot")), F.lit(64 - BUCKET_BITS))
    return _dense(ranked.select("slot", turn.cast("string").alias("v"))).select(F.array_join("dense", ",").alias("s")).first()["s"]


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, rid, line, t) of each line with a word; rid is the text's hash."""
    body = F.col(f"`{text}`")
    # In two steps: else each line would carry its whole text past the generator.
    split = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc"), F.xxhash64(body).alias("rid"), F.split(body, "\n", -1).alias("ts"))
    # The outer form and a filter on the line itself: the plain form, or a filter on the words, has its input computed once more.
    return split.select("doc", "rid", F.posexplode_outer("ts").alias("line", "t")).where(F.ltrim("t", F.lit(BLANK)) != "")


def hashed_lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, rid, line, hashes) of each line with a word; hashes are its distinct words'."""
    return _lines(docs, doc_id, text).select("doc", "rid", "line", _hashes(F.col("t")).alias("hashes"))


def prefixes(docs: DataFrame, doc_id: str, text: str, hashed: DataFrame | None = None) -> DataFrame:
    """(doc, rid, line, h1, h2, n, parity, prefix) of each line with a word.

    (h1, h2) names the set; prefix holds the first tokens, rare ones first, as sort keys. ``hashed`` are the ``hashed_lines`` of docs,
    which are read twice: kept ones spare the second cut into words.
    """
    # Words are hashed in a step of their own: a lambda that names its argument twice computes it twice.
    hashed = hashed_lines(docs, doc_id, text) if hashed is None else hashed
    # A literal that the optimiser folds into an array of longs.
    turns = F.split(F.lit(rarity(hashed)), ",").cast("array<bigint>")

    def key(h: Column) -> Column:
        # Never null, and said to be: only then are keys sorted as an array of longs, not as objects.
        return h.bitwiseXOR(F.coalesce(turns[_bucket(h)], F.lit(0).cast("bigint")))

    rows = hashed.select("doc", "rid", "line", F.sort_array(F.transform("hashes", key)).alias("keys"))
    rows = rows.select("doc", "rid", "line", "keys", F.size("keys").alias("n"))
    zero = F.lit(0).cast("bigint")
    return rows.select(
        "doc",
        "rid",
        "line",
        F.xxhash64("keys").alias("h1"),
        F.xxhash64(F.lit(1), F.col("keys")).alias("h2"),
        "n",
        F.aggregate("keys", zero, lambda a, x: a.bitwiseXOR(_bit(x.bitwiseAND(F.lit(63))))).alias("parity"),
        F.slice("keys", 1, F.col("n") - F.expr(f"({NUM} * n + {DEN - 1}) div {DEN}").cast("int") + 1).alias("prefix"),
    )


def _dense(rows: DataFrame) -> DataFrame:
    """The array, in one row, of v by slot."""
    return rows.agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "v"))), lambda s: s["v"]).alias("dense"))


def _maybe(hashes: DataFrame) -> Callable[[Column], Column]:
    """Whether a hash may be among those in the only column of ``hashes``: a test on a bitmap, so that others needn't move to a join."""
    s = F.col(hashes.columns[0])
    at = hashes.select(F.shiftrightunsigned(s, 6).bitwiseAND(F.lit(BITMAP_LONGS - 1)).alias("slot"), _bit(s.bitwiseAND(F.lit(63))).alias("v"))
    words = _every(at, BITMAP_LONGS).groupBy("slot").agg(F.bit_or("v").alias("v"))
    bitmap = stored(_dense(words), "line-bitmap").scalar()
    return lambda h: F.get(bitmap, F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(BITMAP_LONGS - 1)).cast("int")).bitwiseAND(_bit(h.bitwiseAND(F.lit(63)))) != 0


def _need(a: str, b: str) -> Column:
    """The least overlap of sets of a and b tokens that are similar: ceil(t / (1 + t) (a + b))."""
    return F.expr(f"({NUM} * ({a} + {b}) + {NUM + DEN - 1}) div {NUM + DEN}")


def _close(x: str, y: str) -> Column:
    """Length, positional and bitmap filters on posting columns with prefixes x and y."""
    n, m = f"{x}_n", f"{y}_n"
    need = _need(n, m)
    length = F.expr(f"{DEN} * least({n}, {m}) >= {NUM} * greatest({n}, {m})")
    place = F.expr(f"1 + least({n} - {x}_pos, {m} - {y}_pos) - 1") >= need
    differ = F.bit_count(F.col(f"{x}_parity").bitwiseXOR(F.col(f"{y}_parity")))
    return length & place & (F.col(n) + F.col(m) - differ >= 2 * need)


def _named(df: DataFrame, by: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{by}_{c}") for c in df.columns])


def matches(docs: DataFrame, classes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(h1, h2) of the classes that an earlier class is similar to."""
    posting = classes.select("first", F.posexplode("prefix").alias("pos", "tok"), "h1", "parity", "n")
    hot = stored(posting.groupBy("tok").agg(F.count(F.lit(1)).alias("lists")).where(F.col("lists") >= HOT).select(F.col("tok").alias("hot_tok")), "line-hot")
    n_hot = hot.count()
    early = None
    left = classes.select("h1", "n", "parity", "prefix", F.lit(False).alias("done"))
    if n_hot:
        hot_rows = posting.join(F.broadcast(hot) if n_hot <= BROADCAST_TOKENS else hot, F.col("tok") == F.col("hot_tok")).drop("hot_tok")
        fields = ("first", "h1", "n", "parity", "pos")
        centres = hot_rows.groupBy("tok", F.pmod("h1", F.lit(CENTRES)).alias("part")).agg(F.min(F.struct(*fields)).alias("c")).select(F.col("tok").alias("c_tok"), *[F.col(f"c.{f}").alias(f"c_{f}") for f in fields])
        near = _named(hot_rows, "x")
        stars = near.join(centres, (F.col("x_tok") == F.col("c_tok")) & (F.col("c_first") < F.col("x_first")) & _close("x", "c")).select(F.col("x_h1").alias("a"), F.col("c_h1").alias("b")).distinct()
        early = stored(_verified(docs, classes, stars, doc_id, text), "line-matches")
        done = early.select(F.col("h1").alias("d1"), F.col("h2").alias("d2"))
        maybe = _maybe(early.select("h1"))
        some = classes.where(maybe(F.col("h1"))).join(done, (F.col("h1") == F.col("d1")) & (F.col("h2") == F.col("d2")), "left").select("h1", "n", "parity", "prefix", F.col("d1").isNotNull().alias("done"))
        left = some.unionByName(left.where(~maybe(F.col("h1"))))
    rows = left.select("h1", "n", "parity", "done", F.posexplode("prefix").alias("pos", "tok"))
    index = _named(rows.where(F.expr(f"pos <= n - ({2 * NUM} * n + {NUM + DEN - 1}) div {NUM + DEN}")), "x")
    probe = _named(rows, "y")
    order = (F.col("x_n") < F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_h1") < F.col("y_h1")))
    pairs = index.join(probe, (F.col("x_tok") == F.col("y_tok")) & order & ~(F.col("x_done") & F.col("y_done")) & _close("x", "y"))
    late = _verified(docs, classes, pairs.select(F.col("x_h1").alias("a"), F.col("y_h1").alias("b")).distinct(), doc_id, text)
    return early.union(late).distinct() if early else late


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(h1, h2) of the later class of each pair whose words are similar."""
    pairs = stored(pairs, "line-pairs")
    wanted = stored(pairs.select(F.col("a").alias("w1")).union(pairs.select("b")).distinct(), "line-wanted")
    some = stored(classes.where(_maybe(wanted)(F.col("h1"))).join(wanted, F.col("h1") == F.col("w1"), "left_semi").select("h1", "h2", "first"), "line-firsts")
    # Only texts, then lines, that may be wanted leave the scan; the join then takes the right ones.
    texts, places = F.xxhash64("first.doc", "first.rid"), F.xxhash64("first.doc", "first.rid", "first.line")
    maybe = _maybe(some.select(F.explode(F.array(texts, places)).alias("s")))
    some_docs = docs.where(maybe(F.xxhash64(F.col(f"`{doc_id}`").cast("bigint"), F.xxhash64(F.col(f"`{text}`")))))
    lines = _lines(some_docs, doc_id, text).where(maybe(F.xxhash64("doc", "rid", "line")))
    here = F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("rid") == F.col("first.rid")) & (F.col("line") == F.col("first.line"))
    worded = stored(some.join(lines, here).select("h1", "h2", "first", F.array_distinct(_words(F.col("t"))).alias("words")).dropDuplicates(["h1", "h2"]), "line-words")
    both = pairs.join(_named(worded, "p"), F.col("a") == F.col("p_h1")).join(_named(worded, "q"), F.col("b") == F.col("q_h1"))
    # The intersection is named once: a filter computes what it names twice twice.
    similar = both.where((NUM + DEN) * F.size(F.array_intersect("p_words", "q_words")) >= NUM * (F.size("p_words") + F.size("q_words")))
    later = F.when(F.col("p_first") < F.col("q_first"), F.struct(F.col("q_h1").alias("h1"), F.col("q_h2").alias("h2"))).when(F.col("q_first") < F.col("p_first"), F.struct(F.col("p_h1").alias("h1"), F.col("p_h2").alias("h2")))
    return similar.select(later.alias("l")).where("l IS NOT NULL").select("l.h1", "l.h2").distinct()


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with ``text`` less the lines that an earlier line matches, and ``removed_lines``, how many they were."""
    # Read twice, then not again: kept as Spark's own blocks, of which a lost executor costs a new cut. As Parquet, long arrays take about as much as that.
    hashed = hashed_lines(docs, doc_id, text).persist(StorageLevel.DISK_ONLY)
    # Stored, not kept: else each later plan would hold the table of ranks, in the driver's memory.
    lines = stored_plain(prefixes(docs, doc_id, text, hashed), "lines", UNIQUE)
    hashed.unpersist(True)
    place = F.struct("doc", "rid", "line")
    classes = lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.first("n").alias("n"), F.first("parity").alias("parity"), F.first("prefix").alias("prefix"), F.count(F.lit(1)).alias("lines"))
    classes = stored_plain(classes, "line-classes", UNIQUE)
    # Read twice from here on, so stored: else each use would verify all pairs again.
    gone = stored(matches(docs, classes, doc_id, text), "line-gone")
    # Only classes that go or have several lines lose any.
    maybe_gone = _maybe(gone.select("h1"))
    touched = classes.where((F.col("lines") > 1) | maybe_gone(F.col("h1"))).select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), "first")
    flags = stored(touched.join(gone.select(F.col("h1").alias("g1"), F.col("h2").alias("g2")), (F.col("c1") == F.col("g1")) & (F.col("c2") == F.col("g2")), "left").select("c1", "c2", "first", F.col("g1").isNotNull().alias("gone")), "line-flags")
    met = lines.where(_maybe(flags.select("c1"))(F.col("h1"))).select("doc", "rid", "line", "h1", "h2").join(flags, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")))
    cut = met.where(F.col("gone") | ~F.struct("doc", "rid", "line").eqNullSafe(F.col("first")))
    by_doc = stored(cut.select("doc", "rid", "line").distinct().groupBy(F.col("doc").alias("r_doc"), F.col("rid").alias("r_rid")).agg(F.collect_list("line").alias("cut")), "line-cuts")
    body, out = F.col(f"`{text}`"), free_name(docs, "removed_lines")
    spare = free_name(docs, "cut_lines")
    # Texts that lose no line stay where they are.
    doc, rid = F.col(f"`{doc_id}`").cast("bigint"), F.xxhash64(body)
    maybe = _maybe(by_doc.select(F.xxhash64("r_doc", "r_rid").alias("s")))
    mine = maybe(F.xxhash64(doc, rid))
    joined = docs.where(mine).join(by_doc.withColumnRenamed("cut", spare), doc.eqNullSafe(F.col("r_doc")) & (rid == F.col("r_rid")), "left")
    kept = F.array_join(F.filter(F.split(body, "\n", -1), lambda x, i: ~F.array_contains(F.col(spare), i)), "\n")
    own = lambda df, text_: df.select(*[text_.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], F.coalesce(F.size(spare) if spare in df.columns else F.lit(None), F.lit(0)).cast("bigint").alias(out))
    return own(joined, F.when(F.col(spare).isNotNull(), kept).otherwise(body)).unionByName(own(docs.where(~mine), body))
