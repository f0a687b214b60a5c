"""b-bit MinHash near-duplicates: band keys give candidates, packed low bits estimate them, full sets confirm them.

A document's set is its distinct 5-word shingles, ASCII letters in lower case (all its words as one shingle if there are fewer).
``HASHES`` minima make a signature; ``ROWS`` minima make each of ``BANDS`` band keys, and the low two bits of every minimum are
packed into four longs. Two documents agree on a two-bit group by chance one time in four, so the estimate corrects for that.

Documents of equal sets are one class and one node. Keys that two or more nodes share give candidates:

1. Stars. In each key every node is paired with one centre (the node of the lowest hash), so a group of n copies gives n pairs,
   not n * n / 2. Of a node's candidates the one with the highest estimate is confirmed on the full sets. Confirmed links make
   components; further rounds with other centres look only at keys that hold several components.
2. The rest. What the stars left apart is compared pair by pair, across components only: by estimate, once in the first key
   that a pair shares, then by the estimate of a signature of ``WIDE`` minima made for these nodes alone, then on full sets.

Only a pair with similarity 0.75 that agrees on no band (5 in a million), or whose estimates are under their floors (5 and 4
standard errors low), and that no chain joins, can be missed.

Defined results: null and empty texts have no shingles, stay alone and are kept; rows of one id and text get equal results; a
null id is never the smallest, and a class of null ids only has a null component; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tokens, mixed, pieces, random_words, stored, windows
from .graph import components

SHINGLE = 5
#: A link: NUM / DEN or more of the union.
NUM, DEN = 75, 100
BANDS, ROWS, BITS = 32, 4, 2
HASHES = BANDS * ROWS
FLOOR = 0.5
STAR_ROUNDS = 2
#: Orders of nodes by which centres are chosen: keys of one family tend to have the same centres.
FAMILIES = 4
#: Minima of the second signature, and its floor, 4.3 standard errors (0.0115 at 0.75) low.
WIDE, WIDE_FLOOR = 2048, 0.70
#: Bytes of text hashed at a time: about 100 bytes of arrays stand for each, and workers keep what they once had.
PIECE_BYTES = 1 << 18

_MULTIPLY = random_words(WIDE, 1) | np.uint64(1)
_ADD = random_words(WIDE, 2)
_BAND_SALT = random_words(HASHES, 3) | np.uint64(1)


def shingles(col: pa.BinaryArray) -> list[np.ndarray]:
    """Each text's set: the sorted distinct 64-bit hashes of its shingles."""
    tokens = Tokens(col)
    h, first = windows(tokens.hashes(), tokens.first, SHINGLE, 5)
    return [np.unique(h[first[k] : first[k + 1]]) for k in range(len(col))]


def minima(sets: list[np.ndarray], hashes: int = HASHES) -> np.ndarray:
    """hashes x len(sets) minima (32 bits) of non-empty sets."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((hashes, len(sets)), dtype=np.uint32)
    for k in range(hashes):
        out[k] = np.minimum.reduceat(((flat * _MULTIPLY[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    """len(sets) x BANDS keys (63 bits) of the minima."""
    terms = mixed(m.astype(np.uint64) * _BAND_SALT[:, None] + np.arange(HASHES, dtype=np.uint64)[:, None])
    summed = terms.reshape(BANDS, ROWS, -1).sum(axis=1, dtype=np.uint64)
    return (mixed(summed) >> np.uint64(1)).astype(np.int64).T


def packed(m: np.ndarray) -> np.ndarray:
    """len(sets) x as many longs as hold the minima's low BITS bits."""
    per = 64 // BITS
    low = (m & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(m) // per, per, -1)
    shifts = (np.arange(per, dtype=np.uint64) * np.uint64(BITS))[None, :, None]
    return np.bitwise_or.reduce(low << shifts, axis=1).view(np.int64).T


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest of the set, n_shingles, s0..s3, bands) of each row; a row without shingles has nulls but for its id and 0."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1, PIECE_BYTES):
                sets = shingles(piece.column(1))
                full = [k for k, s in enumerate(sets) if len(s)]
                n = len(sets)
                digest, bands, bits = [None] * n, [None] * n, [[None] * n for _ in range(4)]
                if full:
                    m = minima([sets[k] for k in full])
                    for k, keys, pack in zip(full, band_keys(m).tolist(), packed(m).tolist()):
                        digest[k] = hashlib.md5(sets[k].tobytes()).digest()
                        bands[k] = keys
                        for column, x in zip(bits, pack):
                            column[k] = x
                arrays = [piece.column(0), pa.array(digest, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), *[pa.array(x, pa.int64()) for x in bits], pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "digest", "n_shingles", "s0", "s1", "s2", "s3", "bands"])

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("body"))
    return rows.mapInArrow(signed, "doc_id long, digest binary, n_shingles long, s0 long, s1 long, s2 long, s3 long, bands array<long>")


def _differing(x: Column, y: Column) -> Column:
    """How many two-bit groups of two longs differ."""
    d = x.bitwiseXOR(y)
    return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def _corrected(differ: Column, hashes: int) -> Column:
    """The similarity that so many differing groups suggest, corrected for chance agreement."""
    chance = 1 / (1 << BITS)
    return ((1 - differ / hashes) - chance) / (1 - chance)


def estimate(a: str, b: str) -> Column:
    """The similarity that two packed signatures (four columns each, with prefixes a and b) suggest."""
    return _corrected(sum((_differing(F.col(f"{a}{k}"), F.col(f"{b}{k}")) for k in range(1, 4)), _differing(F.col(f"{a}0"), F.col(f"{b}0"))), HASHES)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have NUM / DEN or more of their union in common."""
    low, high = sorted((len(a), len(b)))
    if not low or DEN * low < NUM * high:
        return False
    both = int((np.searchsorted(a, b, side="right") - np.searchsorted(a, b, side="left")).sum())
    return DEN * both >= NUM * (len(a) + len(b) - both)


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are linked."""
    one = texts.select(F.col("node").alias("a_node"), F.col("body").alias("a_body"))
    two = texts.select(F.col("node").alias("b_node"), F.col("body").alias("b_body"))
    rows = pairs.select("a", "b").join(one, F.col("a") == F.col("a_node")).join(two, F.col("b") == F.col("b_node")).select("a", "b", "a_body", "b_body")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece in pieces(batch, 3, PIECE_BYTES):
                ours, out = piece.column(0).to_pylist(), []
                others = shingles(piece.column(3))
                for k, a in enumerate(ours):
                    if a not in kept:
                        if len(kept) > 200:
                            kept.clear()
                        kept[a] = shingles(pa.array([piece.column(2)[k].as_py()], pa.binary()))[0]
                    out.append(linked(kept[a], others[k]))
                yield piece.select(["a", "b"]).filter(pa.array(out, pa.bool_()))

    return rows.mapInArrow(checked, "a long, b long")


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs."""
    sig = stored(signatures(docs, doc_id, text), "near-signatures")
    first = [F.first(c).alias(c) for c in ("s0", "s1", "s2", "s3", "bands")]
    classes = stored(sig.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), *first), "near-classes")
    # The smallest id names a class's node, unless ids repeat over texts or are null: then a hash of the set does.
    odd = classes.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR rep IS NULL").limit(1).count()
    node = F.xxhash64("digest") if odd else F.col("rep")
    classes = classes.withColumn("node", node)

    postings = classes.select("node", F.explode("bands").alias("key"))
    shared = postings.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select(F.col("key").alias("s_key"))
    postings = stored(postings.join(shared, F.col("key") == F.col("s_key")).select("key", "node"), "near-postings")
    involved = postings.select(F.col("node").alias("i_node")).distinct()
    inner = stored(classes.join(involved, F.col("node") == F.col("i_node")).select("node", "rep", "digest", "s0", "s1", "s2", "s3", "bands"), "near-nodes")
    texts = stored(_texts(docs, inner, doc_id, text), "near-texts")
    sigs = inner.select("node", "s0", "s1", "s2", "s3")

    links, labels = None, None
    for turn in range(STAR_ROUNDS + 1):
        at = postings if labels is None else _mixed_keys(postings, labels)
        if turn < STAR_ROUNDS:
            centre = at.groupBy("key").agg(F.min_by("node", F.xxhash64("node", F.pmod("key", F.lit(FAMILIES)), F.lit(turn))).alias("c_node")).withColumnRenamed("key", "c_key")
            found = at.join(centre, F.col("key") == F.col("c_key")).where("node != c_node").select(F.col("c_node").alias("a"), F.col("node").alias("b")).distinct()
            if labels is not None:
                found = _apart(found, labels)
            scored = _scored(found, sigs).where(F.col("score") >= FLOOR)
            pairs = scored.groupBy("b").agg(F.max_by("a", F.struct("score", "a")).alias("a"))
        else:
            pairs = _across(at, inner.select("node", "s0", "s1", "s2", "s3", "bands"), texts)
        new = stored(confirmed(stored(pairs.select("a", "b"), "near-pairs"), texts), "near-links")
        links = new if links is None else links.union(new)
        labels = components(links)
    label = labels.select(F.col("node").alias("l_node"), "component")
    joined = classes.select("digest", "rep", "node").join(label, F.col("node") == F.col("l_node"), "left").select("digest", "rep", F.coalesce("component", "node").alias("component"))
    smallest = joined.groupBy("component").agg(F.min("rep").alias("component_id")).withColumnRenamed("component", "m_component")
    named = joined.join(smallest, F.col("component") == F.col("m_component")).select(F.col("digest").alias("d_digest"), "component_id")
    out = sig.select("doc_id", "n_shingles", "digest").join(named, F.col("digest") == F.col("d_digest"), "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _texts(docs: DataFrame, nodes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, body) of the nodes; rows of the same id whose set is another one are left out."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("body"))
    rows = rows.join(nodes.select("node", "rep", "digest"), F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "body", "digest")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1, PIECE_BYTES):
                same = [hashlib.md5(s.tobytes()).digest() == d.as_py() for s, d in zip(shingles(piece.column(1)), piece.column(2))]
                yield piece.select(["node", "body"]).filter(pa.array(same, pa.bool_()))

    return rows.mapInArrow(own, "node long, body binary")


def _mixed_keys(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, comp) of the keys that hold several components."""
    label = labels.select(F.col("node").alias("l_node"), "component")
    rows = postings.join(label, F.col("node") == F.col("l_node"), "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    several = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select(F.col("key").alias("m_key"))
    return stored(rows.join(several, F.col("key") == F.col("m_key")).select("key", "node", "comp"), "near-mixed")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose nodes are in different components."""
    one = labels.select(F.col("node").alias("x_node"), F.col("component").alias("x"))
    two = labels.select(F.col("node").alias("y_node"), F.col("component").alias("y"))
    rows = pairs.join(one, F.col("a") == F.col("x_node"), "left").join(two, F.col("b") == F.col("y_node"), "left")
    return rows.where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")


def _scored(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    one = sigs.toDF("a_node", "p0", "p1", "p2", "p3")
    two = sigs.toDF("b_node", "q0", "q1", "q2", "q3")
    rows = pairs.join(one, F.col("a") == F.col("a_node")).join(two, F.col("b") == F.col("b_node"))
    return rows.select("a", "b", estimate("p", "q").alias("score"))


def _wide(texts: DataFrame) -> DataFrame:
    """(node, wide): the packed low bits of WIDE minima."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1, PIECE_BYTES):
                longs = packed(minima(shingles(piece.column(1)), WIDE)).tolist()
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(longs, pa.list_(pa.int64()))], names=["node", "wide"])

    return texts.mapInArrow(signed, "node long, wide array<long>")


def _across(at: DataFrame, sigs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs of nodes of different components that share a key and whose estimates reach the floors; each pair once."""
    some = at.select(F.col("node").alias("g_node")).distinct()
    wide = _wide(texts.join(some, F.col("node") == F.col("g_node")).select("node", "body"))
    full = stored(sigs.join(wide.withColumnRenamed("node", "g_node"), F.col("node") == F.col("g_node")).drop("node"), "near-wide")
    rows = at.join(full, F.col("node") == F.col("g_node")).select("key", "node", "comp", "s0", "s1", "s2", "s3", "bands", "wide")
    one = rows.toDF("key", "a", "a_comp", "p0", "p1", "p2", "p3", "a_bands", "a_wide")
    two = rows.toDF("b_key", "b", "b_comp", "q0", "q1", "q2", "q3", "b_bands", "b_wide")
    here = F.array_position(F.zip_with("a_bands", "b_bands", lambda x, y: x == y), True) == F.array_position("a_bands", F.col("key"))
    differ = F.aggregate(F.zip_with("a_wide", "b_wide", _differing), F.lit(0), lambda n, d: n + d)
    close = (estimate("p", "q") >= FLOOR) & (_corrected(differ, WIDE) >= WIDE_FLOOR) & here
    met = one.join(two, (F.col("key") == F.col("b_key")) & (F.col("a_comp") < F.col("b_comp")) & close)
    return met.select("a", "b")
