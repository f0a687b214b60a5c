"""What the operators of this package share: reading tables, cutting lineage, and tokens over Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; bounds the size of its arrays.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``, or one for a local master.

    On a cluster without that setting there is no safe choice, so this raises ValueError.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "/tmp/plumbline-checkpoints"
    return at.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's tables; see ``clear``."""
    return f"{shared_dir(spark)}/plumbline/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    return stored_plain(df, what, [])


def stored_plain(df: DataFrame, what: str, plain: Iterable[str]) -> DataFrame:
    """As ``stored``. ``plain`` names Parquet columns of values that seldom recur: a dictionary costs a look-up for each, both ways, and saves nothing."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.options(**{f"parquet.enable.dictionary#{c}": "false" for c in plain}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has stored; results that aren't written elsewhere can't be read after it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, in either case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def binary(name: str):
    """The column's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b"").cast("binary"))


def pieces(batch: pa.RecordBatch, text: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch, each with about ``limit`` bytes in the binary column at position ``text`` (a longer row stands alone)."""
    col = batch.column(text)
    if not len(col):
        return
    ends = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Tokens:
    """The whitespace-separated words of a binary array's texts, ASCII letters in lower case, as flat arrays.

    ``start`` and ``end`` are offsets into ``data``; ``doc`` is each word's row; ``first`` is where each row's words begin
    (one more entry than rows).
    """

    _SPACE = np.zeros(256, dtype=bool)
    _SPACE[[0x20, 9, 10, 11, 12, 13]] = True

    def __init__(self, col: pa.BinaryArray):
        n = len(col)
        ends = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        raw = col.buffers()[2]
        data = raw.to_pybytes()[ends[0] : ends[-1]].lower() if raw is not None else b""
        bounds = ends - ends[0]
        self.data = np.frombuffer(data, dtype=np.uint8)
        # A word begins at a non-space byte after a space, or at a row's first byte.
        word = np.zeros(len(data) + 1, dtype=bool)
        word[:-1] = ~self._SPACE[self.data]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        cut = bounds[:-1][bounds[:-1] < bounds[1:]]
        begins[cut] = word[cut]
        self.start = np.flatnonzero(begins[:-1])
        stops = np.zeros(len(data) + 1, dtype=bool)
        stops[1:] = word[:-1] & ~word[1:]
        inner = bounds[1:][bounds[:-1] < bounds[1:]]
        stops[inner] |= word[inner - 1]
        self.end = np.flatnonzero(stops)
        self.first = np.searchsorted(self.start, bounds)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial over random byte values, then a finaliser."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        powers = _powers(len(self.data))
        sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUES[self.data] * powers[0][: len(self.data)], out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * powers[1][self.start]
        return mixed(h ^ ((self.end - self.start).astype(np.uint64) << np.uint64(56)))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit affects every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def random_words(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, n, dtype=np.uint64)


_BYTE_VALUES = random_words(256, 20)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_TABLES: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """The powers of the polynomial's base and of its inverse modulo 2**64, at least n of each."""
    if not _TABLES or len(_TABLES[0]) < n:
        # In powers of two: longer texts then seldom make them anew, and short ones leave them small in each worker.
        size, made = 1 << max(18, (n - 1).bit_length()), []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps))
        _TABLES[:] = made
    return _TABLES


def windows(h: np.ndarray, first: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's windows of ``width`` words, in order, and where each row's windows begin.

    A row with fewer words, but not none, has one window of all its words.
    """
    salt = random_words(width, seed) | np.uint64(1)
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1] - first[:-1], count)
    size = np.repeat(np.minimum(n, width), count)
    out = size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    short = bool((size < width).any())
    last = len(h) - 1
    for k in range(width):
        term = h[np.minimum(at + k, last)] * salt[k] if len(at) else np.zeros(0, np.uint64)
        out += np.where(k < size, term, np.uint64(0)) if short else term
    return mixed(out), begin
