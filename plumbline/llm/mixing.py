"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

A source's target is its share, by weight, of the total size, at most ``cap`` times its own size; what a cap cuts off is shared
among the others by weight. Within a source, a document expects ``level * weight`` copies, ``cap`` at most; the level makes the expected sizes sum to the
target, so weights shift copies between documents and leave the source's share as it is. A document gets the whole copies for certain. The fraction left is its inclusion probability p: documents are ranked by the odds of a uniform
number u divided by the odds of p, lowest first, and taken until the source's target is met as nearly as whole documents can.

No task holds a source: the rank is a 24-bit key, and the key at which the target is met is found eight bits at a time from
sums over (source, digit), 256 rows a source. Only documents of that one key are ordered exactly.

Defined results: weights are rounded to an eighth of an octave, so that a source has few of them; a document of weight 0 comes last;
a null text has size 0 and is never taken; sources go by code point, null last; repeated rows share their
random number and are taken one after another; an empty table gives an empty result; other columns pass through, and a result
column that clashes gets leading underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, stored

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Most sources whose plan is broadcast (about 60 bytes each); beyond it the join shuffles, and splits hot sources.
BROADCAST_SOURCES = 100_000
DIGITS = 3


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """The columns of ``sizes`` (source, source_size and others) with ``target``: sources in order weigh ``weights``, repeating.

    The targets fill up like vessels: each holds min(cap * size, weight * level), and the level makes them sum to the total.
    Sources reach their caps in the order of cap / weight, so running sums give the level in one pass. One row a source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    df = sizes.withColumn("w", w).withColumn("full", F.col("source_size") * float(cap))
    by_level = Window.orderBy(F.col("full") / F.col("w"), F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    df = df.withColumn("full_before", F.sum("full").over(by_level.rowsBetween(Window.unboundedPreceding, -1))).withColumn("w_left", F.sum("w").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    total = F.sum("source_size").over(everything)
    df = df.withColumn("level", (total - F.coalesce("full_before", F.lit(0.0))) / F.col("w_left"))
    # The first source that doesn't reach its cap at the level computed there sets the level for it and all after it.
    open_ = F.when(F.col("level") * F.col("w") < F.col("full"), F.struct((F.col("full") / F.col("w")).alias("at"), F.col("level").alias("level")))
    df = df.withColumn("first_open", F.min(open_).over(everything))
    return df.select(*sizes.columns, F.when(F.col("first_open").isNull(), F.col("full")).otherwise(F.least(F.col("full"), F.col("first_open.level") * F.col("w"))).alias("target"))


def _levels(plan: DataFrame, cells: DataFrame, cap: float) -> DataFrame:
    """``plan`` (source, source_size, target) with ``level``: copies that weight 1 expects, null if all documents reach the cap.

    ``cells`` (source, weight, cell_size) are few a source. By falling weight, each cell reaches the cap before the next; the first
    that doesn't, with all heavier ones at the cap, sets the level.
    """
    own = plan.select(F.col("source").alias("t_source"), "target")
    df = cells.where("cell_size > 0").join(own, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    by = Window.partitionBy("source").orderBy(F.desc("weight"))
    full = F.coalesce(F.sum(F.col("cell_size") * float(cap)).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(F.col("cell_size") * F.col("weight")).over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    df = df.withColumn("at", (F.col("target") - full) / F.when(rest > 0, rest))
    open_ = F.when(F.col("at") * F.col("weight") < cap, F.struct((-F.col("weight")).alias("order"), F.col("at").alias("level")))
    first = df.groupBy("source").agg(F.min(open_).alias("o"), F.max("weight").alias("most")).select(F.col("source").alias("l_source"), F.when(F.col("most") > 0, F.col("o.level")).alias("level"))
    return plan.join(first, F.col("source").eqNullSafe(F.col("l_source")), "left").drop("l_source")


def _joined(rows: DataFrame, plan: DataFrame, small: bool) -> DataFrame:
    p = F.broadcast(plan) if small else plan
    return rows.join(p.withColumnRenamed("source", "p_source"), F.col("source").eqNullSafe(F.col("p_source")), "left").drop("p_source")


def allocate(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = 8) -> DataFrame:
    """``copies`` for rows of (id, source, size, weight): all columns, with source_size, target and copies.

    ``id`` is any hash that tells rows apart; rows that share it and the size share their random number.
    """
    rounded = F.pow(F.lit(2.0), F.round(F.log2(F.when(F.col("weight") > 0, F.col("weight"))) * 8) / 8)
    base = stored(rows.withColumn("weight", F.coalesce(rounded, F.lit(0.0))), "mix-sizes")
    cells = base.groupBy("source", "weight").agg(F.sum("size").alias("cell_size"))
    plan = stored(_levels(targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, cap), cells, cap), "mix-plan")
    small = plan.count() <= BROADCAST_SOURCES

    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.col("size")), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)
    expected = F.when(F.col("size") > 0, F.least(F.lit(float(cap)), F.coalesce(F.col("level") * F.col("weight"), F.lit(float(cap))))).otherwise(F.lit(0.0))
    df = _joined(base, plan, small).withColumn("expected", expected).withColumn("whole", F.floor("expected"))
    p = F.col("expected") - F.col("whole")
    odds = (F.col("u") / (1 - F.col("u"))) / F.when(p > 0, p / (1 - p))
    # q / (1 + q) keeps the order and lies in (0, 1); documents whose probability is 0 come last, those at the cap not at all.
    df = df.withColumn("u", u).withColumn("rank", F.when(p > 0, odds / (1 + odds)).otherwise(F.col("u") / 2**20 + (1 - 2**-20)))
    can = (F.col("size") > 0) & (F.col("whole") < cap)
    top = 1 << (8 * DIGITS)
    df = df.withColumn("key", F.when(can, F.least(F.floor(F.col("rank") * top), F.lit(top - 1)))).drop("expected", "weight", "level")
    df = stored(df, "mix-ranks")

    # What is left for the fraction, and the key at which it is met: one digit at a time.
    left = df.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("left")).withColumn("prefix", F.lit(0).cast("bigint"))
    for digit in range(DIGITS):
        shift = 8 * (DIGITS - 1 - digit)
        cells = _joined(df.where("key is not null"), left, small).where(F.shiftright("key", shift + 8) == F.col("prefix"))
        sums = cells.groupBy("source", F.shiftright("key", shift).alias("cell")).agg(F.sum("size").alias("words"))
        w = Window.partitionBy("source").orderBy("cell")
        run = _joined(sums, left, small).withColumn("before", F.coalesce(F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        # The last cell that begins at or below what is left; if even the first can't be afforded, it is looked into all the same.
        hit = run.where((F.col("before") <= F.col("left")) | (F.col("before") == 0)).groupBy("source").agg(F.max_by(F.struct("cell", "before"), "cell").alias("h"))
        left = stored(
            left.join(hit.withColumnRenamed("source", "h_source"), F.col("source").eqNullSafe(F.col("h_source")), "left").select("source", (F.col("left") - F.coalesce("h.before", F.lit(0))).alias("left"), F.coalesce("h.cell", F.lit(-1).cast("bigint")).alias("prefix")),
            "mix-left",
        )
    df = _joined(df, left, small)
    within = Window.partitionBy("source").orderBy("rank", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = df.where(F.col("key") == F.col("prefix")).withColumn("upto", F.sum("size").over(within)).withColumn("extra", (F.col("upto") - F.col("size") / 2 <= F.col("left")).cast("bigint")).drop("upto")
    rest = df.where(~F.col("key").eqNullSafe(F.col("prefix"))).withColumn("extra", F.coalesce((F.col("key") < F.col("prefix")).cast("bigint"), F.lit(0)))
    return rest.unionByName(edge).withColumn("copies", F.col("whole") + F.col("extra")).drop("whole", "extra", "rank", "key", "left", "prefix", "u")


def by_length(size: Column) -> Column:
    """The production weights: texts of 50 to 5,000 words count twice as much as shorter and longer ones."""
    return F.when(size.between(50, 5000), 2.0).otherwise(1.0)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = 8) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): what the mix takes of each document, without the texts."""
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{source}`")).alias("id"),
        F.col(f"`{source}`").alias("source"),
        size_of(F.col(f"`{text}`")).alias("size"),
        (weight if weight is not None else F.lit(1.0)).cast("double").alias("weight"),
    )
    return allocate(rows, weights, cap, seed).drop("id")


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """docs with each row repeated as often as the mix takes it (none: left out), and ``copy`` counting from 0.

    The rows go through the sampling with all their columns, so repeated ids need no join back.
    """
    inner = {c: f"c{n}" for n, c in enumerate(docs.columns)}
    rows = docs.select(
        F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{source}`")).alias("id"),
        F.col(f"`{source}`").alias("source"),
        size_of(F.col(f"`{text}`")).alias("size"),
        F.lit(1.0).alias("weight"),
        F.struct(*[F.col(f"`{c}`").alias(i) for c, i in inner.items()]).alias("row"),
    )
    copy = free_name(docs, "copy")
    taken = allocate(rows, **how).where("copies > 0")
    return taken.select(*[F.col(f"row.{i}").alias(c) for c, i in inner.items()], F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias(copy))
