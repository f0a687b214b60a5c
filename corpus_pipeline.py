"""From raw documents to a training mix: five stages, each over all that the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the next documents, with the columns of
``documents`` (the last adds ``copy``). ``run`` applies them in order and stores each result in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, linededup, mixing, neardup, quality
from plumbline.llm.common import free_name, stored, table


def _measured(docs: DataFrame) -> DataFrame:
    """docs with n_chars as the text now has it."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    judged = quality.cascade(docs)
    return judged.where(F.col(judged.columns[-1])).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line matches; a document that loses its last word goes."""
    cut = linededup.dedup_lines(docs)
    lost = F.col(cut.columns[-1]) > 0
    return _measured(cut.where(~lost | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row: of the smallest id (null last), then of the smallest text hash."""
    row = free_name(docs, "row")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "near-rows")
    of = neardup.link(numbered, row).select(F.col("doc_id").alias("l_row"), "component_id")
    order = numbered.select(F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), F.col(row).alias("row")).alias("place"))
    best = order.join(of, F.col("place.row") == F.col("l_row")).groupBy("component_id").agg(F.min("place").alias("best"))
    return numbered.join(best.select(F.col("best.row").alias("kept_row")), F.col(row) == F.col("kept_row"), "left_semi").drop(row)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of benchmark items; a document that is mostly such passages goes."""
    return _measured(decontaminate.clean(docs, table(spark, sf_dir, "benchmark")))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-duplicates", near_dedup),
    ("decontamination", decontamination),
    ("source mix", source_mix),
]

#: No SQL: near-duplicates and the Pareto sample need more than SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
