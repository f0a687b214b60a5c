"""The registered queries over the operators, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, classlm, decontaminate, extract, linededup, mixing, neardup, quality, secrets, sql, warc
from .common import run_dir, stored, table


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.cascade(table(spark, sf_dir, "documents"), signals=True, keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _spans_text(spans: str) -> str:
    """SQL for kind:start:end of an array of spans, comma-joined."""
    return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op2_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classlm.score(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        F.expr("aggregate(found.hits, 0L, (n, h) -> n + h.end - h.start)").alias("n_hit"),
        F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (F.size("found.hits") > 0).alias("contaminated"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("doc_id", "text", "removed_lines")


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secrets.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = f"filter(secrets, s -> s.kind IN {secrets.BASE})"
    return scanned.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(secrets, s -> s.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in secrets.BASE],
        F.sha2(F.expr(_spans_text(base)), 256).alias("base_sha256"),
        F.expr(_spans_text("secrets")).alias("spans"),
    )


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(1).select(F.lit(-7).cast("bigint").alias("conv_id"), F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"), F.lit(PROBE).alias("text")).withColumn("turn", F.col("turn").cast("bigint"))
    made = chat.format_chat(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own))
    turns = chat.read_back(F.col("formatted"))
    under = chat.masked(F.col("formatted"), F.col("loss"))
    return made.select("conv_id", turns.alias("turns"), under.alias("under"), F.char_length("formatted").cast("bigint").alias("formatted_chars")).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.expr("array_join(transform(turns, t -> concat(t.role, '\\n', t.text, '\\n')), '')"), 256).alias("turns_sha256"),
        F.char_length("under").cast("bigint").alias("loss_chars"),
        F.sha2("under", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix(table(spark, sf_dir, "documents"), weight=mixing.by_length(mixing.size_of(F.col("text"))))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"))


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{run_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(warc.resolve(table(spark, sf_dir, "pages")), path)
    return warc.with_originals(stored(warc.read(spark, path), "warc-index"))


#: The conversation that the chat query adds says this in both its turns.
PROBE = "\\### Assistant: </turn> ok"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_class_lm": op2_class_lm,
    "op3_decontamination": op3_decontamination,
    "op4_line_dedup": op4_line_dedup,
    "op5_near_dup": op5_near_dup,
    "op6_secret_scan": op6_secret_scan,
    "op7_chat_format": op7_chat_format,
    "op8_source_mix": op8_source_mix,
    "op9_quality_rules": op9_quality_rules,
    "op10_warc_revisits": op10_warc_revisits,
}

#: The other queries rest on random draws, trained models, wrappers or spans of the method's own; tests hold them by brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": sql.DECONTAMINATION,
    "op4_line_dedup": sql.LINE_DEDUP,
    "op5_near_dup": sql.NEAR_DUP,
    "op7_chat_format": sql.chat(PROBE),
    "op9_quality_rules": sql.QUALITY,
    "op10_warc_revisits": sql.WARC,
}
