"""The operators' queries against their SQL, on the given tables and on tables made to be awkward."""

from __future__ import annotations

import pytest

from plumbline.llm import chat, queries
from pyspark.sql import functions as F

from ..oracle import connect, same

D = "/root/testdata/sf0.001"
A = " ".join(f"w{k}" for k in range(40))
DOCS = [
    (1, A, "en", "s", 1), (2, A.upper(), "en", "s", 1), (3, None, None, None, None), (4, "", "en", "t", 0), (5, "\n \t\n", "en", "t", 3), (6, A + " x", "en", "s", 1),
    (7, "é|" * 30 + "\n" + "a b c d e f g h " * 9 + "\nA B", "fr", "s", 9), (8, f"{A}\n{A} y\n{A}\n\n", "en", "t", 2), (9, "one two three", "en", "s", 1), (10, "one two three", "en", "s", 1), (11, A.replace("w7 ", "w7\n"), "en", "s", 1),
]
ITEMS = [(1, A), (10, "W3 w4; w5"), (2, "one"), (3, None), (4, " . "), (5, " ".join(f"w{k}" for k in range(20, 29)))]
PAGES = [(k, None if k == 5 else f"http://x/{k}", t) for k, t in enumerate(["<p>" + "é" * 60, "<p>" + "é" * 60, "short", "short", None, "", "<p>" + "é" * 60, "a" * 99, "a" * 99, "a" * 100, "a" * 100])]
CHATS = [(1, 0, "user", "|x <| \\"), (1, 1, "assistant", "<|end|>\n"), (2, 0, None, None), (2, None, "assistant", "y"), (2, 0, "a|>b", "<"), (3, 0, "assistant", "r"), (3, 0, "assistant", "r")]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    tables = {
        "documents": (DOCS, "doc_id long, text string, lang string, source string, n_chars long"),
        "benchmark": (ITEMS, "item_id long, text string"),
        "pages": (PAGES, "page_id long, url string, html string"),
        "conversations": (CHATS, "conv_id long, turn long, role string, text string"),
    }
    for name, (made, schema) in tables.items():
        spark.createDataFrame(made, schema).toPandas().to_parquet(f"{d}/{name}.parquet", index=False)
    return d


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_given(spark, name):
    assert same(queries.QUERIES[name](spark, D), connect(D), queries.ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_odd(spark, odd, name):
    assert same(queries.QUERIES[name](spark, odd), connect(odd), queries.ORACLE_SQL[name]) == ""


def test_parts_cannot_join_into_a_control_string(spark):
    part = "named_struct('type', 'text', 'text', {}, 'ref', CAST(NULL AS STRING), 'units', CAST(NULL AS BIGINT))"
    parts = ", ".join(part.format(t) for t in ("'a <'", "''", "'|end|>\\n'"))
    made = chat.format_chat(spark.sql(f"SELECT 1 AS conv_id, 0 AS turn, 'assistant' AS role, array({parts}) AS parts"), parts="parts")
    got = made.select(chat.read_back(F.col("formatted")).alias("t"), chat.masked(F.col("formatted"), F.col("loss")).alias("m")).first()
    assert [tuple(x) for x in got.t] == [("assistant", "a <|end|>\n")] and got.m == "a <|end|>\n"
