"""The queries that SQL can express, in DuckDB's SQL over the same tables."""

from __future__ import annotations

from .decontaminate import WINDOW as HIT_WINDOW
from .linededup import DEN, NUM
from .neardup import SHINGLE
from .quality import WINDOW as REPEAT_WINDOW
from .warc import MIN_BYTES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _leads(width: int) -> str:
    """The following words of a window, as columns w1 to w(width - 1)."""
    return ", ".join(f"lead(w, {k}) OVER o AS w{k}" for k in range(1, width))


def _gram(width: int, size: str) -> str:
    """A window's words joined by a space: w and the first ``size`` - 1 that follow."""
    return "concat_ws(' ', w, " + ", ".join(f"CASE WHEN {size} > {k} THEN w{k} END" for k in range(1, width)) + ")"


def _normal(column: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({column}, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


#: Windows of the items (their own sizes, HIT_WINDOW at most) sought at every word of the documents, with each size that occurs.
DECONTAMINATION = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_normal("text")} AS ws FROM documents),
b AS MATERIALIZED (SELECT row_number() OVER () AS rid, item_id, {_normal("text")} AS ws FROM benchmark),
bw AS (SELECT rid, item_id, len(ws) AS n, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM b),
bl AS (SELECT *, {_leads(HIT_WINDOW)} FROM bw WINDOW o AS (PARTITION BY rid ORDER BY pos)),
grams AS MATERIALIZED (
  SELECT DISTINCT item_id, least(n, {HIT_WINDOW}) AS size, {_gram(HIT_WINDOW, "n")} AS g FROM bl WHERE pos + least(n, {HIT_WINDOW}) - 1 <= n),
dw AS (SELECT rid, len(ws) AS n, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM d),
dl AS MATERIALIZED (SELECT *, {_leads(HIT_WINDOW)} FROM dw WINDOW o AS (PARTITION BY rid ORDER BY pos)),
found AS MATERIALIZED (
  SELECT rid, pos, item_id, grams.size AS size
  FROM (SELECT dl.rid, dl.pos, s.size, {_gram(HIT_WINDOW, "s.size")} AS g FROM dl, (SELECT DISTINCT size FROM grams) AS s WHERE pos + s.size - 1 <= n) AS p
  JOIN grams ON p.size = grams.size AND p.g = grams.g),
reach AS (SELECT rid, pos, max(pos + size - 1) AS upto FROM found GROUP BY rid, pos),
hit AS (
  SELECT rid, count(*) AS n_hit
  FROM (SELECT dl.rid, max(upto) OVER (PARTITION BY dl.rid ORDER BY dl.pos ROWS BETWEEN {HIT_WINDOW - 1} PRECEDING AND CURRENT ROW) >= dl.pos AS is_hit
        FROM dl LEFT JOIN reach ON dl.rid = reach.rid AND dl.pos = reach.pos) AS c
  WHERE is_hit GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM found) AS i GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
"""

#: The signals, then the production rules as one condition.
QUALITY = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
w AS (SELECT rid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM d),
l AS (SELECT *, {_leads(REPEAT_WINDOW)} FROM w WINDOW o AS (PARTITION BY rid ORDER BY pos)),
g AS (SELECT rid, pos, CASE WHEN w{REPEAT_WINDOW - 1} IS NOT NULL THEN {_gram(REPEAT_WINDOW, str(REPEAT_WINDOW))} END AS g FROM l),
r AS (SELECT rid, pos, g IS NOT NULL AND count(*) OVER (PARTITION BY rid, g) > 1 AS again FROM g),
h AS (SELECT rid, max(CAST(again AS INT)) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN {REPEAT_WINDOW - 1} PRECEDING AND CURRENT ROW) AS hit FROM r),
n AS (SELECT rid, sum(hit) AS n_repeat_words FROM h GROUP BY rid),
f AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines
  FROM d LEFT JOIN n USING (rid)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 2 * n_symbols > n_words OR (n_words > 0 AND NOT (2 * n_words <= word_chars AND word_chars <= 20 * n_words))
    OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines)) AS kept
FROM v
"""


def chat(probe: str) -> str:
    """Turns as they were, and the length of what the template makes of them."""

    def escape(text: str) -> str:
        return f"replace(replace({text}, '\\', '\\\\'), '<|', '<\\|')"

    own = f"SELECT -7 AS conv_id, 0 AS turn, 'user' AS role, '{probe}' AS text UNION ALL SELECT -7, 1, 'assistant', '{probe}'"
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role IS NOT DISTINCT FROM 'assistant' AS loss
  FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL {own}) AS c),
s AS (
  SELECT *, length('<|turn:|><|end|>') + 1 + length(replace({escape("role")}, '|>', '|\\>'))
    + length({escape("text")}) + CASE WHEN starts_with(text, '|') THEN 1 ELSE 0 END AS chars
  FROM t),
m AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE loss), '') AS under, sum(chars) AS chars
  FROM s GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(under) AS BIGINT) AS loss_chars,
  sha256(under) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM m
"""


WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
o AS (SELECT *, strlen(body) AS size, min(page_id) OVER (PARTITION BY body) AS original FROM p),
k AS (SELECT *, size >= {MIN_BYTES} AND page_id IS DISTINCT FROM original AND original IS NOT NULL AS again FROM o)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN original END AS refers_to
FROM k
"""


_WORDS = r"[^\x20\x09-\x0D]+"

#: Line sets joined on their rarest words; every pair is verified, and each line but the first of its kind goes.
LINE_DEDUP = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS t, unnest(range(1, len(ls) + 1)) AS line FROM d),
s AS MATERIALIZED (SELECT rid, doc_id, line, list_sort(list_distinct(regexp_extract_all(lower(t), '{_WORDS}'))) AS ws FROM l WHERE regexp_matches(t, '{_WORDS}')),
c AS MATERIALIZED (SELECT row_number() OVER () AS cid, ws, len(ws) AS n, min(row(doc_id, line)) AS head FROM s GROUP BY ws),
f AS (SELECT w, count(*) AS k FROM (SELECT unnest(ws) AS w FROM s) AS e GROUP BY w),
p AS (SELECT cid, n, w, row_number() OVER (PARTITION BY cid ORDER BY k, w) AS pos FROM (SELECT cid, n, unnest(ws) AS w FROM c) AS e JOIN f USING (w)),
x AS MATERIALIZED (SELECT cid, n, w FROM p WHERE pos <= n - ({NUM} * n + {DEN - 1}) // {DEN} + 1),
pairs AS (SELECT DISTINCT a.cid AS a, b.cid AS b FROM x AS a JOIN x AS b ON a.w = b.w AND a.cid < b.cid AND {DEN} * least(a.n, b.n) >= {NUM} * greatest(a.n, b.n)),
met AS (SELECT a, b, u.head AS ha, v.head AS hb, u.n + v.n AS n, len(list_intersect(u.ws, v.ws)) AS common FROM pairs JOIN c AS u ON a = u.cid JOIN c AS v ON b = v.cid),
gone AS MATERIALIZED (SELECT DISTINCT CASE WHEN ha < hb THEN b ELSE a END AS cid FROM met WHERE {DEN} * common >= {NUM} * (n - common)),
cut AS (
  SELECT rid, list(line) AS cut FROM s JOIN c USING (ws) LEFT JOIN gone ON c.cid = gone.cid
  WHERE gone.cid IS NOT NULL OR row(doc_id, line) IS DISTINCT FROM head GROUP BY rid)
SELECT doc_id, CASE WHEN cut IS NULL THEN text ELSE coalesce(array_to_string(list_filter(ls, lambda x, i: NOT list_contains(cut, i)), chr(10)), '') END AS text,
  CAST(coalesce(len(cut), 0) AS BIGINT) AS removed_lines
FROM d LEFT JOIN cut USING (rid)
"""

#: Documents that share a shingle, counted; links of the similar ones, followed until nothing new is reached.
NEAR_DUP = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_WORDS}') AS ws FROM documents),
t AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM d),
l AS (SELECT *, {_leads(SHINGLE)} FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
g AS MATERIALIZED (SELECT DISTINCT doc_id, {_gram(SHINGLE, "n")} AS g FROM l WHERE pos + least(n, {SHINGLE}) - 1 <= n),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g AS a JOIN g AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS MATERIALIZED (SELECT a, b FROM met JOIN n AS u ON a = u.doc_id JOIN n AS v ON b = v.doc_id WHERE 100 * common >= 75 * (u.n + v.n - common)),
edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT edge.b, reach.root FROM reach JOIN edge ON reach.doc_id = edge.a),
c AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
