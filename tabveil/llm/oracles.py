"""DuckDB SQL for the corpus queries that SQL can express, written from what they compute and not from how."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""
WITH d AS (
  SELECT doc_id, source, len({WORDS}) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS turn
  FROM d GROUP BY source
), w AS (
  SELECT *, CAST(turn % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS most FROM s
), f AS (SELECT *, most / weight AS full_at FROM w
), l AS (
  SELECT *, ((SELECT sum(source_size) FROM w)::DOUBLE - coalesce((SELECT sum(b.most) FROM f b WHERE (b.full_at, b.turn) < (f.full_at, f.turn)), 0))
         / (SELECT sum(b.weight) FROM f b WHERE (b.full_at, b.turn) >= (f.full_at, f.turn)) AS level
  FROM f
), t AS (
  SELECT source, source_size, turn, least(most, weight * coalesce((SELECT max(level) FROM l WHERE level <= full_at), 1e300)) AS target FROM l
), u AS (
  SELECT d.*, t.source_size, t.turn, t.target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u,
         CASE WHEN t.source_size > 0 THEN floor(round_even(t.target, 0) / t.source_size) ELSE 0 END AS whole
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT *, greatest(0.0, least(CAST(size AS DOUBLE), round_even(target, 0) - whole * source_size - u)) AS part FROM u
), c AS (
  SELECT *, CAST(whole * size + part AS BIGINT) AS taken, CASE turn % 3 WHEN 0 THEN -0.5 WHEN 1 THEN 0.0 ELSE 0.5 END::DOUBLE AS slope FROM p
), n AS (
  SELECT *, CASE WHEN taken > 0 THEN CAST(whole AS BIGINT) + CASE WHEN part > 0 THEN 1 ELSE 0 END ELSE 0 END AS copies FROM c
), x AS (
  SELECT *, least(1.0, u / target) AS a, least(1.0, (u + (copies - 1) * source_size) / target) AS b FROM n
)
SELECT doc_id, size, source_size, target, taken, copies,
       round(CASE WHEN copies = 0 THEN NULL WHEN slope = 0 THEN a ELSE (sqrt(greatest((1 - slope) * (1 - slope) + 4 * slope * a, 0)) - (1 - slope)) / (2 * slope) END + 0.0, 9) AS position,
       round(CASE WHEN copies = 0 THEN NULL WHEN slope = 0 THEN b ELSE (sqrt(greatest((1 - slope) * (1 - slope) + 4 * slope * b, 0)) - (1 - slope)) / (2 * slope) END + 0.0, 9) AS last_position
FROM x
"""

OP3 = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents
), w AS (
  SELECT r, doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT r, doc_id, x, unnest(range(n - 49)) AS i FROM d WHERE n >= 50)
), first AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)
), hit AS (SELECT r, i FROM w JOIN first USING (s) WHERE least < doc_id
), edge AS (
  SELECT r, i, i > lag(i + 50, 1, -1) OVER (PARTITION BY r ORDER BY i) AS new FROM hit
), run AS (SELECT r, i, sum(CAST(new AS INTEGER)) OVER (PARTITION BY r ORDER BY i) AS k FROM edge
), gone AS (SELECT r, k, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY r, k
), kept AS (
  SELECT r, a AS pos, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS since FROM gone
), parts AS (
  SELECT r, count(*) AS n_spans, CAST(sum(b - pos) AS BIGINT) AS n_removed, string_agg(substr(x, 2 * since + 1, 2 * (pos - since)), '' ORDER BY pos) || substr(any_value(x), 2 * max(b) + 1) AS x
  FROM kept JOIN d USING (r) GROUP BY r
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(parts.x, d.x))) AS kept_sha256
FROM d LEFT JOIN parts USING (r)
"""

OP4 = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT r, w[i : i + 3] AS s FROM (SELECT r, w, unnest(range(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 4)
  UNION SELECT r, w FROM d WHERE len(w) BETWEEN 1 AND 3
), n AS (SELECT r, count(*) AS n FROM g GROUP BY r
), c AS (SELECT x.r AS a, y.r AS b, count(*) AS c FROM g x JOIN g y USING (s) WHERE x.r <> y.r GROUP BY ALL
), link AS (
  SELECT a, b FROM c JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), reach(a, b) AS (
  SELECT r, r FROM n UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
), least AS (SELECT reach.a AS r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY reach.a
), degree AS (SELECT a AS r, count(*) AS n_links FROM link GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, CASE WHEN n IS NULL THEN doc_id ELSE component_id END AS component_id, coalesce(n_links, 0) AS n_links
FROM d LEFT JOIN n USING (r) LEFT JOIN least USING (r) LEFT JOIN degree USING (r)
"""

OP5 = r"""
WITH d AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM (SELECT DISTINCT doc_id, text FROM documents))
), b AS (
  SELECT item_id, len(w) AS n, least(len(w), 20) AS span, unnest(w) AS word, generate_subscripts(w, 1) AS j
  FROM (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark)
), same AS (SELECT doc_id, item_id, n, span, i - j AS start, j FROM d JOIN b USING (word)
), near AS (
  SELECT *, count(*) OVER place AS n_match, count(*) OVER (PARTITION BY doc_id, item_id, start ORDER BY j RANGE BETWEEN CURRENT ROW AND 19 FOLLOWING) AS c
  FROM same WINDOW place AS (PARTITION BY doc_id, item_id, start)
), held AS (SELECT * FROM near WHERE 100 * c >= 80 * span)
SELECT doc_id, item_id, CAST(min(start) AS BIGINT) AS start_word, CAST(max(n_match) AS BIGINT) AS n_match, CAST(max(n) AS BIGINT) AS n_words
FROM held GROUP BY doc_id, item_id
"""

OP6 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, text, {WORDS} AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), windows AS (
  SELECT r, i, w[i : i + 4] AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM windows) WHERE c > 1
), repeated AS (SELECT r, count(DISTINCT i + k) AS n FROM again, range(5) AS x(k) GROUP BY r
), l AS (
  SELECT r, doc_id, source, pos, t, lower(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS key, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT r, doc_id, source, unnest(lines) AS t, generate_subscripts(lines, 1) AS pos FROM d)
), boiler AS (SELECT source, key FROM l WHERE n > 0 GROUP BY source, key HAVING count(DISTINCT doc_id) > 20
), marked AS (SELECT l.*, b.key IS NOT NULL AND n > 0 AS gone FROM l LEFT JOIN boiler b ON l.source IS NOT DISTINCT FROM b.source AND l.key = b.key
), per AS (
  SELECT r, coalesce(sum(n) FILTER (gone), 0) AS b, count(*) FILTER (n > 0) - count(DISTINCT t) FILTER (n > 0) AS dup,
         coalesce(string_agg(t, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS rest
  FROM marked GROUP BY r
), o AS (
  SELECT doc_id, text, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         dup AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words, CAST(b AS BIGINT) AS n_boiler_words, rest
  FROM d JOIN per USING (r) LEFT JOIN repeated USING (r)
), f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM o)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_boiler_words, base_failed,
       NOT base_failed AND n_words - n_boiler_words >= 10 AND 100 * (n_words - n_boiler_words) >= 30 * n_words AS kept,
       CASE WHEN text IS NULL THEN NULL ELSE sha256(rest) END AS kept_sha256
FROM f
"""

OP7 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT r, doc_id, pos, t, regexp_replace(regexp_replace(t, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS bare
  FROM (SELECT r, doc_id, unnest(lines) AS t, generate_subscripts(lines, 1) AS pos FROM d)
), k AS (SELECT r, doc_id, pos, t, CASE WHEN length(bare) >= 40 THEN {LOWER.format("bare")} END AS key FROM l
), common AS (SELECT key, max(doc_id) AS keeper FROM k WHERE key IS NOT NULL GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (SELECT k.*, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN common USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(t, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""

def _backoff(one: str, two: str, three: str, words: str) -> str:
    """The log score of a word from the counts of its n-grams and their histories (h1, h2) less what is subtracted."""
    sub = lambda c: c.format(one)
    alone = f"ln(greatest({sub('c1 {}')}, 1) / greatest({words}, 1)::DOUBLE)"
    pair = f"CASE WHEN i < 2 THEN {alone} WHEN c2 {two} > 0 THEN ln((c2 {two}) / (h1 {one.replace('o1', 'ho1')})::DOUBLE) ELSE ln(0.4e0) + {alone} END"
    return f"CASE WHEN i < 3 THEN {pair} WHEN c3 {three} > 0 THEN ln((c3 {three}) / (h2 {two.replace('o2', 'ho2')})::DOUBLE) ELSE ln(0.4e0) + {pair} END"


OP9 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), t AS (SELECT r, len(w) AS m, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d
), g AS (SELECT *, lag(x) OVER p AS y, lag(x, 2) OVER p AS z FROM t WINDOW p AS (PARTITION BY r ORDER BY i)
), c AS (
  SELECT *, count(*) OVER (PARTITION BY x) AS c1, count(*) OVER (PARTITION BY r, x) AS o1, count(*) OVER (PARTITION BY y, x) AS c2, count(*) OVER (PARTITION BY r, y, x) AS o2,
         count(*) OVER (PARTITION BY z, y, x) AS c3, count(*) OVER (PARTITION BY r, z, y, x) AS o3, count(*) OVER () AS n
  FROM g
), h AS (SELECT *, lag(c1) OVER p AS h1, lag(o1) OVER p AS ho1, lag(c2) OVER p AS h2, lag(o2) OVER p AS ho2 FROM c WINDOW p AS (PARTITION BY r ORDER BY i)
), s AS (SELECT r, count(*) AS m, sum({_backoff("", "", "", "n")}) AS a, sum({_backoff("- o1", "- o2", "- o3", "n - m")}) AS b FROM h GROUP BY r)
SELECT doc_id, coalesce(m, 0) AS n_words, round(coalesce(b / m, 0), 6) AS rest_log_score, round(coalesce(a, 0), 6) AS log_score, round(a / m, 6) AS per_word, round(coalesce(b, 0), 6) AS rest_sum
FROM d LEFT JOIN s USING (r)
"""

ORACLE = {"op2_mixing": OP2, "op3_suffix_dedup": OP3, "op4_ngram_jaccard": OP4, "op5_decontamination": OP5, "op6_quality_rules": OP6, "op7_line_dedup": OP7, "op9_lm_scoring": OP9}
