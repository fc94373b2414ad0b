"""DuckDB twins of the operators that SQL can express."""

from __future__ import annotations

from glyphlake.llm.mixing import WEIGHTS
from glyphlake.llm.rules import SOFT

_WORD = r"[^\x20\x09-\x0D]+"

NEAR_DEDUP = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM s p JOIN s q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY ALL) x
  JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE 100 * x.k >= 85 * (na.n + nb.n - x.k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""

MIXING = rf"""WITH d AS (SELECT doc_id, coalesce('s' || source, 't') AS key, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY key),
w AS (SELECT key, source_size, CAST([{", ".join(map(str, WEIGHTS))}][1 + (row_number() OVER (ORDER BY key) - 1) % {len(WEIGHTS)}] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
v AS (SELECT *, cap / weight AS ratio, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
l AS (SELECT level FROM v WHERE level <= ratio ORDER BY ratio, key LIMIT 1),
t AS (SELECT key, source_size, least(cap, coalesce((SELECT level FROM l) * weight, cap)) AS target FROM v),
r AS (SELECT d.doc_id, d.key, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio, (CAST('0x' || substr(md5('mix|' || doc_id), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM d JOIN t USING (key)),
p AS (SELECT *, floor(ratio) AS whole, ratio - floor(ratio) AS part, target - floor(ratio) * source_size AS rest FROM r),
q AS (SELECT *, CASE WHEN part > 0 THEN (u / (1 - u)) / (part / (1 - part)) END AS q FROM p),
b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY key ORDER BY q, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN part > 0 AND before + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM b"""

_FLAGS = ", ".join(f"CAST({rule} AS INTEGER) AS soft_{name}" for name, rule in SOFT.items())
_SUMS = ", ".join(f"sum(soft_{name}) AS k_{name}" for name in SOFT)
_TOTALS = ", ".join(f"sum(k_{x}) / sum(n) AS mean_{x}, sum(k_{x} * k_{x} / n) - sum(n) * (sum(k_{x}) / sum(n)) ** 2 AS s_{x}" for x in SOFT)
_MOMENTS = ", ".join(f"mean_{x}, CASE WHEN m > 0 THEN s_{x} / ((h - 1) * m) ELSE 0 END AS var_{x}" for x in SOFT)


def _strength(x: str) -> str:
    most, noise = f"mean_{x} * (1 - mean_{x})", f"mean_{x} * (1 - mean_{x}) / (CASE WHEN m > 0 THEN m ELSE 1 END)"
    return f"CASE WHEN var_{x} <= {noise} OR m <= 1 THEN 1e6 ELSE greatest(2.0, ({most} - {noise}) / (var_{x} - {noise}) - 1) END"


_STRENGTHS = ", ".join(f"{_strength(x)} AS strength_{x}" for x in SOFT)
_RATES = ", ".join(f"(k_{x} + mean_{x} * strength_{x}) / (n + strength_{x}) AS rate_{x}" for x in SOFT)
_LOWS = ", ".join(f"rate_{x} - 2 * sqrt(rate_{x} * (1 - rate_{x}) / (n + strength_{x} + 1)) AS low_{x}" for x in SOFT)
_BAD = " OR ".join(f"(soft_{x} = 1 AND (low_{x} * (1 - mean_{x}) > 3 * mean_{x} * (1 - low_{x}) OR low_{x} > 0.6))" for x in SOFT)

QUALITY_RULES = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('s' || source, 'n') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '{_WORD}') AS ws FROM d),
p AS (SELECT rid, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
g AS (SELECT rid, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS g FROM p WINDOW o AS (PARTITION BY rid ORDER BY i)),
often AS (SELECT rid, g FROM g WHERE g IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM g JOIN often USING (rid, g), range(3) r(k) GROUP BY rid),
ln AS (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d),
lc AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS dup FROM ln WHERE regexp_matches(l, '{_WORD}') GROUP BY rid),
m AS (SELECT doc_id, host, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(n_lines, 0) AS n_lines, coalesce(dup, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words FROM d JOIN w USING (rid) LEFT JOIN lc USING (rid) LEFT JOIN cov USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {_FLAGS} FROM m),
h AS (SELECT host, count(*) * 1.0::DOUBLE AS n, {_SUMS} FROM f GROUP BY host),
tot AS (SELECT count(*) AS h, CASE WHEN count(*) > 1 THEN (sum(n) - sum(n * n) / sum(n)) / (count(*) - 1) ELSE 0 END AS m, {_TOTALS} FROM h),
mo AS (SELECT h, m, {_MOMENTS} FROM tot),
pr AS (SELECT *, {_STRENGTHS} FROM mo),
r AS (SELECT h.*, pr.* EXCLUDE (h), {_RATES} FROM h, pr),
v AS (SELECT *, {_LOWS} FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({_BAD}) AS kept FROM f JOIN v USING (host)"""

ORACLES = {"op6_near_dedup": NEAR_DEDUP, "op8_mixing": MIXING, "op10_quality_rules": QUALITY_RULES}
