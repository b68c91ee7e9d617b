"""DuckDB SQL for the text queries that SQL can express; documents are told apart by doc_id there."""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x20\x09-\x0D]+"


def _count(chars: str) -> str:
    return f"(length(t) - length(translate(t, '{chars}', '')))"


DECONTAMINATION = f"""WITH
it AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_TOKEN}') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, w[i + 1 : i + 13] AS l, array_to_string(w[i + 1 : i + 13], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(0, greatest(0, len(w) - 13) + 1)) AS i FROM it WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_TOKEN}') AS w FROM documents),
spot AS (
  SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM win))),
hit AS (SELECT DISTINCT doc_id, item_id, i, n FROM spot JOIN win USING (n, p)),
cov AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS t, unnest(range(0, len(w))) AS pos FROM d),
tf AS (SELECT t, count(*) AS c FROM word GROUP BY t),
wt AS (SELECT p, n, off, t, c FROM (SELECT p, n, unnest(l) AS t, unnest(range(0, n)) AS off FROM (SELECT DISTINCT p, n, l FROM win)) LEFT JOIN tf USING (t)),
rk AS (SELECT p, n, off, t, row_number() OVER (PARTITION BY p ORDER BY c, off) AS k FROM wt WHERE p NOT IN (SELECT p FROM wt WHERE c IS NULL)),
po AS (SELECT doc_id, p, n, k, pos - off AS s FROM word JOIN rk USING (t) WHERE k <= 2),
nr AS (
  SELECT doc_id, count(*) AS n_near
  FROM (SELECT doc_id, p FROM po WHERE n = 1
    UNION SELECT a.doc_id, a.p FROM po a JOIN po b ON a.doc_id = b.doc_id AND a.p = b.p AND a.k = 1 AND b.k = 2 AND b.s BETWEEN a.s - 5 AND a.s + 5)
  GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_near, 0) AS n_near, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN nr USING (doc_id)"""

QUALITY = f"""WITH a AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM documents),
b AS (SELECT doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {_count('#*$%&|<>')} AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, {_count('ABCDEFGHIJKLMNOPQRSTUVWXYZ')} AS caps, {_count('!?')} AS marks, w FROM a),
k AS (SELECT doc_id, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS p FROM (SELECT doc_id, w, unnest(range(0, len(w) - 2)) AS i FROM b)),
r AS (SELECT doc_id, count(DISTINCT pos) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM k JOIN (SELECT doc_id, p FROM k GROUP BY ALL HAVING count(*) > 1) USING (doc_id, p)) GROUP BY doc_id),
c AS (SELECT b.* EXCLUDE (w), coalesce(n_repeat_words, 0) AS n_repeat_words FROM b LEFT JOIN r USING (doc_id)),
d AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, [1000 * n_symbols // greatest(word_chars, 1), 1000 * caps // greatest(word_chars, 1), 1000 * marks // greatest(n_words, 1), 1000 * n_dup_lines // greatest(n_lines, 1), 1000 * n_repeat_words // greatest(n_words, 1), 100 * word_chars // greatest(n_words, 1)] AS m FROM c),
e AS (SELECT lang, source, unnest(range(0, 6)) AS f, unnest(m) AS x FROM d WHERE NOT base_failed),
g AS (SELECT lang, source, f, CASE WHEN x < 32 THEN x ELSE (x >> (length(bin(x)) - 5)) << (length(bin(x)) - 5) END AS x FROM e),
lv AS (SELECT 0 AS lev, lang AS l, source AS s, f, x FROM g UNION ALL SELECT 1, lang, NULL, f, x FROM g UNION ALL SELECT 2, NULL, NULL, f, x FROM g),
n AS (SELECT *, row_number() OVER (PARTITION BY lev, l, s, f ORDER BY x) AS k, count(*) OVER (PARTITION BY lev, l, s, f) AS c FROM lv),
q AS (SELECT lev, l, s, f, any_value(c) AS c, min(x) FILTER (4 * k >= c) AS q1, min(x) FILTER (4 * k >= 3 * c) AS q3 FROM n GROUP BY ALL),
z AS (SELECT lev, l, s, f, c, CASE WHEN f = 5 THEN q1 - 3 * greatest(q3 - q1, 60) ELSE -1 END AS lo, q3 + 3 * greatest(q3 - q1, [20, 25, 60, 150, 100, 60][f + 1]) AS hi FROM q),
v AS (SELECT d.doc_id, unnest(range(0, 6)) AS f, unnest(m) AS x, lang, source FROM d),
y AS (SELECT v.doc_id, bool_and(x >= coalesce(z0.lo, z1.lo, z2.lo) AND x <= coalesce(z0.hi, z1.hi, z2.hi)) AS inside FROM v
  JOIN z g0 ON g0.lev = 0 AND g0.l IS NOT DISTINCT FROM lang AND g0.s IS NOT DISTINCT FROM source AND g0.f = v.f
  LEFT JOIN z z0 ON z0.lev = 0 AND z0.c >= 100 AND z0.l IS NOT DISTINCT FROM lang AND z0.s IS NOT DISTINCT FROM source AND z0.f = v.f
  LEFT JOIN z z1 ON z1.lev = 1 AND z1.c >= 100 AND z1.l IS NOT DISTINCT FROM lang AND z1.f = v.f LEFT JOIN z z2 ON z2.lev = 2 AND z2.f = v.f GROUP BY v.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(inside, false) AS kept FROM d LEFT JOIN y USING (doc_id)"""
