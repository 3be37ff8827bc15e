"""DuckDB SQL for the results of the document queries that SQL can express.

Each states its operator anew over the given tables; constants are spelled out
here, apart from the licence templates and word lists, which are texts.
"""

from __future__ import annotations

from churnlens.llm.licenses import TEMPLATES
from churnlens.llm.quality_rules import COMMON_WORDS


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _lower(column: str) -> str:
    return f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_WORDS = f"regexp_extract_all({_lower('coalesce(text, %s)' % _text(''))}, {_ALNUM})"

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT *, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT r, doc_windows.n, i, item_id FROM doc_windows JOIN item_windows USING (n, g)),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS k FROM found) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

_GAP = r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _grams(words: str) -> str:
    return f"list_distinct([{words}[i] || ' ' || {words}[i + 1] FOR i IN generate_series(1, len({words}) - 1)])"


LICENSES = f"""
WITH t AS (
  SELECT name, {_grams('w')} AS grams FROM (
    SELECT name, list_filter(regexp_split_to_array({_lower('text')}, {_GAP}), lambda x: x <> '') AS w
    FROM (VALUES {', '.join(f'({_text(k)}, {_text(v)})' for k, v in TEMPLATES.items())}) AS v(name, text))),
d AS (SELECT row_number() OVER () AS r, doc_id, {_lower('text')} AS text FROM documents WHERE text IS NOT NULL),
pieces AS (
  SELECT r, doc_id, 'line' AS kind, i - 1 AS segment, p[i] AS piece FROM (
    SELECT *, unnest(generate_series(1, len(p))) AS i FROM (SELECT *, string_split(text, chr(10)) AS p FROM d))
  UNION ALL
  SELECT r, doc_id, 'paragraph', i - 1, p[i] FROM (
    SELECT *, unnest(generate_series(1, len(p))) AS i FROM (SELECT *, regexp_split_to_array(text, '\\n[ \\t\\r]*\\n') AS p FROM d))
  WHERE contains(p[i], chr(10))),
s AS (
  SELECT r, doc_id, kind, segment, {_grams('w')} AS grams FROM (
    SELECT *, list_filter(regexp_split_to_array(piece, {_GAP}), lambda x: x <> '') AS w FROM pieces) WHERE len(w) > 1),
m AS (
  SELECT r, doc_id, kind, segment, name, len(s.grams) AS n, len(t.grams) AS a, len(list_intersect(s.grams, t.grams)) AS c
  FROM s JOIN t ON len(s.grams) BETWEEN len(t.grams) * 2 / 3.0 - 0.001 AND len(t.grams) * 1.5 + 0.001)
SELECT doc_id, kind, CAST(segment AS BIGINT) AS segment, name AS license, CAST(n AS BIGINT) AS n_bigrams, CAST(c AS BIGINT) AS n_shared,
  CAST(2.0 AS DOUBLE) * c / (a + n) AS dice
FROM m WHERE CAST(2.0 AS DOUBLE) * c / (a + n) >= 0.8
QUALIFY row_number() OVER (PARTITION BY r, kind, segment ORDER BY CAST(2.0 AS DOUBLE) * c / (a + n) DESC, name) = 1
"""

_SPACE = r"\x20\x09-\x0D"


def _kept_chars(kept: str) -> str:
    """Number of characters of the class."""
    return f"length(regexp_replace(text, '[^{kept}]', '', 'g'))"


def _distance(p: str, q: str) -> str:
    """Jensen-Shannon distance of two lists of shares."""
    a, b = f"{p}[i]", f"{q}[i]"
    part = "CASE WHEN {x} > 0 THEN {x} * log2({x} / (({a} + {b}) / 2)) ELSE 0 END"
    terms = f"({part.format(x=a, a=a, b=b)} + {part.format(x=b, a=a, b=b)}) / 2"
    return f"sqrt(greatest(0, list_sum([{terms} FOR i IN generate_series(1, len({p}))])))"


_SHARE = "CASE WHEN list_sum({c}) > 0 THEN [x / CAST(list_sum({c}) AS DOUBLE) FOR x IN {c}] END"

QUALITY_RULES = f"""
WITH common(of, list) AS (VALUES {', '.join(f"({_text(k)}, [{', '.join(map(_text, v))}])" for k, v in COMMON_WORDS.items())}),
d AS (
  SELECT row_number() OVER () AS r, doc_id, of AS lang, list, text, regexp_extract_all(text, '[^{_SPACE}]+') AS w
  FROM (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents) LEFT JOIN common ON lower(trim(lang)) = of),
c AS (
  SELECT *, length(text) AS n, {_kept_chars('a-z')} AS c1, {_kept_chars('A-Z')} AS c2, {_kept_chars('0-9')} AS c3,
    {_kept_chars(_SPACE)} AS c4, {_kept_chars('#*$%&|<>')} AS c5,
    {_kept_chars(r'\x21\x22\x27-\x29\x2B-\x2F\x3A\x3B\x3D\x3F\x40\x5B-\x60\x7B\x7D\x7E')} AS c6,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) AS lines,
    [{_lower('x')} FOR x IN w] AS lw FROM d),
h AS (
  SELECT *, [c1, c2, c3, c4, c5, c6, n - c1 - c2 - c3 - c4 - c5 - c6] AS classes,
    CASE WHEN list IS NOT NULL THEN [len(list_filter(lw, lambda x: x = y)) FOR y IN list] END AS found FROM c),
shares AS (
  SELECT *, {_SHARE.format(c='classes')} AS cs,
    {_SHARE.format(c='list_append(found, len(w) - list_sum(found))')} AS ws FROM h),
cref AS (
  SELECT lang AS of, list(v ORDER BY i) AS cr FROM (
    SELECT lang, i, avg(cs[i]) AS v FROM (SELECT lang, cs, unnest(generate_series(1, 7)) AS i FROM shares WHERE len(w) >= 30) GROUP BY lang, i)
  GROUP BY lang),
wref AS (
  SELECT lang AS of, list(v ORDER BY i) AS wr FROM (
    SELECT lang, i, avg(ws[i]) AS v FROM (SELECT lang, ws, unnest(generate_series(1, 17)) AS i FROM shares WHERE len(w) >= 30 AND lang IS NOT NULL) GROUP BY lang, i)
  GROUP BY lang),
windows AS (
  SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (
    SELECT r, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)),
again AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS k FROM windows) WHERE k > 1),
repeats AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(generate_series(i, i + 4)) AS k FROM again) GROUP BY r),
base AS (
  SELECT shares.r, doc_id, len(w) AS n_words, list_sum([length(x) FOR x IN w]) AS word_chars, c5 AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words,
    CASE WHEN len(w) >= 30 THEN {_distance('cs', 'cr')} END AS cd,
    CASE WHEN len(w) >= 30 AND ws IS NOT NULL THEN {_distance('ws', 'wr')} END AS wd
  FROM shares LEFT JOIN repeats USING (r) LEFT JOIN cref ON shares.lang IS NOT DISTINCT FROM cref.of
  LEFT JOIN wref ON shares.lang = wref.of)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT coalesce(cd > 0.33, false) AND NOT coalesce(wd > 0.5, false) AS kept,
  round(cd, 6) AS class_distance, round(wd, 6) AS word_distance
FROM base
"""

_SHARE = "1 + (CAST(1000000000 AS HUGEINT) * (%s + 2)) // (%s + 2 * v)"
_APART = "CAST((({0} - {1}) * ({0} - {1})) // ({0} + {1}) AS BIGINT)"

DIVERGENCE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_lower("coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
x AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS in_lang FROM x GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, sum(in_lang) AS lang_total FROM kept GROUP BY lang),
n AS (SELECT lang, source, term, count(*) AS n FROM x SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (
  SELECT lang, source, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM n GROUP BY lang, source) USING (lang, source)),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n,
    {_SHARE % ('coalesce(n, 0)', 'total')} AS p, {_SHARE % ('in_lang', 'lang_total')} AS q
  FROM g JOIN kept USING (lang) JOIN v USING (lang)
  LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = kept.term),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum({_APART.format('a.p', 'b.p')}) AS value
  FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, {_APART.format('p', 'q')} FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM parts)
WHERE part = 'pair' OR rank <= 10
"""

ORACLES = {
    "op2_license_scan": LICENSES,
    "op7_quality_rules": QUALITY_RULES,
    "op10_benchmark_decontamination": DECONTAMINATION,
    "op13_source_divergence": DIVERGENCE,
}
