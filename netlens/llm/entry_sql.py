"""DuckDB twins of the queries that SQL can express on whole tables.

Tokenizers (2, 5, 7), hashing of Spark (6), trained models (4, 8) and the approximate index (3)
have none: tests/llm holds them against brute-force versions.
"""

from __future__ import annotations

from .license_templates import TEMPLATES
from .quality_rules import STOP_WORDS, THRESHOLDS

_WORD = r"[^\x20\x09-\x0D]+"
_STOPS = ", ".join(f"'{w}'" for w in sorted({w for x in STOP_WORDS.values() for w in x.split()}))
_MEASURES = {
    "n_words": "n_words", "mean_word_length": "word_chars / greatest(n_words, 1)", "symbol_ratio": "n_symbols / greatest(n_words, 1)", "exclaim_ratio": "n_exclaims / greatest(n_words, 1)",
    "stop_ratio": "n_stop_words / greatest(n_words, 1)", "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)", "ellipsis_line_ratio": "n_ellipsis / greatest(n_lines, 1)",
    "bullet_line_ratio": "n_bullet / greatest(n_lines, 1)", "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
}


def _verdict() -> str:
    out = ["NOT base_failed"]
    for _, measure, least, most in THRESHOLDS:
        out += [f"{_MEASURES[measure]} >= {least}"] * (least is not None) + [f"{_MEASURES[measure]} <= {most}"] * (most is not None)
    return " AND ".join(out)


QUALITY = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, x, regexp_extract_all(x, '{_WORD}') AS w, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS l FROM t),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w),
s AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM s WHERE c > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda v: length(v))), 0) AS BIGINT) AS word_chars,
 CAST(length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
 CAST(len(l) AS BIGINT) AS n_lines, length(regexp_replace(x, '[^!]', '', 'g')) AS n_exclaims, len(list_filter(w, lambda v: lower(v) IN ({_STOPS}))) AS n_stop_words,
 len(list_filter(l, lambda v: ends_with(rtrim(v), '...') OR ends_with(rtrim(v), '…'))) AS n_ellipsis, len(list_filter(l, lambda v: substr(ltrim(v), 1, 1) IN ('-', '*', '•'))) AS n_bullet
 FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, {_verdict()} AS kept FROM b"""

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.root = e.x)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id"""


def _values() -> str:
    return ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, texts in TEMPLATES.items() for text in texts)


_WORDS_OF = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
# units of one line; blocks and whole texts give the same rows on the tables, as notices stand on lines of their own
LICENSES = f"""WITH t AS (SELECT row_number() OVER (ORDER BY name, text) AS tid, name, {_WORDS_OF.format("text")} AS w FROM (VALUES {_values()}) v(name, text)),
d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
u AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS first_line FROM d),
x AS (SELECT *, {_WORDS_OF.format("line")} AS w FROM u),
ub AS (SELECT doc_id, first_line, len(w) - 1 AS n, g, count(*) AS c FROM (SELECT doc_id, first_line, w, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM x) GROUP BY ALL),
tb AS (SELECT tid, name, len(w) - 1 AS n, g, count(*) AS c FROM (SELECT tid, name, w, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM t) GROUP BY ALL),
m AS (SELECT ub.doc_id, ub.first_line, tb.name, tb.tid, 2 * sum(least(ub.c, tb.c)) / (any_value(ub.n) + any_value(tb.n)) AS dice FROM ub JOIN tb USING (g) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, first_line ORDER BY dice DESC, tid) AS k FROM m WHERE dice >= 0.8)
SELECT doc_id, name AS license, round(CAST(dice AS DOUBLE), 6) AS dice, CAST(first_line AS BIGINT) AS first_line, CAST(1 AS BIGINT) AS n_lines FROM b WHERE k = 1"""

DIVERGENCE = """WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS x FROM documents),
t AS (SELECT i, lang, source, translate(unnest(regexp_extract_all(x, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT l.lang, coalesce(k.v, 0) AS v, coalesce(k.n, 0) AS n FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang) k USING (lang)),
g AS (SELECT x.lang, x.source, coalesce(y.n, 0) AS n, v.v, v.n AS ln FROM (SELECT DISTINCT lang, source FROM d) x JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) y USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT) // (g.n + 5 * g.v)::HUGEINT AS p, 1 + (1000000000 * (k.n + 5)::HUGEINT) // (g.ln + 5 * g.v)::HUGEINT AS q FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
 LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
r AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 50"""

# every 200-byte string of every text, as hex digits; those that share a hash are compared whole
REPEATS = """WITH d AS (SELECT row_number() OVER () AS i, doc_id, hex(coalesce(text, '')) AS h FROM documents),
b AS (SELECT i, o, substr(h, 2 * o + 1, 910) AS c, least(256, len(h) // 2 - 199 - o) AS m FROM (SELECT i, h, unnest(range(0, len(h) // 2 - 199, 256)) AS o FROM d)),
w AS (SELECT i, o + q AS p, c, q, hash(substr(c, 2 * q + 1, 400)) AS g FROM (SELECT i, o, c, unnest(range(0, m)) AS q FROM b)),
e AS (SELECT i, p, substr(c, 2 * q + 1, 400) AS x FROM w SEMI JOIN (SELECT g FROM w GROUP BY g HAVING count(*) > 1) USING (g)),
r AS (SELECT i, p FROM e SEMI JOIN (SELECT x FROM e GROUP BY x HAVING count(*) > 1) USING (x)),
n AS (SELECT i, p, sum(CASE WHEN p <= b + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY i ORDER BY p) AS k FROM (SELECT i, p, lag(p) OVER (PARTITION BY i ORDER BY p) AS b FROM r)),
s AS (SELECT i, min(p) AS a, max(p) + 200 AS b FROM n GROUP BY i, k),
k AS (SELECT i, h, a, b, lag(b, 1, 0) OVER (PARTITION BY i ORDER BY a) AS before FROM s JOIN d USING (i)),
o AS (SELECT i, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM k GROUP BY i)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN o USING (i)"""

ORACLE_SQL = {"op11_suffix_dedup": REPEATS, "op12_source_divergence": DIVERGENCE, "op1_quality_rules": QUALITY, "op9_license_scan": LICENSES, "op10_ngram_join": JACCARD}
