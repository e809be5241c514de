"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from storelens.llm import mixing as M
from storelens.llm import quality_rules as Q
from storelens.llm import spelling as S
from storelens.llm import url_filter as U

_WORD = r"'[^\x20\x09-\x0D]+'"


def _rules10() -> tuple[str, str]:
    def side(r: Q.Rule) -> str:
        bound = f"{r.threshold!r}::DOUBLE * {r.denominator or 1}"
        ok = f"({r.numerator} {r.op} {bound})"
        return f"(n_words < {r.min_words} OR {ok})" if r.min_words else ok
    return ", ".join(f"CASE WHEN NOT {side(r)} THEN '{r.name}' END" for r in Q.RULES), " AND ".join(side(r) for r in Q.RULES)


def _op10() -> str:
    names, passed = _rules10()
    stop = ", ".join(f"'{w}'" for w in Q.STOP_WORDS)
    return f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_WORD})) AS ls FROM documents),
grams AS (SELECT doc_id, i, list_slice(ws, i, i + 4) AS g
          FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) > 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS p FROM twice, range(0, 5) r(k)) GROUP BY doc_id),
c AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
             len(ls)::BIGINT AS n_lines, len(list_filter(ws, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words,
             len(list_filter(ws, lambda x: upper(x) = x AND lower(x) <> x))::BIGINT AS n_upper_words
      FROM w LEFT JOIN covered USING (doc_id)),
j AS (SELECT *, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c)
SELECT *, concat_ws(',', {names}) AS failed_rules, NOT base_failed AND {passed} AS kept FROM j"""


def _op3() -> str:
    u = "('0x' || substr(md5({}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
    own, place = u.format(f"'{M.SEED}|' || doc_id"), u.format(f"'{M.SEED}|place|' || doc_id || '|' || copy")
    return f"""
WITH RECURSIVE b AS (SELECT source, sum(strlen(coalesce(text, '')))::BIGINT AS bytes FROM documents GROUP BY source),
w AS (SELECT *, CASE WHEN bytes > 0 THEN pow(bytes::DOUBLE, {M.TEMPERATURE}) ELSE 0.0 END AS weight FROM b),
r AS (SELECT source, CASE WHEN (SELECT sum(weight) FROM w) > 0 THEN CASE WHEN bytes > 0 THEN weight / (SELECT sum(weight) FROM w)
             * (SELECT sum(bytes) FROM w)::DOUBLE / bytes ELSE 0.0 END ELSE 1.0 END AS rate FROM w),
q AS (SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf FROM r
      UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM q WHERE k < rate + 10 * sqrt(rate) + 40),
d AS (SELECT *, {own} AS u FROM documents),
n AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, count(q.k) AS copies FROM d LEFT JOIN q ON q.source IS NOT DISTINCT FROM d.source AND q.cdf <= d.u
      GROUP BY ALL),
e AS (SELECT *, unnest(range(copies)) AS copy FROM n)
SELECT doc_id, text, lang, source, n_chars, copies, copy, {place} AS place FROM e"""


def _op4() -> str:
    rule, verdict = "NULL", "NULL"
    for r in sorted(U.RULES, key=lambda r: (len(r.text), len(r.host))):
        fits = f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{r.text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{r.verdict}' ELSE {verdict} END"
    low, high = U.STRENGTH

    def last(n: int) -> str:
        return f"array_to_string((string_split(server, '.'))[-{n}:], '.')"

    two = rf"regexp_full_match({last(2)}, '({'|'.join(U.SECOND_LABELS)})\.[a-z]{{2}}')"
    ip = f"(regexp_full_match(server, '{U.NUMBERS}') OR starts_with(server, '['))"

    def strength(rows: str, prior: str) -> str:
        return f"""(SELECT CASE WHEN w > 0 AND (s - v) / w > 0 THEN greatest({low}::DOUBLE, least({high}::DOUBLE, 1 / ((s - v) / w) - 1)) ELSE {high}::DOUBLE END
  FROM (SELECT sum(round(n * pow(bad / n - {prior}, 2.0) * 1e6)::BIGINT)::DOUBLE AS s, sum(round({prior} * (1 - {prior}) * 1e6)::BIGINT)::DOUBLE AS v,
               sum(round({prior} * (1 - {prior}) * 1e6)::BIGINT * (n - 1))::DOUBLE AS w FROM {rows} WHERE n > 0))"""

    return rf"""
WITH p AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
l AS (SELECT doc_id, count(*) AS n, sum(1 - quality) AS bad FROM labels GROUP BY doc_id),
i AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '\.?(:[0-9]*)?$', '') AS server, TRY_CAST(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:/|\.html)?$', 1), '') AS BIGINT) AS doc_id FROM p),
h0 AS (SELECT server, coalesce(sum(l.n), 0)::BIGINT AS n, coalesce(sum(l.bad), 0)::BIGINT AS bad FROM i LEFT JOIN l USING (doc_id) GROUP BY server),
h AS (SELECT *, CASE WHEN {ip} THEN server WHEN {two} THEN {last(3)} ELSE {last(2)} END AS domain,
             CASE WHEN {ip} THEN 'ip' WHEN {two} THEN {last(2)} ELSE {last(1)} END AS suffix FROM h0),
d0 AS (SELECT suffix, domain, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM h GROUP BY ALL),
s0 AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM d0 GROUP BY ALL),
s AS (SELECT suffix, ((SELECT (sum(bad) + 0.5::DOUBLE) / (sum(n) + 1.0::DOUBLE) FROM s0) * {U.LABEL_SUM}::DOUBLE + bad) / ({U.LABEL_SUM}::DOUBLE + n) AS suffix_rate FROM s0),
d1 AS (SELECT * FROM d0 JOIN s USING (suffix)),
d AS (SELECT *, {strength('d1', 'suffix_rate')} AS k1 FROM d1),
h1 AS (SELECT h.*, (suffix_rate * k1 + d.bad) / (k1 + d.n) AS domain_rate FROM h JOIN d USING (domain)),
h2 AS (SELECT *, {strength('h1', 'domain_rate')} AS k2 FROM h1),
h3 AS (SELECT server, n, (domain_rate * k2 + bad) / (k2 + n) AS m, k2 + n AS ab FROM h2),
h4 AS (SELECT server, n AS n_labelled, m - {U.Z} * sqrt(m * (1 - m) / (ab + 1)) AS low FROM h3)
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN low > {U.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict,
       n_labelled, round(low, 6) AS bad_low FROM i JOIN h4 USING (server)"""


def _op1() -> str:
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS ws FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
             ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
e AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id WHERE r.c < e.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(c) FROM r WHERE r.doc_id = d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id)"""


# CRC-32 of a string `{}`, by the table of its polynomial
_CRC_TABLE = "t AS (SELECT list(list_reduce([i] || range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS crc FROM range(256) r(i))"


def _crc(text: str) -> str:
    byte = f"list_transform(range(1, strlen({text}) + 1), lambda i: ('0x' || substr(hex(encode({text})), 2 * i::BIGINT - 1, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce([4294967295::BIGINT] || {byte}, lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])))"


def _op12() -> str:
    return f"""
WITH {_CRC_TABLE},
n AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
      FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({{'r': r, 'x': x}} ORDER BY pos) AS own FROM n GROUP BY c),
h AS (SELECT c, own, {_crc("c::VARCHAR")} % 6 AS h FROM o, t),
b AS (SELECT h.c, coalesce(list_slice(o.own, 1, h.h), []) || list_slice(h.own, h.h + 1, len(h.own)) AS v FROM h LEFT JOIN o ON o.c = h.c - h.c % 100),
m AS (SELECT c, d, list_slice(v, 1, d) AS p, len(v) AS size FROM b, lateral (SELECT unnest(range(len(v) + 1)) AS d)),
g AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE size = d), '') AS ends,
             (count(*) - 1) * coalesce(length(any_value(p[d].x)), 0) AS saved FROM m GROUP BY p, d),
k AS (SELECT list_slice(p, 1, d - 1) AS p, count(*) AS n FROM g WHERE d > 0 GROUP BY ALL),
j AS (SELECT g.*, coalesce(k.n, 0) AS n_children FROM g LEFT JOIN k ON k.p = g.p),
u AS (SELECT a.conv_id, a.d, sum((y.n_children = 0)::INT) AS n_leaves, sum(y.saved) AS saved_tokens
      FROM j y JOIN m ON m.c = y.conv_id AND m.d <= y.d JOIN j a ON a.p = m.p GROUP BY ALL)
SELECT j.conv_id, j.d AS depth, q.conv_id AS parent_conv_id, j.n_convs, j.n_children, u.n_leaves::BIGINT AS n_leaves, u.saved_tokens::BIGINT AS saved_tokens, sha256(j.ends) AS ends_sha256
FROM j JOIN u ON u.conv_id = j.conv_id AND u.d = j.d LEFT JOIN j q ON q.d = j.d - 1 AND q.p = list_slice(j.p, 1, j.d - 1)"""


def _op13() -> str:
    return f"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS k, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
c AS (SELECT run, n, {_crc("k")} AS h FROM r, t),
w AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % {S.NOISE} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM c)
      WHERE length(word) >= {S.MIN_LENGTH} GROUP BY word HAVING sum(n) >= {S.MIN_COUNT}),
d AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, b.word AS other FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
      UNION SELECT word, rest FROM d WHERE rest IN (SELECT word FROM w) UNION SELECT rest, word FROM d WHERE rest IN (SELECT word FROM w)),
q AS (SELECT p.word, p.other, v.n AS other_n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY v.n DESC, p.other) AS k
      FROM p JOIN w v ON v.word = p.other),
f AS (SELECT w.word, w.n, CASE WHEN q.other_n >= 2 * w.n THEN q.other END AS form, coalesce(q.n_near, 0) AS n_near, CASE WHEN q.other_n >= 2 * w.n THEN q.other_n END AS form_n
      FROM w LEFT JOIN q ON q.word = w.word AND q.k = 1),
z AS (SELECT word, word AS top FROM f UNION ALL SELECT z.word, f.form FROM z JOIN f ON f.word = z.top WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.form, z.top AS root, f.n_near, f.form_n FROM f JOIN z ON z.word = f.word JOIN f e ON e.word = z.top AND e.form IS NULL"""


SQL = {"op1_ngram_jaccard": _op1(), "op3_poisson_mixing": _op3(), "op4_host_reputation": _op4(), "op10_threshold_rules": _op10(),
       "op12_prefix_trie": _op12(), "op13_spelling_variants": _op13()}
