"""DuckDB SQL for the queries that SQL can express, built from the same parameters."""

from __future__ import annotations

from dataclasses import replace

from . import quality, secret_scan, warc

WORD = r"[^\x20\x09-\x0D]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def quality_sql() -> str:
    stop = ", ".join(map(_quoted, dict.fromkeys(quality.STOP_WORDS)))
    passes = " AND ".join(f"coalesce(({r.metric}) {op} {bound!r}, true)" for r in quality.RULES for op, bound in ((">=", r.low), ("<=", r.high)) if bound is not None)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
s AS (SELECT *, list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]) AS g,
 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d),
p AS (SELECT doc_id, rid, unnest(g) AS g, generate_subscripts(g, 1) AS i FROM (SELECT *, row_number() OVER () AS rid FROM s)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM p) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT i + o) AS n FROM r, (VALUES (0), (1), (2)) AS v(o) GROUP BY rid),
m AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
 length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, length(t) - length(replace(t, '!', '')) AS n_shouts,
 len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop_words, len(l) AS n_text_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
 coalesce(c.n, 0) AS n_repeat_words FROM (SELECT *, row_number() OVER () AS rid FROM s) LEFT JOIN c USING (rid))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
 (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {passes} AS kept FROM m"""


LINE_SQL = r"""
WITH d AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM d),
f AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, f.keep IS NOT NULL AND f.keep <> k.doc_id AS lost FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE lost)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM j GROUP BY doc_id"""

NEAR_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) ELSE w END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
 GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, p.y FROM r JOIN p ON r.reach = p.x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)"""


def secret_sql() -> str:
    # This engine takes no stack and knows no possessive loops.
    rules = [replace(r, pattern=r.pattern.replace(")++", ")+").replace("*+", "*")) for r in secret_scan.BASE_RULES + secret_scan.MORE_RULES]
    scans = " UNION ALL ".join(
        f"SELECT rid, {i} AS ord, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, {_quoted(r.pattern)}, 0) AS f, regexp_extract_all(t, {_quoted(r.pattern)}, {r.group}) AS v, string_split_regex(t, {_quoted(r.pattern)}) AS g FROM d WHERE regexp_matches(t, {_quoted(r.pattern)})"
        for i, r in enumerate(rules)
    )
    base = ", ".join(_quoted(r.kind) for r in secret_scan.BASE_RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({scans}), u AS (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM m),
q AS (SELECT rid, ord, kind, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i-1], lambda x: length(x))), 0))::BIGINT AS a, length(f[i]) AS n FROM u WHERE length(v[i]) >= least),
z AS (SELECT rid, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
 coalesce(string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, ord) FILTER (WHERE kind IN ({base})), '') AS b, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, ord) AS spans FROM q GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN z USING (rid)"""


def revisit_sql() -> str:
    merged = "date" in warc.MERGED_HEADERS
    return rf"""
WITH u AS (SELECT page_id, sha1(coalesce(html, '')) AS digest, regexp_replace(regexp_replace(url, '^[^:/?#]*://', ''), '#.*$', '') AS rest FROM pages),
c AS (SELECT page_id, digest, regexp_extract(rest, '^([^/?]*)', 1) AS host, regexp_replace(rest, '^[^/?]*', '') AS tail FROM u),
n AS (SELECT page_id, digest, regexp_replace(translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^www\.', '') ||
 regexp_replace(regexp_replace(regexp_replace(tail, '([?&])utm_[^&]*(&|$)', '\1', 'g'), '[?&]+$', ''), '/+(\?|$)', '\1', 'g') AS canonical FROM c),
a AS (SELECT page_id, digest, canonical, after, page_id || '-' || after AS record_id, 10 * page_id + after AS ts, CASE WHEN page_id % 4 <> 0 THEN page_id + CASE WHEN after = 1000 AND page_id % 11 = 0 THEN 1 ELSE 0 END END AS day,
 CASE WHEN after = 7 AND page_id % 5 = 0 THEN 'other' WHEN after = 1000 AND page_id % 7 = 0 THEN NULL ELSE digest[1:12] END AS tag FROM n, (VALUES (0), (7), (1000)) AS v(after)),
j AS (SELECT x.*, (SELECT max(struct_pack(t := y.ts, r := y.record_id, e := y.tag, m := y.day, d := y.digest)) FROM a y WHERE y.after = 0 AND y.canonical = x.canonical AND y.ts < x.ts) AS p FROM a x),
o AS (SELECT *, CASE WHEN after = 0 THEN 'response' WHEN p IS NULL THEN 'no_earlier' WHEN coalesce(tag <> p.e, false) OR coalesce(day <> p.m, false) THEN 'changed' WHEN (tag = p.e) IS NULL AND (day = p.m) IS NULL THEN 'unvalidated' ELSE 'resolved' END AS outcome FROM j)
SELECT record_id, canonical, outcome, CASE WHEN outcome = 'resolved' THEN p.r END AS resolved_id, CASE WHEN outcome = 'resolved' THEN p.d END AS resolved_digest, {'ts' if merged else "CASE WHEN outcome = 'resolved' THEN p.t ELSE ts END"}::VARCHAR AS merged_date,
 CASE WHEN outcome IN ('resolved', 'response') THEN 'text/html' ELSE 'text/plain' END AS merged_type, CASE WHEN outcome IN ('resolved', 'response') THEN 'one' ELSE 'two' END AS merged_server, 'max-age=' || after AS merged_cache, CASE WHEN after = 1000 THEN ts::VARCHAR END AS merged_expires FROM o"""


TRIE_SQL = rf"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) AS i, g, n FROM
  (SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n FROM conversations WHERE conv_id IS NOT NULL)),
k AS (SELECT c, c - c % 20 AS b, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 4 AS h FROM (SELECT DISTINCT c FROM t)),
m AS (SELECT k.c, t.i, t.g, t.n FROM k JOIN t ON t.c = k.b AND t.i <= k.h UNION ALL SELECT c, t.i, t.g, t.n FROM t JOIN k USING (c) WHERE t.i > k.h),
p AS (SELECT c, row_number() OVER w AS d, sha256(string_agg(g, '') OVER w) AS g, n FROM m WINDOW w AS (PARTITION BY c ORDER BY i)),
a AS (SELECT c, d, g, n, lag(g, 1, '') OVER (PARTITION BY c ORDER BY d) AS p FROM p UNION ALL SELECT c, 0, '', 0, NULL FROM k),
n AS (SELECT g, d, min(c) AS conv_id, any_value(p) AS p, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS own FROM a GROUP BY g, d),
f AS (SELECT p AS g, count(*) AS n_children FROM n WHERE p IS NOT NULL GROUP BY p),
e AS (SELECT g, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM (SELECT c, arg_max(g, d) AS g FROM a GROUP BY c) GROUP BY g),
s AS (SELECT u.g, sum(n.own) AS saved, count(*) FILTER (WHERE n.g NOT IN (SELECT g FROM f)) AS leaves FROM (SELECT DISTINCT x.g, y.g AS low FROM a x JOIN a y ON x.c = y.c AND x.d <= y.d) u JOIN n ON n.g = u.low GROUP BY u.g)
SELECT n.conv_id, n.d::BIGINT AS depth, o.conv_id AS parent_conv_id, n.n_convs, coalesce(f.n_children, 0)::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM n JOIN s USING (g) LEFT JOIN f USING (g) LEFT JOIN e USING (g) LEFT JOIN n o ON o.g = n.p"""

NEGATIVE_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS row_id, a.label = r.label AS same, list_dot_product(a.q, r.q)::BIGINT AS score FROM v a JOIN v r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, row_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, row_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, row_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, row_id)
QUALIFY row_number() OVER w <= 3"""


ORACLE_SQL = {
    "op3_quality_rules": quality_sql(),
    "op4_line_dedup": LINE_SQL,
    "op5_minhash_near_dedup": NEAR_SQL,
    "op8_warc_revisits": revisit_sql(),
    "op10_secret_scans": secret_sql(),
    "op12_conversation_trie": TRIE_SQL,
    "op13_hard_negatives": NEGATIVE_SQL,
}
