"""SQL for the queries that SQL can express, over the tables the driver registers."""

from __future__ import annotations

from . import licenses, linerules, revisits


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def line_cleaning() -> str:
    r, blank = linerules.LineRules(), r"[\x20\x09-\x0D]"
    words = rf"list_filter(string_split_regex({{}}, '{blank}+'), lambda x: x <> '')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, {words.format('t')} AS ws FROM d),
pl AS (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i+1], ws[i+2], ws[i+3], ws[i+4]) AS c FROM pl),
s AS (SELECT rid, i, i - lag(i) OVER (PARTITION BY rid ORDER BY i) AS gap FROM g WHERE c > 1),
rep AS (SELECT rid, sum(least(5, coalesce(gap, 5))) AS n FROM s GROUP BY rid),
l AS (SELECT rid, line FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
f AS (
  SELECT rid, line, length(regexp_replace(line, '{blank}+', '', 'g')) AS chars,
    length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) >= {r.symbols_per_word} * len({words.format('line')})
    OR length(regexp_replace(line, '[^|»•·]', '', 'g')) >= {r.separators}
    OR length(line) - length(replace(line, '!!', '!')) >= {r.shouts}
    OR (len({words.format('line')}) < {r.short_line} AND NOT regexp_matches(line, '[.!?…:;"'')\]»”]{blank}*$'))
    OR regexp_matches(lower(line), {_quoted('|'.join(map(linerules._literal, r.phrases)))}) AS fails
  FROM l),
lines AS (SELECT rid, count(*) AS n, count(*) - count(DISTINCT line) AS dup, count(*) FILTER (fails) AS gone, coalesce(sum(chars) FILTER (NOT fails), 0) AS stays FROM f GROUP BY rid),
b AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{blank}+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lines.n, 0)::BIGINT AS n_lines, coalesce(gone, 0)::BIGINT AS n_lines_removed, coalesce(stays, 0) AS stays
  FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN lines USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND (word_chars = 0 OR 1 - stays / word_chars <= {r.max_loss}) AS kept, n_lines, n_lines_removed
FROM b"""


def chat_windows(budget: int = 1024, history: int = 256) -> str:
    """Spans by a walk over running sums, whatever the turn numbers and however many turns a conversation has."""
    control = r"([<\[])(\\*)(/?(?:s>|INST\]))"
    esc = rf"regexp_replace({{}}, '{control}', '\1\\\2\3', 'g')"
    role = esc.format(r"replace(replace(role, '\', '\b'), chr(10), '\n')")
    return rf"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, row_number() OVER w AS n, length({role}) + length({esc.format('text')}) + 8 AS len FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
sys AS (SELECT conv_id, len, (len + 3) // 4 AS t FROM o WHERE n = 1 AND role = 'system'),
body AS (
  SELECT o.conv_id, row_number() OVER w AS k, o.len, (o.len + 3) // 4 AS t, sum((o.len + 3) // 4) OVER w AS cum,
    greatest(1, {budget - history} - coalesce(sys.t, 0)) AS room, coalesce(sys.len, 0) AS head
  FROM o LEFT JOIN sys USING (conv_id) WHERE NOT (n = 1 AND role = 'system') WINDOW w AS (PARTITION BY o.conv_id ORDER BY n)),
nxt AS (SELECT a.conv_id, a.k AS s, min(b.k) AS e FROM body a JOIN body b ON a.conv_id = b.conv_id AND b.k > a.k AND b.cum - (a.cum - a.t) > a.room GROUP BY 1, 2),
sp AS (SELECT DISTINCT conv_id, 1::BIGINT AS s FROM body UNION ALL SELECT sp.conv_id, nxt.e FROM sp JOIN nxt USING (conv_id, s)),
win AS (
  SELECT sp.conv_id, sp.s, max(b.head) + sum(b.len) AS n
  FROM sp LEFT JOIN nxt USING (conv_id, s) JOIN body a ON a.conv_id = sp.conv_id AND a.k = sp.s JOIN body b ON b.conv_id = sp.conv_id
    AND ((b.k >= sp.s AND (nxt.e IS NULL OR b.k < nxt.e)) OR (b.k < sp.s AND (a.cum - a.t) - (b.cum - b.t) <= {history}))
  GROUP BY 1, 2),
chars AS (SELECT conv_id, sum(n) AS n FROM (SELECT conv_id, n FROM win UNION ALL SELECT conv_id, len FROM sys WHERE conv_id NOT IN (SELECT conv_id FROM body)) GROUP BY 1)
SELECT o.conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY o.n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY o.n) FILTER (role = 'assistant'), '')) AS loss_sha256, max(chars.n)::BIGINT AS formatted_chars
FROM o JOIN chars USING (conv_id) GROUP BY o.conv_id"""


def warc_revisits() -> str:
    url = r"(?i)^(?:[a-z][a-z0-9+.-]*:)?(?://)?([^/?]*)([^?]*)(.*)$"
    tracking = ", ".join(map(_quoted, revisits.TRACKING))
    return rf"""
WITH p AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS bare, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag, strlen(coalesce(html, '')) AS size, 1704067200 + page_id // 2 * 74 AS s FROM pages),
q AS (
  SELECT *, regexp_replace(lower(regexp_extract(bare, '{url}', 1)), '^(?:www\.|m\.)|:(?:80|443)$', '', 'g') AS host, regexp_replace(regexp_extract(bare, '{url}', 2), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_replace(regexp_extract(bare, '{url}', 3), '^\?', ''), '&'), lambda x: x <> '' AND split_part(x, '=', 1) NOT IN ({tracking}))) AS args
  FROM p),
c AS (
  SELECT page_id, tag, size, s, CASE WHEN host <> '' THEN host || path || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END END AS canonical,
    CASE WHEN page_id % 5 <> 2 THEN tag END AS etag0, CASE WHEN page_id % 5 = 2 THEN 't' || s END AS since0, CASE WHEN page_id % 9 = 3 THEN 'd' || page_id END AS digest0
  FROM q),
r AS (
  SELECT page_id * 4 + k AS record_id, canonical, s + CASE k WHEN 1 THEN 3600 ELSE 86400 END AS at, k,
    CASE WHEN page_id % 5 = 2 OR page_id % 11 = 4 THEN NULL WHEN page_id % 7 = 3 THEN '"changed"' ELSE 'W/' || tag END AS etag,
    CASE WHEN page_id % 5 <> 2 OR page_id % 11 = 4 THEN NULL WHEN page_id % 10 = 2 AND k = 2 THEN 'later' ELSE since0 END AS since,
    CASE WHEN page_id % 9 <> 3 OR page_id % 11 = 4 THEN NULL WHEN k = 2 THEN 'other' ELSE digest0 END AS digest
  FROM c, (VALUES (1), (2)) v(k)),
b AS (SELECT r.record_id, max({{'at': c.s, 'id': c.page_id * 4}}) AS base FROM r JOIN c ON r.canonical = c.canonical AND c.s < r.at GROUP BY 1),
j AS (
  SELECT r.*, base, size, etag0, since0, digest0, CASE WHEN etag IS NOT NULL AND etag0 IS NOT NULL THEN regexp_replace(etag, '^W/', '') = etag0 WHEN since IS NOT NULL AND since0 IS NOT NULL THEN since = since0 END AS named,
    CASE WHEN digest IS NOT NULL AND digest0 IS NOT NULL THEN digest = digest0 END AS same
  FROM r LEFT JOIN b USING (record_id) LEFT JOIN c ON c.page_id * 4 = base.id),
a AS (SELECT *, CASE WHEN named = false OR same = false THEN false WHEN named OR same THEN true END AS agree FROM j)
SELECT record_id, canonical, CASE WHEN canonical IS NULL THEN 'no_url' WHEN base IS NULL THEN 'no_base' WHEN agree IS NULL THEN 'unchecked' WHEN agree THEN 'resolved' ELSE 'mismatch' END AS status, base.id AS base_id, base.at AS base_s,
  CASE WHEN agree THEN concat_ws(chr(10), 'cache-control: max-age=' || (k * 60), 'content-length: ' || size, 'digest: ' || coalesce(digest, digest0), 'etag: ' || coalesce(etag, etag0), 'last-modified: ' || coalesce(since, since0), 'x-captured: ' || a.at) END AS merged
FROM a"""


def license_scan(threshold: float = 0.6) -> str:
    rows = ", ".join(f"({i}, {_quoted(name)}, {_quoted(text)})" for i, (name, text) in enumerate(licenses.TEMPLATES))
    blank, bare, comment = _quoted(licenses._BLANK), _quoted(licenses._BARE), _quoted(licenses._COMMENT)
    cue, named, token = _quoted(licenses.CUE), _quoted(licenses.LICENSE_FILE), r"'[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*'"
    return rf"""
WITH t(i, license, txt) AS (VALUES {rows}),
tt AS (SELECT i, tok, count(*) AS tf FROM (SELECT i, unnest(regexp_extract_all(lower(txt), {token})) AS tok FROM t) GROUP BY 1, 2),
f AS (
  SELECT doc_id, text, source || '/m' || (doc_id % 7) || '/s' || (doc_id % 3) AS dir,
    CASE WHEN length(text) < 300 AND regexp_matches(text, {cue}) THEN 'LICENSE-' || doc_id ELSE 'f' || doc_id || '.txt' END AS name FROM documents),
p AS (SELECT doc_id, text, dir, dir || '/' || name AS path FROM f),
hits AS (SELECT * FROM p WHERE regexp_matches(text, {cue})),
blocks AS (
  SELECT DISTINCT doc_id, path, line FROM (
    SELECT doc_id, path, unnest(string_split_regex(text, {blank})) AS line FROM hits UNION ALL SELECT doc_id, path, unnest(string_split_regex(text, {bare})) FROM hits)
  WHERE contains(line, chr(10)) AND regexp_matches(line, {cue})),
u0 AS (
  SELECT doc_id, path, unnest(string_split(text, chr(10))) AS line, false AS whole FROM hits
  UNION ALL SELECT doc_id, path, line, false FROM blocks
  UNION ALL SELECT doc_id, path, array_to_string(list_filter(string_split(line, chr(10)), lambda x: regexp_matches(x, {comment})), chr(10)), false FROM blocks),
u AS (
  SELECT doc_id, path, line, bool_or(whole) AS whole FROM (
    SELECT * FROM u0 WHERE regexp_matches(line, {cue}) UNION ALL SELECT doc_id, path, text, true FROM p WHERE regexp_matches(path, {named}) AND text <> '')
  GROUP BY ALL),
l AS (SELECT line, count(*) AS n FROM u GROUP BY 1),
total AS (SELECT coalesce(sum(n), 0) AS n FROM l),
tf AS (SELECT line, n, tok, count(*) AS tf FROM (SELECT line, n, unnest(regexp_extract_all(lower(line), {token})) AS tok FROM l) GROUP BY 1, 2, 3),
idf AS (SELECT v.tok, ln((1 + any_value(total.n)) / (1 + coalesce(sum(tf.n), 0))) + 1 AS w FROM (SELECT DISTINCT tok FROM tt) v LEFT JOIN tf USING (tok), total GROUP BY 1),
tn AS (SELECT i, sqrt(sum((tf * w) ** 2)) AS norm FROM tt JOIN idf USING (tok) GROUP BY 1),
x AS (SELECT line, tok, tf * coalesce(w, ln(1 + total.n) + 1) AS x FROM tf LEFT JOIN idf USING (tok), total),
ln_ AS (SELECT line, sqrt(sum(x * x)) AS norm FROM x GROUP BY 1),
dot AS (SELECT line, i, sum(x.x * tt.tf * w) AS d FROM x JOIN tt USING (tok) JOIN idf USING (tok) GROUP BY 1, 2),
best AS (SELECT line, max({{'similarity': round(d / ln_.norm / tn.norm, 4), 'license': license}}) AS best FROM dot JOIN ln_ USING (line) JOIN tn USING (i) JOIN t USING (i) GROUP BY 1),
own AS (
  SELECT doc_id, path, max({{'decides': whole AND best.similarity >= {licenses.WHOLE}, 'similarity': best.similarity, 'license': best.license}}) AS own
  FROM u JOIN best USING (line) WHERE best.similarity >= {threshold} GROUP BY 1, 2),
given AS (SELECT dir AS up, max(own) AS gift FROM own JOIN p USING (doc_id, path) WHERE regexp_matches(path, {named}) GROUP BY 1),
anc AS (SELECT dir, unnest(['', split_part(dir, '/', 1), split_part(dir, '/', 1) || '/' || split_part(dir, '/', 2), dir]) AS up FROM (SELECT DISTINCT dir FROM p)),
near AS (SELECT dir, arg_max(up, length(up)) AS up, arg_max(gift, length(up)) AS gift FROM anc JOIN given USING (up) GROUP BY 1)
SELECT p.doc_id, p.path, coalesce(own.own, near.gift).license AS license, CASE WHEN own.own IS NOT NULL THEN 'header' WHEN near.up IS NOT NULL THEN 'directory' ELSE 'none' END AS via,
  coalesce(own.own, near.gift).similarity AS similarity, CASE WHEN own.own IS NULL THEN near.up END AS from_dir
FROM p LEFT JOIN own USING (doc_id, path) LEFT JOIN near USING (dir)"""


def fill_in_middle() -> str:
    blank = r"[\x20\x09-\x0D]"
    h = lambda k: f"('0x' || substr(d, {8 * k - 7}, 8))::BIGINT"
    return rf"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
k AS (SELECT doc_id, t, regexp_extract_all(t, '{blank}*[^\x20\x09-\x0D]+|{blank}+') AS u, {h(1)} AS h1, {h(2)} AS h2, {h(3)} AS h3, {h(4)} AS h4 FROM h),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM k),
f AS (
  SELECT doc_id, t, n, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM f"""


def importance_resampling() -> str:
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    both = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return rf"""
WITH RECURSIVE step(i, k, c) AS (
  SELECT range, 0, range::BIGINT FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM step WHERE k = 8),
d AS (SELECT row_number() OVER () AS rid, doc_id, {words.format("coalesce(text, '')")} AS w FROM documents),
x AS (SELECT rid, unnest({both}) AS f FROM d),
y AS (SELECT unnest({both}) AS f FROM (SELECT {words.format('text')} AS w FROM benchmark WHERE text IS NOT NULL)),
fs AS (SELECT DISTINCT f FROM (SELECT f FROM x UNION ALL SELECT f FROM y)),
hx AS (SELECT f, hex(encode(f)) AS h FROM fs),
cr AS (
  SELECT f, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(h) // 2 + 1), lambda j: ('0x' || substr(h, 2 * j - 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b
  FROM hx, tab),
s AS (SELECT b, count(*) AS s FROM x JOIN cr USING (f) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM y JOIN cr USING (f) GROUP BY b),
tot AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS s, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS t),
g AS (SELECT s.b, floor(1000 * ln((coalesce(t.t, 0) + 1)::DOUBLE * (tot.s + 10000) / ((s.s + 1)::DOUBLE * (tot.t + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (b), tot),
w AS (SELECT rid, count(*) AS n, sum(gain)::BIGINT AS total FROM x JOIN cr USING (f) JOIN g USING (b) GROUP BY rid),
o AS (
  SELECT doc_id, len(w) AS words, coalesce(n, 0)::BIGINT AS n_features, CASE WHEN n > 0 THEN (total - ((total % n + n) % n)) // n ELSE 0 END::BIGINT AS weight,
    ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM d LEFT JOIN w USING (rid)),
z AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS k, count(*) OVER (PARTITION BY words >= 20) AS all_n FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND k <= all_n * 25 // 100 THEN k END::BIGINT AS rank FROM r"""


def ngram_join() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({lower}, '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT rid, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3])) END) AS f
  FROM d),
n AS (SELECT rid, count(*) AS n, md5(string_agg(f, chr(10) ORDER BY f)) AS h FROM g GROUP BY rid),
rep AS (SELECT h, min(rid) AS rid, any_value(n) AS n FROM n GROUP BY h),
gr AS (SELECT rid, f FROM g SEMI JOIN rep USING (rid)),
lk AS (
  SELECT a, b FROM (SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM gr x JOIN gr y ON x.f = y.f AND x.rid < y.rid GROUP BY ALL) p
  JOIN rep u ON u.rid = a JOIN rep v ON v.rid = b WHERE 100 * c >= 85 * (u.n + v.n - c)),
e AS (SELECT a, b FROM lk UNION ALL SELECT b, a FROM lk),
reach AS (SELECT rid AS a, rid AS b FROM rep UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
own AS (SELECT rep.rid, min(doc_id) AS least FROM rep JOIN n USING (h) JOIN d ON d.rid = n.rid GROUP BY rep.rid),
comp AS (SELECT reach.a AS rid, min(least) AS c FROM reach JOIN own ON own.rid = reach.b GROUP BY reach.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, CASE WHEN n.n IS NULL THEN d.doc_id ELSE comp.c END AS component_id
FROM d LEFT JOIN n USING (rid) LEFT JOIN rep USING (h) LEFT JOIN comp ON comp.rid = rep.rid"""
