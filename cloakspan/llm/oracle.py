"""DuckDB's SQL for operators of this subpackage, each written from the contract: all pairs, windows or alignments are looked at."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

_SPACED = r"[^\x20\x09-\x0D]+"

#: DuckDB's levenshtein() counts bytes: the letters beyond ASCII of two lines are put as ASCII ones that neither has.
LINE_DEDUP = r"""WITH l AS (SELECT doc_id, i, line FROM (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))),
d AS (SELECT line, length(line) AS n, min({'d': doc_id, 'i': i}) AS f FROM l WHERE trim(line) <> '' GROUP BY line),
pairs AS (SELECT a.line AS a, b.line AS b FROM d a JOIN d b ON a.n BETWEEN b.n - 3 AND b.n + 3 AND a.n >= 20 AND b.n >= 20 AND a.f < b.f WHERE levenshtein(a.line, b.line) <= 12),
shown AS (SELECT *, array_to_string(list_distinct(list_filter(string_split(a || b, ''), lambda c: unicode(c) > 127)), '') AS wide, array_to_string(list_filter(list_transform(range(1, 128), lambda c: chr(c::INTEGER)), lambda c: NOT contains(a || b, c)), '') AS free FROM pairs),
near AS (SELECT DISTINCT b AS line FROM shown WHERE levenshtein(translate(a, wide, substr(free, 1, length(wide))), translate(b, wide, substr(free, 1, length(wide)))) <= 3),
gone AS (SELECT doc_id, i FROM l JOIN d USING (line) WHERE line IN (FROM near) OR {'d': doc_id, 'i': i} > f),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t, count(*) AS n FROM l ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines, (len(string_split(coalesce(text, ''), chr(10))) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)"""

NEAR_DEDUP = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '{_SPACED}') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS s FROM w),
n AS (SELECT doc_id, s, len(s)::BIGINT AS n FROM s),
e AS (SELECT a, b FROM (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS total, len(list_intersect(a.s, b.s)) AS x FROM n a JOIN n b ON a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) AND a.n > 0 AND b.n > 0) WHERE 100 * x >= 80 * (total - x)),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT g.b, r.c FROM r JOIN g ON g.a = r.doc_id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id) USING (doc_id)"""

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CUT = f"list_filter(string_split_regex(lower(replace(coalesce(text, ''), chr(8490), chr(11369))), '{_GAP}'), lambda w: w <> '')"
#: An overlap has three equal words running at least, or is all of a shorter item.
DECONTAMINATION = f"""WITH d AS (SELECT DISTINCT doc_id, {_CUT} AS ws FROM documents),
m AS (SELECT item_id, ws, row_number() OVER () AS k, least(3, len(ws)) AS g FROM (SELECT DISTINCT item_id, {_CUT} AS ws FROM benchmark) WHERE len(ws) > 0),
dg AS (SELECT doc_id, i, g, array_to_string(ws[i:i + g - 1], ' ') AS key FROM (SELECT doc_id, ws, g, unnest(range(1, len(ws) - g + 2)) AS i FROM d, (SELECT DISTINCT g FROM m))),
mg AS (SELECT k, i, g, array_to_string(ws[i:i + g - 1], ' ') AS key FROM (SELECT *, unnest(range(1, len(ws) - g + 2)) AS i FROM m)),
a AS (SELECT DISTINCT doc_id, k, dg.i - mg.i AS start FROM dg JOIN mg USING (g, key)),
e AS (SELECT doc_id, item_id, start, len(m.ws) AS n, list_transform(range(greatest(0, -start), least(len(m.ws), len(d.ws) - start)), lambda j: (d.ws[start + j + 1] = m.ws[j + 1])::INTEGER) AS eq FROM a JOIN d USING (doc_id) JOIN m USING (k)),
b AS (SELECT *, coalesce(list_max(list_transform(range(1, len(eq) - least(13, n) + 2), lambda s: list_sum(eq[s:s + least(13, n) - 1]))), 0) AS best FROM e),
x AS (SELECT doc_id, item_id, max({{'a': list_sum(eq), 'b': len(eq), 'c': -start}}) AS x FROM b WHERE best >= CASE WHEN n < 9 THEN n ELSE 0.8 * least(13, n) END GROUP BY ALL)
SELECT doc_id, item_id, x.a::BIGINT AS n_equal, x.b::BIGINT AS n_aligned, (-x.c)::BIGINT AS first_word FROM x"""

SUBSTRING_DEDUP = rf"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT *, unnest(range(1, len(ws) - 11)) AS i FROM w)),
firsts AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM win JOIN firsts USING (k) WHERE d < doc_id),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM p ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""
