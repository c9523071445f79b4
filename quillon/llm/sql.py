"""SQL for DuckDB of the operators' queries that SQL can express; the other queries are tested against brute force."""

from __future__ import annotations

from . import licenses

_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
_SPACED = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _runs(words: str, k: str) -> str:
    """The runs of k words, each as one string."""
    return f"[array_to_string({words}[i:i + {k} - 1], ' ') for i in range(1, len({words}) - {k} + 2)]"


#: Every window that starts at a shingle of an item, its weighted shingles counted in full.
DECONTAMINATION = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark), b AS (SELECT DISTINCT item_id, w, len(w) AS n, least(len(w), 5) AS k FROM i WHERE len(w) > 0),
bs AS (SELECT *, {_runs('w', 'k')} AS s FROM b), bx AS (SELECT DISTINCT item_id, w, n, k, s, unnest(s) AS x FROM bs),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents), ks AS (SELECT DISTINCT k FROM b),
ds AS (SELECT doc_id, d.w AS dw, k, unnest({_runs('d.w', 'k')}) AS x, unnest(range(0, len(d.w) - k + 1)) AS p FROM d, ks),
h AS (SELECT ds.doc_id, bx.item_id, bx.n, bx.k, bx.s, ds.p, ds.dw[ds.p + 1:ds.p + bx.n] AS v FROM ds JOIN bx ON ds.k = bx.k AND ds.x = bx.x),
wa AS (SELECT *, {_runs('v', 'k')} AS a FROM h),
m AS (SELECT doc_id, item_id, p, list_sum([least(len(list_filter(a, lambda y: y = x)), len(list_filter(s, lambda z: z = x))) for x in list_distinct(s)]) AS mutual, len(a) + len(s) AS total FROM wa)
SELECT doc_id, item_id, max(mutual / (total - mutual)::DOUBLE) AS similarity, count(DISTINCT p)::BIGINT AS n_windows, min(p)::INTEGER AS first_word
FROM m WHERE mutual / (total - mutual)::DOUBLE >= 0.8 GROUP BY doc_id, item_id
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    copyright_ = licenses.COPYRIGHT
    low = f"translate(coalesce({text}, ''), '{licenses.UPPER}', '{licenses.LOWER}')"
    guarded = f"regexp_replace({low}, '{licenses.GUARD}', 'copyright' || chr({ord(licenses.MARK)}) || '\\1', 'g')"
    bare = f"regexp_replace(regexp_replace({guarded}, '{copyright_}', chr(10), 'g'), '{licenses.RESERVED}', ' ', 'g')"
    table = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in licenses.SPELLINGS.items()) + "}"
    words = f"list_filter(regexp_split_to_array({bare}, '{licenses.NOT_WORD}'), lambda w: w <> '')"
    return f"array_to_string(list_transform({words}, lambda w: coalesce({table}[w], w)), ' ')"


LICENSES = f"""
WITH known AS (SELECT canonical_sha256, min(license_id) AS license_id FROM (SELECT sha256(c) AS canonical_sha256, license_id FROM (SELECT license_id, {_canonical('text')} AS c
FROM (VALUES {', '.join(f'({_quoted(a)}, {_quoted(b)})' for a, b in licenses.KNOWN)}) t(license_id, text))
UNION ALL VALUES {', '.join(f"('{d}', '{i}')" for d, i in licenses.DIGESTS.items())}) GROUP BY 1)
SELECT doc_id, canonical_sha256, license_id FROM (SELECT doc_id, sha256({_canonical('text')}) AS canonical_sha256 FROM documents) LEFT JOIN known USING (canonical_sha256)
"""

#: All pairs of different sets that share a shingle, compared exactly, and their components.
JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED} AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE {_runs('w', '5')} END)) AS s FROM d),
g AS (SELECT s, min(doc_id) AS rep, count(*) AS copies FROM s GROUP BY s), x AS (SELECT rep, len(s) AS n, unnest(s) AS x FROM g),
p AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.x = b.x AND a.rep <> b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
r(node, other) AS (SELECT rep, rep FROM g UNION SELECT r.node, p.b FROM r JOIN p ON p.a = r.other),
c AS (SELECT node, min(other) AS class_id FROM r GROUP BY node),
l AS (SELECT p.a AS rep, sum(g.copies) AS links FROM p JOIN g ON g.rep = p.b GROUP BY p.a)
SELECT s.doc_id, c.class_id, (g.copies - 1 + coalesce(l.links, 0))::BIGINT AS n_links FROM s JOIN g ON g.s = s.s JOIN c ON c.node = g.rep LEFT JOIN l ON l.rep = g.rep
"""

_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32 = " || ".join(f"array_to_string([substr('{_DIGITS}', ((('0x' || substr(h, {1 + 10 * k}, 10))::BIGINT >> (35 - 5 * i)) & 31)::INTEGER + 1, 1) for i in range(8)], '')" for k in range(4))

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h)
"""

REPEATS = f"""
WITH d AS (SELECT doc_id, {_SPACED} AS w FROM documents), n AS (SELECT doc_id, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) u(i)),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS x FROM d, unnest(range(1, len(w) - 18)) u(i)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) > 1 AS again FROM x),
c AS (SELECT doc_id, i, word, max(coalesce(again, FALSE)::INTEGER) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) > 0 AS gone FROM n LEFT JOIN r USING (doc_id, i)),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

SQL = {"op1_decontamination": DECONTAMINATION, "op3_licenses": LICENSES, "op4_jaccard": JACCARD, "op6_warc": WARC, "op7_repeats": REPEATS}
