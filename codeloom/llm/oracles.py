"""DuckDB SQL of the operators that SQL can express over whole tables: all pairs of texts by their shingles, all windows of bytes."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def _shingles(table: str, key: str) -> str:
    """(key, s): distinct five-word shingles; a shorter text gives its whole sequence, no words none."""
    many = "list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))"
    return f"SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= 5 THEN {many} WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM (SELECT {key}, {_WORDS} AS w FROM {table}) t"


#: Equal sets are one class, by their smallest id, before pairs are counted; components by walking links from every class.
NEAR_DUPLICATES = f"""WITH RECURSIVE s AS MATERIALIZED ({_shingles("documents", "doc_id")}),
f AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS k FROM s GROUP BY doc_id), c AS MATERIALIZED (SELECT k, min(doc_id) AS rep, min(n) AS n FROM f GROUP BY k),
t AS (SELECT doc_id, s FROM s WHERE doc_id IN (SELECT rep FROM c)),
p AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM t a JOIN t b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT u, v FROM p JOIN c x ON x.rep = u JOIN c y ON y.rep = v WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
e AS MATERIALIZED (SELECT u, v FROM l UNION SELECT v, u FROM l), r(a, b) AS (SELECT rep, rep FROM c UNION SELECT r.a, e.v FROM r JOIN e ON e.u = r.b),
g AS (SELECT a, min(b) AS component FROM r GROUP BY a)
SELECT d.doc_id, coalesce(f.n, 0) AS n_shingles, CASE WHEN d.doc_id IS NOT NULL THEN coalesce(g.component, d.doc_id) END AS component_id, coalesce(g.component, d.doc_id) IS NOT DISTINCT FROM d.doc_id AS kept
FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id LEFT JOIN c ON c.k = f.k LEFT JOIN g ON g.a = c.rep"""

CONTAMINATED = f"""WITH i AS MATERIALIZED ({_shingles("benchmark", "item_id")}), n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
d AS (SELECT doc_id, item_id, count(*) AS shared FROM ({_shingles("documents", "doc_id")}) JOIN i USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_item_shingles, shared AS n_shared, shared / n AS containment FROM d JOIN n USING (item_id) WHERE shared >= 0.75 * n"""


def _repeated(window: int, name: str) -> str:
    """``name``(r, a, b): maximal runs of bytes covered by windows that start elsewhere too."""
    step = 2 * window
    return f"""{name}_b AS (SELECT r, p, substr(h, 2 * p + 1, {2 * (step + window - 1)}) AS part FROM (SELECT r, h, unnest(range(0, n - {window - 1}, {step})) AS p FROM d WHERE n >= {window})),
{name}_w AS MATERIALIZED (SELECT r, p + j AS i, md5_number(substr(part, 2 * j + 1, {2 * window})) AS k FROM (SELECT r, p, part, unnest(range(0, least({step}, len(part) // 2 - {window - 1}))) AS j FROM {name}_b)),
{name}_m AS (SELECT r, i, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > {window}, true) AS fresh FROM {name}_w WHERE k IN (SELECT k FROM {name}_w GROUP BY k HAVING count(*) > 1)),
{name} AS MATERIALIZED (SELECT r, min(i) AS a, max(i) + {window} AS b FROM (SELECT r, i, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS run FROM {name}_m) GROUP BY r, run)"""


#: Texts as hexadecimal digits, so that places are bytes; windows are cut from blocks, which keeps substr short.
REPEATS = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
{_repeated(400, "x")}, {_repeated(200, "y")},
o AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM x),
k AS (SELECT o.r, sum(b - a) AS removed, count(*) AS spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || any_value(substr(h, 2 * e + 1)) AS kept FROM o JOIN d USING (r) JOIN (SELECT r, max(b) AS e FROM x GROUP BY r) USING (r) GROUP BY o.r),
q AS (SELECT r, sum(b - a) AS passage FROM y GROUP BY r)
SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256, CAST(coalesce(passage, 0) AS BIGINT) AS n_passage_bytes
FROM d LEFT JOIN k USING (r) LEFT JOIN q USING (r)"""
