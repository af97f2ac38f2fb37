"""DuckDB SQL of the token-budgeted context: seeds, expansion up to the cap, ranking, and the fold as a recursion over ranks."""

from __future__ import annotations

from .context import BUDGET, EDGE_TYPES, INCOMING_ONLY, NODE_CAP

_PACKET = """to_json({'id': n.id, 'name': n.name, 'type': n.type, 'filePath': n.file_path, 'lines': n.start_line || '-' || n.end_line, 'hop': e.hop, 'viaEdge': e.via,
  'technicalSummary': n.technical_summary, 'businessSummary': n.business_summary, 'security': CASE WHEN n.severity IS NOT NULL THEN {'severity': n.severity, 'summary': CAST(NULL AS VARCHAR)} END})"""
_SEVERE = "coalesce(n.severity IN ('low', 'medium', 'high'), false)"


def context(seeds: str, intent: str) -> str:
    """``seeds``: SQL that gives (seed_no, id). One hop, as in the registered queries."""
    types = " AND type IN (" + ", ".join(f"'{t}'" for t in EDGE_TYPES[intent]) + ")" if intent in EDGE_TYPES else ""
    ways = [(1, "src", "dst")] + ([] if intent in INCOMING_ONLY else [(2, "dst", "src")])
    walks = "".join(f" UNION ALL SELECT seed_no, {p}, 1, min(pos), e1.{far}, arg_min(type, pos) FROM e1 JOIN s ON e1.{near} = s.id WHERE e1.src <> e1.dst{types} GROUP BY seed_no, s.id, e1.{far}" for p, far, near in ways)
    return f"""WITH s AS ({seeds}), w(seed_no, p, h, pos, id, via) AS (SELECT seed_no, 0, 0, 0, id, 'seed' FROM s{walks}),
f AS (SELECT id, min({{'seed_no': seed_no, 'p': p, 'h': h, 'pos': pos, 'via': via}}) AS k FROM w GROUP BY id),
a AS (SELECT id, k, row_number() OVER (ORDER BY k) - 1 AS place FROM f QUALIFY place < {NODE_CAP}),
last AS (SELECT count(*) >= {NODE_CAP} AS cap, max(k) AS k FROM a),
stop AS (SELECT CASE WHEN NOT cap THEN (SELECT max(seed_no) FROM s) WHEN k.p = 0 THEN k.seed_no ELSE coalesce((SELECT min(seed_no) FROM s WHERE seed_no > (SELECT k.seed_no FROM last)), k.seed_no) END AS n FROM last),
done AS (SELECT id FROM s WHERE seed_no <= (SELECT n FROM stop)),
x AS (SELECT place, id, k.h AS hop, k.via AS via FROM a UNION ALL SELECT DISTINCT {NODE_CAP}, id, 0, 'seed' FROM done WHERE id NOT IN (SELECT id FROM a)),
e AS (SELECT place, id, CASE WHEN id IN (SELECT id FROM done) THEN 0 ELSE hop END AS hop, CASE WHEN id IN (SELECT id FROM done) THEN 'seed' ELSE via END AS via,
  CASE WHEN id IN (SELECT id FROM done) THEN 1.0::DOUBLE WHEN hop = 1 THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS similarity FROM x),
j AS (SELECT e.id, e.hop, CAST(ceil(length(CAST({_PACKET} AS VARCHAR)) / 4.0) AS BIGINT) AS cost, {_SEVERE} AS security,
  CAST(row_number() OVER (ORDER BY NOT {_SEVERE}, -(similarity * 0.6::DOUBLE + coalesce(n.score, 0.0) * 0.4::DOUBLE), place, e.id) AS INT) AS rank FROM e JOIN n1 n ON e.id = n.id),
r(rank, id, hop, cost, security, included, used) AS (SELECT 0, '', 0, CAST(0 AS BIGINT), false, false, CAST(0 AS HUGEINT)
  UNION ALL SELECT j.rank, j.id, j.hop, j.cost, j.security, j.security OR r.used + j.cost <= {BUDGET}, r.used + CASE WHEN j.security OR r.used + j.cost <= {BUDGET} THEN j.cost ELSE 0 END FROM r JOIN j ON j.rank = r.rank + 1)
SELECT rank, id, hop, cost, security, included FROM r WHERE rank > 0"""
