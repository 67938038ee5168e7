"""SQL (DuckDB) for the results of those corpus queries that SQL can express; brute force over all rows."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REACH = "reach(node, other) AS (SELECT {id}, {id} FROM {nodes} UNION SELECT r.node, e.b FROM reach r JOIN edge e ON e.a = r.other)"

OP2 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS s FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(k) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
{_REACH.format(id="doc_id", nodes="documents")},
c AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.node = d.doc_id
"""

OP6 = f"""
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS n FROM e),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND x.vec_id < y.vec_id WHERE x.n > 0 AND y.n > 0 AND list_dot_product(x.v, y.v) / (x.n * y.n) >= CAST('0.93' AS DOUBLE)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
{_REACH.format(id="vec_id", nodes="embeddings")},
c AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node), l AS (SELECT a, count(*) AS n FROM edge GROUP BY a)
SELECT v.vec_id, coalesce(l.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept FROM embeddings v LEFT JOIN l ON l.a = v.vec_id JOIN c ON c.node = v.vec_id
"""

_TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP9 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS w FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all({_LOWER}, '{_TERM}') AS w FROM benchmark),
i AS (SELECT item_id, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
iw AS (SELECT item_id, w, n, array_to_string(w[k : k + n - 1], ' ') AS s, min(k) AS k FROM i, unnest(range(1, len(w) - n + 2)) t(k) GROUP BY 1, 2, 3, 4),
dw AS (SELECT doc_id, k, z.n, array_to_string(w[k : k + z.n - 1], ' ') AS s FROM w, (SELECT DISTINCT n FROM i) z, unnest(range(1, len(w) - z.n + 2)) t(k) WHERE len(w) >= z.n),
m AS (SELECT dw.doc_id, dw.k, dw.n, iw.item_id, iw.w, iw.k AS ipos FROM dw JOIN iw ON iw.s = dw.s AND iw.n = dw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(range(m.k, m.k + m.n)) t(p) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id),
runs AS (SELECT DISTINCT doc_id, item_id, w, k - ipos AS shift, ipos - row_number() OVER (PARTITION BY doc_id, item_id, w, k - ipos ORDER BY ipos) AS run FROM m),
ph AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id),
tc AS (SELECT t, count(*) AS n FROM (SELECT unnest(w) AS t FROM w) GROUP BY t),
it AS (SELECT DISTINCT item_id, w, t FROM (SELECT item_id, w, unnest(w) AS t FROM i)),
r AS (SELECT item_id, w, it.t, row_number() OVER (PARTITION BY item_id, w ORDER BY coalesce(tc.n, 0), it.t) AS rk FROM it LEFT JOIN tc ON tc.t = it.t),
p AS (SELECT doc_id, t, k FROM (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS k FROM w) WHERE t IN (SELECT t FROM r WHERE rk <= 2)),
near AS (SELECT a.doc_id, count(DISTINCT x.item_id) AS n FROM r x JOIN r y ON y.item_id = x.item_id AND y.w = x.w AND x.rk = 1 AND y.rk = 2 JOIN p a ON a.t = x.t JOIN p b ON b.t = y.t AND b.doc_id = a.doc_id AND abs(a.k - b.k) <= 5 GROUP BY a.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(g.n_items, 0) AS n_items, sha256(coalesce(g.items, '')) AS items_sha256,
    coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(w.w) AS contaminated, coalesce(ph.n, 0) AS n_phrases, coalesce(near.n, 0) AS n_near
FROM w LEFT JOIN h ON h.doc_id = w.doc_id LEFT JOIN g ON g.doc_id = w.doc_id LEFT JOIN ph ON ph.doc_id = w.doc_id LEFT JOIN near ON near.doc_id = w.doc_id
"""

SQL = {"op2_near_dedup": OP2, "op6_embedding_dedup": OP6, "op9_decontamination": OP9}
