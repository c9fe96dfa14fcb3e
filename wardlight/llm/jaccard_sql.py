"""DuckDB SQL of jaccard.near_duplicates: all pairs that share a shingle, and their closure."""

from __future__ import annotations

from .jaccard import PERCENT


def oracle(docs: str = "documents", percent: int = PERCENT) -> str:
    return rf"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS ws FROM {docs}),
s AS (SELECT DISTINCT rid, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 2], ' ') END AS sh FROM (SELECT *, unnest(generate_series(1, greatest(len(ws) - 2, 1))) AS i FROM w WHERE len(ws) > 0)),
g AS (SELECT rid, count(*) AS n, md5(string_agg(sh, chr(10) ORDER BY sh)) AS dig FROM s GROUP BY rid),
r AS (SELECT dig, min(rid) AS rid, min(n) AS n FROM g GROUP BY dig),
f AS (SELECT sh, rid, n FROM s JOIN r USING (rid)),
t AS (SELECT f.sh, f.rid, f.n, row_number() OVER (PARTITION BY f.rid ORDER BY c.df, f.sh) AS k FROM f JOIN (SELECT sh, count(*) AS df FROM f GROUP BY sh) c USING (sh)),
p AS (SELECT sh, rid, n FROM t WHERE k <= n - (({percent} * n + 99) // 100) + 1),
c AS (SELECT DISTINCT a.rid AS a, b.rid AS b, a.n AS an, b.n AS bn FROM p a JOIN p b ON a.sh = b.sh AND a.rid < b.rid AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * {percent}),
o AS (SELECT c.a, c.b, any_value(c.an) AS an, any_value(c.bn) AS bn, count(*) AS i FROM c JOIN f x ON x.rid = c.a JOIN f y ON y.rid = c.b AND y.sh = x.sh GROUP BY c.a, c.b),
l AS (SELECT a, b FROM o WHERE 100 * i >= {percent} * (an + bn - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
cl(rid, root) AS (SELECT rid, rid FROM r UNION SELECT e.b, cl.root FROM cl JOIN e ON e.a = cl.rid),
lab AS (SELECT rid, min(root) AS root FROM cl GROUP BY rid),
m AS (SELECT w.rid, w.doc_id, coalesce(g.n, 0)::BIGINT AS n_shingles, lab.root FROM w LEFT JOIN g ON g.rid = w.rid LEFT JOIN r ON r.dig = g.dig LEFT JOIN lab ON lab.rid = r.rid)
SELECT doc_id, n_shingles, CASE WHEN root IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY root) END AS component_id FROM m
"""
