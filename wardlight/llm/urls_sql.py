"""DuckDB SQL of urls.judge, built from the same limits and rules."""

from __future__ import annotations

from .urls import Rule, TreeLimits

#: Levels that the SQL generalises; judge goes on as long as a node has limits.fanout templates below it.
LEVELS = 4


def oracle(rules: list[Rule], limits: TreeLimits = TreeLimits(), pages: str = "pages") -> str:
    w = f"{limits.prior_weight!r}::DOUBLE"
    rule = "NULL"
    for _, written in sorted(rules, key=lambda r: len(r[1])):
        host, slash, rest = written.partition("/")
        rule = f"CASE WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + rest}') THEN '{written}' ELSE {rule} END"
    said = "CASE " + " ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in rules) + " END"
    general = r"""CASE WHEN regexp_matches(x, '^[0-9]+$') OR (regexp_matches(x, '[0-9]') AND regexp_matches(x, '^[0-9a-fA-F-]{8,}$')) THEN '*'
  WHEN regexp_matches(x, '^[0-9]+\.[A-Za-z]{1,5}$') THEN regexp_replace(x, '^[0-9]+', '*')
  WHEN regexp_matches(x, '[0-9]{4,}') THEN regexp_replace(x, '[0-9]+', '*', 'g') ELSE x END"""
    sql = rf"""
WITH parts AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM {pages}),
ruled AS (SELECT *, {rule} AS rule FROM parts),
saying AS (SELECT *, {said} AS said, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: {general}) AS segs FROM ruled),
placed AS (SELECT page_id, host, path, rule, said, CASE said WHEN 'block' THEN 1 WHEN 'allow' THEN 0 END AS label, segs FROM saying),
f0 AS (SELECT host, segs, segs AS t, count(*) AS n, count(label) AS lab, coalesce(sum(label), 0)::BIGINT AS blk FROM placed GROUP BY host, segs)"""
    for k in range(LEVELS):
        sql += f""",
c{k} AS (SELECT host, t[1:{k}] AS prefix, t[{k + 1}] AS child, sum(n) AS child_n FROM f{k} WHERE len(t) > {k} GROUP BY ALL),
w{k} AS (SELECT host, prefix, sum(child_n) AS node_n FROM c{k} GROUP BY ALL HAVING count(*) >= {limits.fanout}),
r{k} AS (SELECT host, prefix, child FROM c{k} JOIN w{k} USING (host, prefix) WHERE child_n * {limits.rare_share} < node_n),
f{k + 1} AS (SELECT f.host, f.segs, CASE WHEN r.child IS NOT NULL THEN t[1:{k}] || ['*'] || t[{k + 2}:] ELSE t END AS t, n, lab, blk
  FROM f{k} f LEFT JOIN r{k} r ON f.host = r.host AND len(f.t) > {k} AND f.t[1:{k}] = r.prefix AND f.t[{k + 1}] = r.child)"""
    f = f"f{LEVELS}"
    return sql + f""",
nodes AS (SELECT host, t[1:d] AS prefix, t[1:d - 1] AS parent, sum(lab) AS lab, sum(blk) AS blk FROM (SELECT *, unnest(generate_series(1, len(t))) AS d FROM {f} WHERE lab > 0) GROUP BY ALL),
shared AS (SELECT prefix, sum(lab) AS all_lab, sum(blk) AS all_blk FROM nodes GROUP BY prefix),
rated AS (SELECT *, blk::DOUBLE / lab AS rate FROM nodes),
lagged AS (SELECT *, lag(lab) OVER o AS lab_0, lag(blk) OVER o AS blk_0, lag(rate) OVER o AS rate_0 FROM rated WINDOW o AS (PARTITION BY host, parent ORDER BY rate, prefix)),
tested AS (SELECT *, (blk + blk_0)::DOUBLE / (lab + lab_0) AS pooled FROM lagged),
parted AS (SELECT *, CASE WHEN coalesce(rate - rate_0 > {limits.similar!r}::DOUBLE * sqrt(pooled * (1 - pooled) * (1::DOUBLE / lab + 1::DOUBLE / lab_0)), false) THEN 1 ELSE 0 END AS apart FROM tested),
branched AS (SELECT *, sum(apart) OVER (PARTITION BY host, parent ORDER BY rate, prefix) AS branch FROM parted),
own AS (SELECT host, prefix, sum(lab) OVER b AS lab, sum(blk) OVER b AS blk FROM branched WINDOW b AS (PARTITION BY host, parent, branch)),
base AS (SELECT (coalesce(sum(blk), 0) + 0.5::DOUBLE) / (coalesce(sum(lab), 0) + 1::DOUBLE) AS overall FROM {f}),
hosts AS (SELECT host, (sum(blk) + {w} * any_value(overall)) / (sum(lab) + {w}) AS own_0, any_value(overall) AS all_0 FROM {f}, base GROUP BY host),
steps AS (SELECT host, t, unnest(generate_series(1, len(t))) AS d FROM (SELECT DISTINCT host, t FROM {f})),
counted AS (SELECT s.host, s.t, d, coalesce(o.lab, 0)::DOUBLE AS lab, coalesce(o.blk, 0)::DOUBLE AS blk, coalesce(a.all_lab, 0)::DOUBLE AS all_lab, coalesce(a.all_blk, 0)::DOUBLE AS all_blk
  FROM steps s LEFT JOIN own o ON o.host = s.host AND o.prefix = s.t[1:d] LEFT JOIN shared a ON a.prefix = s.t[1:d]),
paths AS (SELECT host, t, list({{'lab': lab, 'blk': blk, 'all_lab': all_lab, 'all_blk': all_blk, 'all': 0::DOUBLE, 'own': 0::DOUBLE}} ORDER BY d) AS path FROM counted GROUP BY host, t),
folded AS (SELECT h.host, d.t, list_reduce(list_concat([{{'lab': 0::DOUBLE, 'blk': 0::DOUBLE, 'all_lab': 0::DOUBLE, 'all_blk': 0::DOUBLE, 'all': all_0, 'own': own_0}}], coalesce(path, [])),
  lambda a, x: {{'lab': 0::DOUBLE, 'blk': 0::DOUBLE, 'all_lab': 0::DOUBLE, 'all_blk': 0::DOUBLE, 'all': (x.all_blk + {w} * a."all") / (x.all_lab + {w}),
  'own': (x.blk + {w} * (((x.all_blk + {w} * a."all") / (x.all_lab + {w}) + a.own) / 2)) / (x.lab + {w})}}).own AS purity
  FROM (SELECT DISTINCT host, t FROM {f}) d JOIN hosts h USING (host) LEFT JOIN paths p ON p.host = d.host AND p.t = d.t)
SELECT page_id, p.host, p.path, rule, coalesce(said, CASE WHEN purity >= {limits.reject!r} THEN 'block' ELSE 'allow' END) AS verdict, '/' || array_to_string(f.t, '/') AS template, purity
FROM placed p LEFT JOIN {f} f ON f.host = p.host AND f.segs = p.segs LEFT JOIN folded d ON d.host = f.host AND d.t = f.t"""
