"""DuckDB SQL of the prefix trie, by pairs of a conversation's prefixes."""

from __future__ import annotations


def oracle(conversations: str = "conversations") -> str:
    """SQL of trie.prefix_trie over conversations, crc32 included, without the columns of its intervals."""
    return rf"""
WITH RECURSIVE crc(i, v, k) AS (SELECT i, i::BIGINT, 0 FROM range(256) r(i) UNION ALL
  SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM crc WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM crc WHERE k = 8),
ids AS (SELECT DISTINCT conv_id FROM {conversations} WHERE conv_id IS NOT NULL),
h AS (SELECT conv_id, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)),
  lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1])), 4294967295) % 4 AS h FROM ids, tab),
t0 AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {conversations} WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, md5(length(role) || ':' || role || text) AS d, len(regexp_extract_all(text, '[^ \t-\r]+')) AS words,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) - 1 AS place FROM t0),
parts AS (SELECT conv_id, place, d, words FROM own JOIN h USING (conv_id) WHERE place >= h
  UNION ALL SELECT h.conv_id, own.place, own.d, own.words FROM h JOIN own ON own.conv_id = h.conv_id - h.conv_id % 20 WHERE own.place < h.h),
r AS (SELECT conv_id, words, row_number() OVER w AS depth, string_agg(d, '') OVER (w ROWS UNBOUNDED PRECEDING) AS node,
  count(*) OVER (PARTITION BY conv_id) AS turns FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
rows AS (SELECT conv_id, depth, node, CASE WHEN depth > 1 THEN left(node, length(node) - 32) ELSE '' END AS above, words, depth = turns AS ends FROM r
  UNION ALL SELECT conv_id, 0, '', NULL, 0, conv_id NOT IN (SELECT conv_id FROM r) FROM ids),
nodes AS (SELECT node, any_value(above) AS above, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, max(words) AS words,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM rows GROUP BY node),
kids AS (SELECT above AS node, count(*) AS n FROM nodes WHERE above IS NOT NULL GROUP BY above),
below AS (SELECT a.node, b.node AS inner_node FROM (SELECT any_value(conv_id) AS c, node FROM rows GROUP BY node) b JOIN rows a ON a.conv_id = b.c AND length(a.node) <= length(b.node)),
sums AS (SELECT below.node, count(*) FILTER (kids.n IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved FROM below JOIN nodes n ON n.node = below.inner_node LEFT JOIN kids ON kids.node = n.node GROUP BY below.node)
SELECT nodes.conv_id, nodes.depth, up.conv_id AS parent_conv_id, nodes.n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, nodes.ends_sha256
FROM nodes JOIN sums USING (node) LEFT JOIN kids USING (node) LEFT JOIN nodes up ON up.node = nodes.above
"""
