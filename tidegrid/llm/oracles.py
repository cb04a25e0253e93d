"""DuckDB SQL of the operators' queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: Every 200-byte string of every text, those that occur twice, and the runs of bytes that they cover.
SUFFIX = """
WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
places AS (SELECT doc_id, b, unnest(range(0, n - 199)) AS i FROM docs WHERE n >= 200),
strings AS (SELECT doc_id, i, md5(array_slice(b, i + 1, i + 200)) AS s FROM places),
again AS (SELECT s FROM strings GROUP BY s HAVING count(*) > 1),
gone AS (SELECT doc_id, i FROM strings SEMI JOIN again USING (s)),
edges AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS new FROM gone),
runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS z FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM edges) GROUP BY ALL),
sums AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, list(a ORDER BY a) AS firsts, list(z ORDER BY a) AS lasts FROM runs GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN n_spans IS NULL THEN b ELSE list_reduce(list_transform(range(0, n_spans + 1), lambda k: CASE WHEN (CASE WHEN k = n_spans THEN n ELSE firsts[k + 1] END) > (CASE WHEN k = 0 THEN 0 ELSE lasts[k] END)
    THEN array_slice(b, (CASE WHEN k = 0 THEN 0 ELSE lasts[k] END) + 1, CASE WHEN k = n_spans THEN n ELSE firsts[k + 1] END) ELSE ''::BLOB END), lambda x, y: x || y) END) AS kept_sha256
FROM docs LEFT JOIN sums USING (doc_id)
"""

LEAKS = f"""
WITH items AS (SELECT item_id, {_WORDS} AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
parts AS (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM items WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item_id, least(10, len(ws)) AS m, array_to_string(list_slice(ws, i, i + 9), ' ') AS w FROM parts),
docs AS (SELECT doc_id, {_WORDS.replace('text', "coalesce(text, '')")} AS ws FROM documents),
sizes AS (SELECT DISTINCT m FROM windows),
places AS (SELECT doc_id, m, ws, unnest(range(1, len(ws) - m + 2)) AS i FROM docs, sizes WHERE len(ws) >= m),
hits AS (SELECT p.doc_id, p.i, p.m, w.item_id FROM (SELECT doc_id, m, i, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS w FROM places) p JOIN windows w ON p.m = w.m AND p.w = w.w),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM hits) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def _u(node: str) -> str:
    return f"((('0x' || substr(md5(doc_id::VARCHAR || '|' || {node}), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"


def _level(source: str, parent: str, out: str, children: str) -> str:
    """The least draw among the children of each row's node."""
    return f"{out} AS (SELECT doc_id, arg_min(n, (d, n)) AS at FROM (SELECT s.doc_id, c.n, -ln({_u('c.n')}) / c.w AS d FROM {source} s JOIN {children} c ON c.p = {parent}) GROUP BY doc_id)"


def shards(regions: int = 4, racks: int = 2, per_rack: int = 5, blocks: int = 64) -> str:
    """Equal shards in regions and racks; the grown tree has one more region with one shard."""
    n = regions * racks * per_rack
    return f"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(v, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY v) AS t FROM (SELECT unnest(range(0, 256)) AS v)),
docs AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 16 AS size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS crc FROM documents, crc),
region AS (SELECT 'root' AS p, 'r' || i AS n, {racks * per_rack}.0::DOUBLE AS w, i FROM (SELECT unnest(range(0, {regions})) AS i)),
more AS (SELECT p, n, w FROM region UNION ALL SELECT 'root', 'x{n}', 1.0),
rack AS (SELECT n AS p, n || '.k' || k AS n, {per_rack}.0::DOUBLE AS w FROM region, (SELECT unnest(range(0, {racks})) AS k) UNION ALL SELECT 'x{n}', 'x{n}.k0', 1.0),
shard AS (SELECT 'r' || (i // {racks * per_rack}) || '.k' || (i % {racks * per_rack} // {per_rack}) AS p, 's' || i AS n, 1.0::DOUBLE AS w FROM (SELECT unnest(range(0, {n})) AS i) UNION ALL SELECT 'x{n}.k0', 's{n}', 1.0),
{_level('docs', "'root'", 'a1', 'region')}, {_level('a1', 's.at', 'a2', 'rack')}, {_level('a2', 's.at', 'a3', 'shard')},
{_level('docs', "'root'", 'b1', 'more')}, {_level('b1', 's.at', 'b2', 'rack')}, {_level('b2', 's.at', 'b3', 'shard')},
placed AS (SELECT doc_id, size, crc, substr(a3.at, 2)::INT AS shard, substr(b3.at, 2)::INT AS grown, ('0x' || substr(md5('block|' || doc_id || '|' || crc), 1, 6))::BIGINT % {blocks} AS blk FROM docs JOIN a3 USING (doc_id) JOIN b3 USING (doc_id))
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY blk, doc_id) - 1)::BIGINT AS slot, grown AS grown_shard FROM placed
"""


ORACLE_SQL = {"op4_suffix_dedup": SUFFIX, "op6_decontaminate": LEAKS, "op8_hash_tree_shards": shards()}
