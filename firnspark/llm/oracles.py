"""DuckDB SQL for the rows of corpus queries, straight from their definitions: all pairs, all windows, all links."""

from __future__ import annotations

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

_CHARS = " || ".join(f"substr('{ALPHABET}', CAST((('0x' || substr(sha1(body), {5 * g + 1}, 5))::BIGINT >> {s}) & 31 AS INT) + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))
WARC = f"""
WITH a AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
b AS (SELECT page_id, body, max(page_id) OVER (PARTITION BY body) AS last_ FROM a)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, {_CHARS} AS payload_digest,
  CASE WHEN page_id = last_ THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last_ THEN last_ END AS refers_to FROM b
"""


def components(nodes: str, links: str) -> str:
    """Steps lab, comp: the least node each node reaches; nodes (id), links (a, b) in both directions."""
    return f"""reach AS (SELECT id, id AS r FROM {nodes} UNION SELECT l.a, x.r FROM reach x JOIN {links} l ON l.b = x.id AND x.r < l.a),
comp AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)"""


#: All pairs of usable vectors by cosine in double precision.
NEIGHBOURS = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x))) AND list_max(list_transform(e, lambda x: abs(x))) > 0),
l AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id <> b.id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
{components("v", "l")}
SELECT v.id AS vec_id, coalesce(n, 0) AS n_links, component_id, v.id = component_id AS kept FROM v JOIN comp USING (id) LEFT JOIN n ON n.a = v.id
"""

#: All pairs of documents that share a shingle, by exact intersection.
JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\x0C\\r]+') AS w FROM documents),
s AS (SELECT id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] || ' ' || w[k + 3]) END) AS s FROM w),
n AS (SELECT id, CAST(len(s) AS BIGINT) AS n FROM s),
e AS (SELECT id, unnest(s) AS g FROM s),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS i FROM e a JOIN e b ON a.g = b.g AND a.id <> b.id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
{components("n", "l")}
SELECT n.id AS doc_id, n.n AS n_shingles, component_id FROM n JOIN comp USING (id)
"""

#: Every window of 200 bytes (400 hexadecimal digits), those found twice, the runs they cover, and what is left.
SUFFIXES = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, unnest(range(CAST(length(h) // 2 - 199 AS BIGINT))) AS pos, h FROM h WHERE length(h) >= 400),
k AS (SELECT doc_id, pos, md5_number(substr(h, CAST(2 * pos + 1 AS BIGINT), 400)) AS key FROM p),
d AS (SELECT doc_id, pos FROM k QUALIFY count(*) OVER (PARTITION BY key) > 1),
g AS (SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 200 THEN 0 ELSE 1 END AS fresh FROM d),
r AS (SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM g),
s AS (SELECT doc_id, min(pos) AS lo, max(pos) + 200 AS hi FROM r GROUP BY doc_id, run),
t AS (SELECT doc_id, list(lo ORDER BY lo) AS lo, list(hi ORDER BY lo) AS hi, count(*) AS n_spans, sum(hi - lo) AS n FROM s GROUP BY doc_id),
f AS (SELECT doc_id, h, coalesce(lo, []) AS lo, coalesce(hi, []) AS hi, coalesce(n_spans, 0) AS n_spans, coalesce(n, 0) AS n FROM h LEFT JOIN t USING (doc_id))
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(n AS BIGINT) AS n_removed, n_spans,
  sha256(unhex(array_to_string(list_transform(range(0, len(lo) + 1), lambda j: substr(h, CAST(2 * coalesce(hi[j], 0) + 1 AS BIGINT), CAST(2 * (coalesce(lo[j + 1], length(h) // 2) - coalesce(hi[j], 0)) AS BIGINT))), ''))) AS kept_sha256 FROM f
"""
