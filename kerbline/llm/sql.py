"""DuckDB SQL for the queries that SQL can express."""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR END"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


# The checksum bit by bit, over the digits of doc_id.
_CRC32 = """xor(4294967295::UBIGINT, list_reduce(
    list_concat([4294967295::UBIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
    lambda crc, b: list_reduce(
        list_concat([xor(crc, b)], list_transform(range(8), lambda k: k::UBIGINT)),
        lambda x, k: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))))"""

MERKLE = f"""
WITH RECURSIVE docs AS (
    SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
        CASE WHEN {_CRC32} % 7 = 0 AND n_chars IS NOT NULL THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS claim
    FROM documents
), leaves AS (
    SELECT *, coalesce('=' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM docs
), nodes AS (
    SELECT g, 0 AS level, i, leaf AS d, n FROM leaves
    UNION ALL
    SELECT g, level + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY g, level, i // 2, n
), subroots AS (
    SELECT g, level AS depth, d, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
    SELECT 0 AS level, i, d, n FROM subroots
    UNION ALL
    SELECT level + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY level, i // 2, n
), steps AS (
    SELECT l.g, l.i AS leaf_at, s.level, (l.i >> s.level) % 2 AS side, s.d AS sibling
    FROM leaves l JOIN subroots r USING (g), LATERAL (SELECT unnest(range(r.depth)) AS level) v LEFT JOIN nodes s
        ON s.g = l.g AND s.level = v.level AND s.i = xor(l.i >> v.level, 1)
    WHERE s.d IS NOT NULL
), own AS (
    SELECT g, leaf_at, list(struct_pack(level := level, side := side, d := sibling) ORDER BY level) AS path FROM steps GROUP BY g, leaf_at
), above AS (
    SELECT r.g, list(struct_pack(level := t.level, side := (r.i >> t.level) % 2, d := t.d) ORDER BY t.level) AS path
    FROM subroots r JOIN tops t ON t.i = xor(r.i >> t.level, 1) GROUP BY r.g
), whole AS (
    SELECT l.doc_id, l.leaf, l.claim, r.d AS subroot, (SELECT d FROM tops WHERE n = 1) AS root, r.depth, (SELECT max(level) FROM tops) AS height,
        coalesce(own.path, []) AS p, coalesce(above.path, []) AS q
    FROM leaves l JOIN subroots r USING (g) LEFT JOIN own ON own.g = l.g AND own.leaf_at = l.i LEFT JOIN above ON above.g = l.g
), folding AS (
    SELECT doc_id, leaf, subroot, root, depth, height, p, q, 0 AS k, claim AS d FROM whole
    UNION ALL
    SELECT doc_id, leaf, subroot, root, depth, height, p, q, k + 1, sha256(
        CASE WHEN s.side = 1 THEN s.d || f.d WHEN s.side = 0 THEN f.d || s.d ELSE f.d END)
    FROM (SELECT *, CASE WHEN k < depth THEN list_filter(p, lambda x: x.level = k)[1] ELSE list_filter(q, lambda x: x.level = k - depth)[1] END AS s FROM folding WHERE k < depth + height) f
)
SELECT doc_id, leaf, subroot, root, sha256(list_aggregate(list_concat([''], list_transform(list_concat(p, q), lambda x: x.d)), 'string_agg', '')) AS proof_sha256,
    d AS folded_root, d = root AS verified
FROM folding WHERE k = depth + height
"""


def _assigned(k: int) -> str:
    """Nearest entry and distance of each part under codebook k; entries are below 64, so one number orders both."""
    return f"""apart{k} AS (
    SELECT c.rid, c.p, b.e, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS dist FROM parts c JOIN book{k} b ON b.p = c.p AND b.j = c.j GROUP BY c.rid, c.p, b.e
), near{k} AS (
    SELECT rid, p, min(dist * 64 + e) % 64 AS e, min(dist * 64 + e) // 64 AS dist FROM apart{k} GROUP BY rid, p
)"""


def _moved(k: int) -> str:
    return f"""means{k} AS (
    SELECT n.p, n.e, c.j, floor(sum(c.x) / count(*))::BIGINT AS x FROM near{k} n JOIN parts c ON c.rid = n.rid AND c.p = n.p GROUP BY n.p, n.e, c.j
), book{k + 1} AS (
    SELECT b.p, b.e, b.j, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN means{k} m ON m.p = b.p AND m.e = b.e AND m.j = b.j
)"""


VECTOR_CODES = f"""
WITH kept AS (
    SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS rid, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), flat AS (
    SELECT rid, len(v) // 16 AS w, unnest(range(len(v))) AS i, unnest(v) AS x FROM kept
), parts AS MATERIALIZED (
    SELECT rid, i // w AS p, i % w AS j, x FROM flat
), book0 AS (
    SELECT p, rid AS e, j, x FROM parts WHERE rid < 64
), {_assigned(0)}, {_moved(0)}, {_assigned(1)}, {_moved(1)}, {_assigned(2)},
coded AS (
    SELECT k.vec_id, k.label, string_agg(lpad(lower(to_hex(n.e)), 2, '0'), '' ORDER BY n.p) AS code, sum(n.dist)::BIGINT AS error
    FROM kept k JOIN near2 n ON n.rid = k.rid GROUP BY k.rid, k.vec_id, k.label
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
    (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, j)) FROM book2) AS codebooks_sha256
FROM coded
"""
