"""DuckDB SQL for the corpus queries that SQL can express, written apart from the operators."""

from __future__ import annotations


def _crc_table() -> list[int]:
    """The table of CRC-32 for each byte, by its polynomial."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


#: Least id reachable over the links (a, b), both ways, for each id that has one.
REACHED = "reached(id, other) AS (SELECT a, b FROM link UNION SELECT reached.id, link.b FROM reached JOIN link ON link.a = reached.other), least AS (SELECT id, min(other) AS other FROM reached GROUP BY id)"

NEAR_DUPLICATES = f"""WITH RECURSIVE
word AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
listed AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM word),
sized AS MATERIALIZED (SELECT doc_id, len(s) AS n FROM listed),
shingle AS MATERIALIZED (SELECT doc_id, hash(x) AS x FROM (SELECT doc_id, unnest(s) AS x FROM listed)),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingle a JOIN shingle b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
pair AS MATERIALIZED (SELECT a, b FROM common JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * common.n >= 80 * (x.n + y.n - common.n)),
link AS MATERIALIZED (SELECT a, b FROM pair UNION SELECT b, a FROM pair),
{REACHED}
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id, doc_id <= coalesce(other, doc_id) AS kept FROM sized LEFT JOIN least ON id = doc_id"""

EMBEDDINGS = f"""WITH RECURSIVE
vector AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
good AS MATERIALIZED (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM vector
    WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.9),
{REACHED},
counted AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(counted.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(other, vec_id)) AS component_id, vec_id <= coalesce(other, vec_id) AS kept
FROM vector LEFT JOIN least ON id = vec_id LEFT JOIN counted ON a = vec_id"""

SHARDING = f"""WITH RECURSIVE
raw AS (SELECT doc_id, encode(coalesce(text, '')) AS t, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS m FROM documents),
hexed AS (SELECT doc_id, octet_length(t) AS n, hex(t) AS h, CAST(CAST('0x' || substr(m, 1, 16) AS UBIGINT) AS HUGEINT) AS k FROM raw),
told AS MATERIALIZED (SELECT doc_id, CAST(n + 8 AS BIGINT) AS size, k,
    CAST(xor(list_reduce(list_transform(range(0, n), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS UINTEGER)), lambda c, x: xor(c >> 8, CAST({_crc_table()}[(xor(c, x) & 255) + 1] AS UINTEGER)), CAST(4294967295 AS UINTEGER)), CAST(4294967295 AS UINTEGER)) AS BIGINT) AS text_crc32 FROM hexed),
jump(k, shards, state, last, ahead) AS (
    SELECT DISTINCT k, s.n, k, CAST(-1 AS BIGINT), 0e0 FROM told, (VALUES (24), (25)) s(n)
    UNION ALL SELECT k, shards, next, CAST(ahead AS BIGINT), floor((ahead + 1) * (2147483648e0 / (CAST(next // 8589934592 AS DOUBLE) + 1)))
    FROM (SELECT *, (state * 2862933555777941757 + 1) % 18446744073709551616 AS next FROM jump WHERE ahead < shards)),
placed AS (SELECT k, CAST(max(last) FILTER (shards = 24) AS INTEGER) AS shard, CAST(max(last) FILTER (shards = 25) AS INTEGER) AS grown_shard FROM jump GROUP BY k),
dealt AS MATERIALIZED (SELECT told.*, shard, grown_shard, CASE WHEN told.k >= 9223372036854775808 THEN told.k - 18446744073709551616 ELSE told.k END AS signed FROM told JOIN placed ON placed.k = told.k),
buckets AS (SELECT greatest(256, (max(n) + 99999) // 100000) AS b FROM (SELECT count(*) AS n FROM dealt GROUP BY shard))
SELECT doc_id, size, text_crc32, 'key' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY (signed % b + b) % b, doc_id, text_crc32, size) AS BIGINT) - 1 AS slot, grown_shard FROM dealt, buckets"""

ORACLES = {"op5_near_duplicates": NEAR_DUPLICATES, "op6_sharding": SHARDING, "op7_embeddings": EMBEDDINGS}
