"""The queries of operators that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP5 = f"""
WITH docs AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM docs),
windows AS (SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM docs)),
late AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) AS n FROM windows) WHERE n > 1),
marked AS (
    SELECT words.doc_id, p, word, max(s) OVER (PARTITION BY words.doc_id ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
    FROM words LEFT JOIN late ON late.doc_id = words.doc_id AND s = p
),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS text FROM marked GROUP BY doc_id)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc_id)
"""

_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {at}, 5))::bigint >> {shift}) & 31)::int, 1)"
_BASE32 = " || ".join(_DIGIT.format(at=5 * (i // 4) + 1, shift=15 - 5 * (i % 4)) for i in range(32))

OP6 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT h, max(page_id) AS first FROM p GROUP BY h)
SELECT page_id, strlen(html)::bigint AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h)
"""

_VECTORS = """SELECT vec_id, label, embedding::double[] AS v FROM embeddings
    WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"""

OP7 = f"""
WITH e AS ({_VECTORS}), scored AS (SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.v, e.v) AS score FROM e AS q JOIN e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id)
SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::int AS rank FROM scored) WHERE rank <= 20
"""

OP9 = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, x FROM (SELECT doc_id, unnest(CASE len(w) WHEN 0 THEN [] WHEN 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS x FROM docs)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM met JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id, doc_id AS other FROM docs UNION SELECT r.doc_id, b FROM reach r JOIN both_ways ON r.other = a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""

OP10 = f"""
WITH RECURSIVE e AS ({_VECTORS} AND label IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, b FROM reach r JOIN l ON r.other = a),
c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
"""

# CRC-32 byte by byte, with its table made by the eight steps of each byte.
_CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t"
_CRC = "xor(list_reduce(list_transform(range(1, strlen({x}) + 1), lambda i: ('0x' || substr(hex({x}), 2 * i - 1, 2))::bigint), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295)"
_SHORTER = "substr({w}, 1, {i}) || substr({w}, {i} + 2)"

OP11 = f"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
runs AS (SELECT coalesce(doc_id::varchar, '') || ':' || w AS x, w, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents) WHERE length(w) >= 6 GROUP BY ALL),
hashed AS (SELECT w, c, {_CRC.format(x="x")} AS h FROM runs, crc),
words AS (SELECT word, sum(c)::bigint AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN {_SHORTER.format(w="w", i="(h % length(w))")} ELSE w END AS word, c FROM hashed)
    WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
cuts AS (SELECT word, n, i, {_SHORTER.format(w="word", i="i")} AS cut FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (SELECT DISTINCT a.word AS word, a.n AS n, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
    UNION SELECT c.word, c.n, w.word, w.n FROM cuts c JOIN words w ON c.cut = w.word
    UNION SELECT w.word, w.n, c.word, c.n FROM cuts c JOIN words w ON c.cut = w.word),
ranked AS (SELECT word, n, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r FROM pairs),
best AS (SELECT word, n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM ranked WHERE r = 1),
steps AS (SELECT word, word AS root, 0 AS k FROM words UNION ALL SELECT s.word, b.form, k + 1 FROM steps s JOIN best b ON s.root = b.word WHERE b.form IS NOT NULL)
SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, form, form_n, root FROM words w LEFT JOIN best USING (word) JOIN (SELECT word, max_by(root, k) AS root FROM steps GROUP BY word) USING (word)
"""


def _lloyd(k: int = 40, rounds: int = 5) -> str:
    """Each round as two steps: the nearest centroid of every vector, and the floor of its vectors' mean for each centroid."""
    parts = [
        """WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1)::int AS k, v AS c FROM kept ORDER BY sha256('2:' || vec_id) LIMIT {k})",
    ]
    for r in range(rounds + 1):
        distance = f"SELECT vec_id, v, k, list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::bigint AS d FROM kept, c{r}"
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, arg_min(k, (d, k)) AS k, min(d) AS d FROM ({distance}) GROUP BY vec_id)")
        if r < rounds:
            sums = f"SELECT k, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM (SELECT k, unnest(v) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY k, i"
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m, c) AS c FROM c{r} LEFT JOIN (SELECT k, list(m::bigint ORDER BY i) AS m FROM ({sums}) GROUP BY k) USING (k))")
    last = f"a{rounds} JOIN c{rounds} USING (k)"
    return ", ".join(parts) + f" SELECT vec_id, k AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::bigint AS cluster_inertia, (sum(d) OVER ())::bigint AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM {last}"


OP13 = _lloyd()

ORACLE_SQL = {"op5_substring_dedup": OP5, "op6_warc_zip": OP6, "op7_vptree_search": OP7, "op9_minhash_near_dedup": OP9, "op10_embedding_near_dedup": OP10, "op11_variant_groups": OP11, "op13_lloyd": OP13}
