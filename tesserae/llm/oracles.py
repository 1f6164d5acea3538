"""SQL (DuckDB) for the rows of those queries that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM d),
s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS k, w FROM d WHERE len(w) >= 20),
h AS (SELECT doc_id, k, md5(array_to_string(w[k : k + 19], ' ')) AS h FROM s),
f AS (SELECT h, min((doc_id, k)) AS first FROM h GROUP BY h HAVING count(*) > 1),
r AS (SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS k FROM h JOIN f USING (h) WHERE (doc_id, k) > first)
SELECT d.doc_id, any_value(len(w)) AS n_words, count(r.k) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY p.k) FILTER (r.k IS NULL), '')) AS kept_sha256
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN r ON p.doc_id = r.doc_id AND p.k = r.k GROUP BY d.doc_id
"""

OP10 = rf"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents), i AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
w AS (SELECT DISTINCT item_id, n, w[k : k + n - 1] AS s FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
c AS (SELECT doc_id, k, n, w[k : k + n - 1] AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM w) WHERE len(w) >= n)),
h AS (SELECT doc_id, k, n, item_id FROM c JOIN w USING (n, s)),
x AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS k FROM h) GROUP BY 1),
y AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)
"""

_VALID = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _squares(n: int) -> str:
    """Squared distance of lists x and c of n integers."""
    return " + ".join(f"(x[{i}] - c[{i}]) * (x[{i}] - c[{i}])" for i in range(1, n + 1))


def _codes(rounds: int = 2) -> str:
    """Vectors of 64 components in 16 parts; a distance and its entry's index as one number, distance * 64 + index."""
    floor = "CAST((sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x) AS BIGINT)) AS e FROM embeddings WHERE {_VALID})",
        "p AS MATERIALIZED (SELECT vec_id, label, part, e[part * 4 + 1 : part * 4 + 4] AS x FROM v, (SELECT unnest(range(16)) AS part))",
        "b0 AS MATERIALIZED (SELECT part, n AS entry, x AS c FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS n FROM p) WHERE n < 64)",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, label, part, x, min(({_squares(4)}) * 64 + entry) AS m FROM p JOIN b{r} USING (part) GROUP BY ALL)")
        if r < rounds:
            steps.append(f"s{r} AS MATERIALIZED (SELECT part, entry, list(f ORDER BY i) AS c FROM (SELECT part, m % 64 AS entry, i, {floor} AS f FROM (SELECT part, m, unnest(x) AS y, unnest(range(4)) AS i FROM a{r}) GROUP BY ALL) GROUP BY ALL)")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(s{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN s{r} USING (part, entry))")
    return f"""
WITH {", ".join(steps)},
f AS (SELECT vec_id, label, string_agg(printf('%02x', m % 64), '' ORDER BY part) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM a{rounds} GROUP BY ALL),
d AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM f, d
"""


def _centroids(rounds: int = 10) -> str:
    """A distance and its centroid's number as one number, distance * 8 + number."""
    floor = "CAST((sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE {_VALID} AND len(embedding) = 64)",
        "c0 AS MATERIALIZED (SELECT n AS number, x AS c FROM (SELECT x, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS n FROM v) WHERE n < 8)",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, x, min(({_squares(64)}) * 8 + number) AS m FROM v, c{r} GROUP BY ALL)")
        if r < rounds:
            steps.append(f"s{r} AS MATERIALIZED (SELECT number, list(f ORDER BY i) AS c FROM (SELECT m % 8 AS number, i, {floor} AS f FROM (SELECT m, unnest(x) AS y, unnest(range(64)) AS i FROM a{r}) GROUP BY ALL) GROUP BY ALL)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT number, coalesce(s{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN s{r} USING (number))")
    return f"""
WITH {", ".join(steps)},
f AS (SELECT vec_id, CAST(m % 8 AS INTEGER) AS cluster, m // 8 AS distance FROM a{rounds})
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(c, ',')) AS centroid_sha256 FROM f JOIN c{rounds} ON cluster = number
"""


OP13 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

ORACLES = {"op4_substring_dedup": OP4, "op10_decontamination": OP10, "op11_vector_codes": _codes(), "op12_centroids": _centroids(), "op13_exact_dedup": OP13}
