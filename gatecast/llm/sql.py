"""SQL with the same rows for the queries that plain SQL can express."""

MIX = r"""
WITH sized AS (
    SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sources AS (
    SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
    SELECT source, source_size, source_size * 2.0::DOUBLE AS cap, SUM(source_size) OVER () * 1.5::DOUBLE AS budget,
        CASE (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
    FROM sources
), leveled AS (
    SELECT *, (budget - COALESCE(SUM(cap) OVER filling, 0)) / (SUM(weight) OVER () - COALESCE(SUM(weight) OVER filling, 0)) AS level
    FROM weighed
    WINDOW filling AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), held AS (
    SELECT level AS final FROM leveled WHERE cap > level * weight ORDER BY cap / weight, source NULLS LAST LIMIT 1
), targets AS (
    SELECT source, source_size, CASE WHEN cap <= level * weight THEN cap ELSE final * weight END AS target,
        CAST('0x' || substr(md5('mix|offset|' || CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS shift
    FROM leveled LEFT JOIN held ON TRUE
), ranked AS (
    SELECT doc_id, source, size,
        ROW_NUMBER() OVER (PARTITION BY source ORDER BY size, md5('mix|' || COALESCE(CAST(doc_id AS VARCHAR), 'null'))) AS place
    FROM sized
), passed AS (
    SELECT doc_id, size, source_size, target, shift, place, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS expected
    FROM ranked JOIN targets ON ranked.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target, CAST(floor(place * expected + shift) - floor((place - 1) * expected + shift) AS BIGINT) * size AS taken
FROM passed
"""

EXACT_GROUPS = r"""
WITH bodies AS (
    SELECT doc_id, translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents
)
SELECT doc_id, MAX(doc_id) OVER same AS keep_id, COUNT(*) OVER same AS group_size,
    ROW_NUMBER() OVER (PARTITION BY body ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256
FROM bodies
WINDOW same AS (PARTITION BY body)
"""


def clusters(count: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: str = "1") -> str:
    """Centroids and assignments round by round, each a common table expression."""
    start = f"""
WITH kept AS (
    SELECT ROW_NUMBER() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v
    FROM embeddings
    WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}
), vectors AS MATERIALIZED (
    SELECT n, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM kept
), starts AS (
    SELECT v, ROW_NUMBER() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, v) - 1 AS cluster FROM kept QUALIFY cluster < {count}
), centroids_0 AS MATERIALIZED (
    SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM starts
)"""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""distances_{k} AS (
    SELECT vectors.n, c.cluster, SUM((vectors.x - c.x) * (vectors.x - c.x)) AS distance
    FROM vectors JOIN centroids_{k} c USING (dim) GROUP BY ALL
), nearest_{k} AS MATERIALIZED (
    SELECT n, cluster, distance FROM distances_{k} QUALIFY ROW_NUMBER() OVER (PARTITION BY n ORDER BY distance, cluster) = 1
)""")
        if k < rounds:
            steps.append(f"""means_{k} AS (
    SELECT cluster, dim, floor(SUM(x) / COUNT(*)) AS x FROM vectors JOIN nearest_{k} USING (n) GROUP BY cluster, dim
), centroids_{k + 1} AS MATERIALIZED (
    SELECT c.cluster, dim, COALESCE(m.x, c.x) AS x FROM centroids_{k} c LEFT JOIN means_{k} m USING (cluster, dim)
)""")
    steps.append(f"""digests AS (
    SELECT cluster, sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY dim)) AS centroid_sha256 FROM centroids_{rounds} GROUP BY cluster
)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
    CAST(SUM(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(SUM(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM kept JOIN nearest_{rounds} USING (n) JOIN digests USING (cluster)
""")
    return ", ".join([start, *steps])


CLUSTERS = clusters()

RESAMPLED = r"""
WITH crc_table AS (
    SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
    FROM range(256) r(i)
), texts AS (
    SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
), targets AS (
    SELECT regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM benchmark
), raw_words AS (
    SELECT word, COUNT(*) AS n FROM (SELECT unnest(words) AS word FROM texts) GROUP BY word
), target_words AS (
    SELECT word, COUNT(*) AS n FROM (SELECT unnest(words) AS word FROM targets) GROUP BY word
), vocabulary AS (
    SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM raw_words UNION SELECT word FROM target_words)
), hashed AS MATERIALIZED (
    SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(CAST(length(h) / 2 AS BIGINT)), lambda k: CAST('0x' || substr(h, 2 * k + 1, 2) AS BIGINT))),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
    FROM vocabulary, crc_table
), sizes AS (
    SELECT bucket, SUM(COALESCE(r.n, 0)) AS s, SUM(COALESCE(t.n, 0)) AS t
    FROM hashed LEFT JOIN raw_words r USING (word) LEFT JOIN target_words t USING (word) GROUP BY bucket
), gains AS (
    SELECT bucket, CAST(floor(1000 * ln(((t + 1)::DOUBLE * (SUM(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (SUM(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain FROM sizes
), places AS (
    SELECT ROW_NUMBER() OVER () AS n, doc_id, words FROM texts
), summed AS (
    SELECT n, SUM(gain) AS total FROM (SELECT n, unnest(words) AS word FROM places) JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY n
), weighed AS (
    SELECT n, doc_id, len(words) AS n_features, CASE WHEN len(words) = 0 THEN 0 ELSE CAST(floor(total / len(words)) AS BIGINT) END AS weight,
        (CAST('0x' || substr(sha256('2024:' || COALESCE(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u
    FROM places LEFT JOIN summed USING (n)
), scored AS (
    SELECT *, weight + CAST(floor(-1000.0::DOUBLE * ln(-ln(u))) AS BIGINT) AS score FROM weighed
), placed AS (
    SELECT n, ROW_NUMBER() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, COUNT(*) OVER () AS able FROM scored WHERE n_features >= 20
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
    CASE WHEN place <= floor(10 * able / 100) THEN place END AS rank
FROM scored LEFT JOIN placed USING (n)
"""
