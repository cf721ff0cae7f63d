"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from .secrets import BASE_RULES, MORE_RULES

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def secret_sql() -> str:
    """Spans from the lengths of the matches and of the pieces between them."""
    keep = {"assign": "length(regexp_extract(m, '{0}', 2)) >= 6", "access": "length(m) >= 20"}
    parts = []
    for rank, r in enumerate(BASE_RULES + MORE_RULES):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT rid, '{r.kind}' AS kind, {rank} AS rank, b - length(m) AS b, b AS e FROM (SELECT rid, m, sum(length(piece) + length(m)) OVER (PARTITION BY rid ORDER BY i) AS b FROM "
            f"(SELECT rid, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS piece FROM (SELECT rid, regexp_extract_all(text, '{p}') AS ms, string_split_regex(text, '{p}') AS ps FROM d))) "
            f"WHERE {keep.get(r.kind, 'true').format(p)}"
        )
    spans = " UNION ALL ".join(parts)
    told = "coalesce(string_agg(kind || ':' || CAST(b AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY b, rank){0}, '')"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents), s AS ({spans})
        SELECT any_value(doc_id) AS doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
          sha256({told.format(f" FILTER (rank < {len(BASE_RULES)})")}) AS base_sha256, {told.format('')} AS spans FROM d LEFT JOIN s USING (rid) GROUP BY rid"""


QUALITY_SQL = rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
    g AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM d), h AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS c FROM g),
    r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM h WHERE c > 1) GROUP BY rid),
    l AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
    s AS (SELECT doc_id, text, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{{L}}'))) AS bare
      FROM d JOIN l USING (rid) LEFT JOIN r USING (rid)),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
    SELECT doc_id, n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
      NOT (base_failed OR n_symbols > 0.1 * n_words OR word_chars < 2.5 * n_words OR word_chars > 15 * n_words OR (n_dup_lines > 0.3 * n_lines AND n_dup_lines >= 4)
        OR length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) > 0.4 * length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) OR len(regexp_extract_all(text, '!')) > 0.2 * n_words OR bare > 0.3 * n_words
        OR len(regexp_extract_all(text, '(?m)(\.\.\.|…)[ \t]*$')) > 0.3 * n_lines OR len(regexp_extract_all(text, '(?m)^[ \t]*[•‣*-][ \t]')) > 0.9 * n_lines) AS kept FROM b"""


AUDIT_SQL = rf"""
    WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
    l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
    m AS (SELECT d.doc_id, part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text))::INT
        + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)::INT AS mask FROM d),
    h AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
    f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), p AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, 1 << (ascii(filter_order[step]) - 65) AS bit, CAST(coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0) AS INTEGER) AS early
      FROM p, (SELECT unnest(range(1, 6)) AS step)),
    o AS (SELECT part, filter_order, step, bit, CAST(coalesce(sum(n) FILTER (mask & (bit | early) = 0), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (mask & bit > 0 AND mask & early = 0), 0) AS BIGINT) AS removed,
        CAST(coalesce(sum(n) FILTER (mask & bit > 0 AND mask & early > 0), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
        CAST(coalesce(sum(good) FILTER (mask & bit > 0 AND mask & early = 0), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & early = 0), 0) AS BIGINT) AS toxic_lost
      FROM h, s GROUP BY ALL)
    SELECT * EXCLUDE (bit), CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM o"""


def _whole(scale: int) -> str:
    finite = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    return f"SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * x::DOUBLE) AS BIGINT)) AS v FROM embeddings WHERE {finite}"


def cluster_sql(k: int = 16, rounds: int = 3) -> str:
    """Plain Lloyd rounds: every vector against every centroid."""
    parts = [f"v AS MATERIALIZED ({_whole(64)} AND len(embedding) = 64)", f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS m FROM (SELECT v, sha256('1:' || vec_id) AS h FROM v ORDER BY h LIMIT {k}))"]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min(CAST(list_sum(list_transform(range(1, 65), lambda i: (v[i] - m[i]) * (v[i] - m[i]))) AS BIGINT) * {k} + c) AS best FROM v, c{r} GROUP BY vec_id)")
        if r < rounds:
            sums = f"SELECT c, list(x ORDER BY i) AS m FROM (SELECT best % {k} AS c, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS x FROM a{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL) GROUP BY c"
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.m, o.m) AS m FROM c{r} o LEFT JOIN ({sums}) n ON n.c = o.c)")
    return f"""WITH {", ".join(parts)}, l AS (SELECT vec_id, CAST(best % {k} AS INTEGER) AS cluster, best // {k} AS distance FROM a{rounds})
      SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
      FROM l JOIN c{rounds} ON c = cluster"""


TOP_PRODUCTS_SQL = f"""
    WITH v AS MATERIALIZED ({_whole(256)}), s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""
