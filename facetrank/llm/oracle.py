"""DuckDB equivalents of the operators that SQL can express."""

from __future__ import annotations

from facetrank.llm.quality import MAX_HOST_RATE
from facetrank.llm.secrets import BASE_RULES, RULES

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
twice AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
cover AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(0, 8) t(k) GROUP BY r),
m AS (SELECT d.r, doc_id, host, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN cover USING (r)),
f AS (SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT host, count(*) AS n, sum(base_failed::INT) AS bad FROM f GROUP BY host),
mo AS (SELECT least(greatest(avg(bad / n), 1e-6), 1 - 1e-6) AS mean, var_samp(bad / n) AS v FROM h),
pr AS (SELECT mean, least(greatest(CASE WHEN v > 1e-12 THEN mean * (1 - mean) / v - 1 ELSE 2 END, 0.5), 1e6) AS wt FROM mo),
verdict AS (SELECT host, (bad + mean * wt) / (n + wt) <= {MAX_HOST_RATE} AS ok FROM h, pr)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept FROM f JOIN verdict USING (host)"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, c.e) DESC, c.vec_id) AS rank
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id) WHERE rank <= 5"""

NEAR = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), least(len(w), 1) + 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sized AS (SELECT s.doc_id, g, n FROM s JOIN n USING (doc_id)),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM sized a JOIN sized b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edge AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, y FROM edge UNION SELECT reach.x, edge.y FROM reach JOIN edge ON reach.y = edge.x),
least_of AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(l.y, d.doc_id), d.doc_id) AS component_id, coalesce(least(l.y, d.doc_id), d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_of l ON l.x = d.doc_id"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secrets() -> str:
    parts = []
    for i, r in enumerate(RULES):
        p = _quoted(r.pattern)
        parts.append(
            f"SELECT r, {i} AS kind, '{r.kind}' AS name, list_sum(list_transform(b[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS a, length(m[k]) AS size "
            f"FROM (SELECT r, string_split_regex(text, {p}) AS b, regexp_extract_all(text, {p}) AS m, regexp_extract_all(text, {p}, {r.group}) AS g, unnest(range(1, len(regexp_extract_all(text, {p})) + 1)) AS k FROM d) WHERE length(g[k]) >= {r.least}"
        )
    counts = ", ".join(f"count(s.r) FILTER (kind = {i}) AS n_{r.kind}" for i, r in enumerate(BASE_RULES))
    item = "s.name || ':' || a::BIGINT || ':' || (a + size)::BIGINT"
    joined = f"coalesce(string_agg({item}, ',' ORDER BY a, kind), '')"
    return (
        f"WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), s AS ({' UNION ALL '.join(parts)}) "
        f"SELECT doc_id, {counts}, sha256(coalesce(string_agg({item}, ',' ORDER BY a, kind) FILTER (kind < {len(BASE_RULES)}), '')) AS base_sha256, {joined} AS spans FROM d LEFT JOIN s USING (r) GROUP BY d.r, doc_id"
    )


ORACLE: dict[str, str] = {"op1_secret_scan": _secrets(), "op7_minhash_near_dedup": NEAR, "op8_exact_top_k": TOP_K, "op9_quality_rules": QUALITY}
