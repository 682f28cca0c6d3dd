"""DuckDB equivalents of the queries, from shared common table expressions."""

from __future__ import annotations

PARTS = {
    "x": "SELECT vec_id, label, i - 1 AS pos, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i)",
    "c": "SELECT pos, avg(v) AS c FROM x GROUP BY pos",
    "r": "SELECT x.vec_id, x.label, x.pos, x.v - c.c AS r FROM x JOIN c USING (pos)",
    "codes": """SELECT vec_id, label,
        sum(CASE WHEN r > 0 AND pos < 32 THEN 1::BIGINT << pos ELSE 0 END)::BIGINT AS w0,
        sum(CASE WHEN r > 0 AND pos >= 32 THEN 1::BIGINT << (pos - 32) ELSE 0 END)::BIGINT AS w1,
        sum(CASE WHEN r > 0 THEN 1 ELSE 0 END)::BIGINT AS pop,
        coalesce(avg(r) FILTER (r <= 0), 0) AS lo, coalesce(avg(r) FILTER (r > 0), 0) AS hi
        FROM r GROUP BY vec_id, label""",
    "k": "SELECT k FROM range(0, 10) t(k)",
    "h": """SELECT k, pos, avg(v) FILTER (label = k) AS a, avg(v) FILTER (label <> k) AS b FROM x, k GROUP BY k, pos""",
    "head": "SELECT k, pos, a - b AS w, c.c AS c, -(sum((a - b) * (a + b)) OVER (PARTITION BY k)) / 2 AS b0 FROM h JOIN c USING (pos)",
    "scale": "SELECT k, min(w) AS low, greatest(max(w) - min(w), 1e-12) / 15 AS step FROM head GROUP BY k",
    "q4": """SELECT k, pos, c, b0, low, step, least(greatest(round_even((w - low) / step, 0), 0), 15)::BIGINT AS q FROM head JOIN scale USING (k)""",
    "prog": """SELECT k, min(low) AS low, min(step) AS step, min(b0) + sum(c * (low + step * q)) AS base, sum(low + step * q) AS sum_w FROM q4 GROUP BY k""",
    "planes": """SELECT k, t AS plane,
        sum(CASE WHEN pos < 32 THEN ((q >> t) & 1) << pos ELSE 0 END)::BIGINT AS m0,
        sum(CASE WHEN pos >= 32 THEN ((q >> t) & 1) << (pos - 32) ELSE 0 END)::BIGINT AS m1
        FROM q4, range(0, 4) p(t) GROUP BY k, t""",
    "hits": """SELECT vec_id, planes.k, sum((bit_count(w0 & m0)::BIGINT + bit_count(w1 & m1)::BIGINT) << plane)::DOUBLE AS hits
        FROM codes, planes GROUP BY vec_id, planes.k""",
    "raw": """SELECT vec_id, label, k, base + lo * (sum_w - (low * pop + step * hits)) + hi * (low * pop + step * hits) AS s
        FROM hits JOIN codes USING (vec_id) JOIN prog USING (k)""",
    "pair": "SELECT a.vec_id, a.s AS s3, b.s AS s7 FROM raw a JOIN raw b USING (vec_id) WHERE a.k = 3 AND b.k = 7",
    "sem": """SELECT vec_id, (least(s3, 0) - ln(1 + exp(-abs(s3))) + least(-s7, 0) - ln(1 + exp(-abs(s7)))) / 2 AS semantic FROM pair""",
    "dense": """SELECT q.vec_id AS query_id, i.vec_id, i.label,
        list_dot_product(i.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS dense FROM embeddings i, embeddings q WHERE q.vec_id % 20 = 0""",
    "facets": """SELECT e.vec_id, e.embedding, coalesce(p.p_brand, 'Unknown') AS brand, coalesce(p.p_type, 'Unknown') AS type,
        coalesce(p.p_size::VARCHAR, 'Unknown') AS size FROM embeddings e LEFT JOIN part p ON e.vec_id = p.p_partkey""",
    "edges": "SELECT pos, quantile_cont(v, [0.25, 0.5, 0.75]) AS e FROM x GROUP BY pos",
    "q2": "SELECT vec_id, label, x.pos, v, len(list_filter(e, lambda z: z <= v))::INTEGER AS code FROM x JOIN edges USING (pos)",
    "hist": """SELECT g.coord::INTEGER AS coord, g.bin::INTEGER AS bin, coalesce(sum((label = 3)::BIGINT), 0)::BIGINT AS p,
        coalesce(sum((label <> 3)::BIGINT), 0)::BIGINT AS n
        FROM (SELECT coord, bin FROM range(0, 64) a(coord), range(0, 4) b(bin)) g LEFT JOIN q2 ON q2.pos = g.coord AND q2.code = g.bin GROUP BY ALL""",
    "tot": "SELECT coord, bin, p, n, p + n AS m, sum(p) OVER w AS n1, sum(n) OVER w AS n0 FROM hist WINDOW w AS (PARTITION BY coord)",
    "prior": "SELECT ln(((sum((label = 3)::INT) + 0.5) / (count(*) + 1)) / (1 - (sum((label = 3)::INT) + 0.5) / (count(*) + 1))) AS z FROM embeddings",
    "pool": """SELECT d.query_id, d.vec_id, d.label, d.dense, e.label AS want FROM dense d JOIN embeddings e ON e.vec_id = d.query_id
        WHERE d.vec_id <> d.query_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, d.vec_id) <= 200""",
    "linear": "SELECT vec_id, k, sum(v * w) + min(b0) AS s FROM x JOIN head USING (pos) GROUP BY vec_id, k",
    "scored": """SELECT 'dense' AS method, query_id, vec_id, round(dense, 9) AS s, (label = want)::INT AS t FROM pool
        UNION ALL SELECT 'oracle', query_id, vec_id, (label = want)::DOUBLE, (label = want)::INT FROM pool
        UNION ALL SELECT 'linear', query_id, pool.vec_id, round(l.s, 9), (label = want)::INT FROM pool JOIN linear l ON l.vec_id = pool.vec_id AND l.k = want
        UNION ALL SELECT 'program', query_id, pool.vec_id, round(l.s, 9), (pool.label = want)::INT FROM pool JOIN raw l ON l.vec_id = pool.vec_id AND l.k = want""",
    "ranks": """SELECT method, query_id, t, row_number() OVER (PARTITION BY method, query_id ORDER BY s DESC, vec_id) AS r,
        count(*) OVER (PARTITION BY method, query_id) AS pool_size FROM scored""",
    "per_query": """SELECT *, hits::DOUBLE / nullif(total_true, 0) AS recall, hits::DOUBLE / nullif(k, 0) AS purity,
        least(k, total_true)::DOUBLE / nullif(total_true, 0) AS max_recall,
        (hits::DOUBLE / nullif(total_true, 0)) / nullif(least(k, total_true)::DOUBLE / nullif(total_true, 0), 0) AS recall_efficiency FROM (
        SELECT method, query_id, f AS retention, max(pool_size) AS pool_size, max(greatest(1, least(pool_size, round_even(pool_size * f, 0)::BIGINT))) AS k,
        sum(CASE WHEN r <= greatest(1, least(pool_size, round_even(pool_size * f, 0)::BIGINT)) THEN t ELSE 0 END)::BIGINT AS hits, sum(t)::BIGINT AS total_true
        FROM ranks, (SELECT unnest([0.05, 0.1, 0.2, 0.4]::DOUBLE[]) AS f) GROUP BY method, query_id, f)""",
    "y3": "SELECT vec_id, round(s, 6) AS score, (label = 3)::INT AS y FROM raw WHERE k = 3",
    "curve": """SELECT score AS threshold, p, sum(p) OVER w AS tp, sum(n) OVER w AS n, sum(p) OVER () AS total
        FROM (SELECT score, sum(y) AS p, count(*) AS n FROM y3 GROUP BY score) WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)""",
    "gates": "SELECT quantile_cont(semantic, [0.5, 0.8, 0.9]) AS g FROM sem",
    "ds": "SELECT dense.*, semantic FROM dense JOIN sem USING (vec_id)",
    "truth": """SELECT query_id, vec_id, dense, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, vec_id) AS rank FROM ds, gates
        WHERE semantic >= g[2] AND vec_id <> query_id QUALIFY rank <= 10""",
    "fetched": """SELECT multiplier, query_id, vec_id FROM (SELECT m AS multiplier, query_id, vec_id, dense, semantic FROM ds, (SELECT unnest([0.5, 1.0, 2.0]::DOUBLE[]) AS m),
        (SELECT count(*) AS n_all FROM embeddings)
        QUALIFY row_number() OVER (PARTITION BY m, query_id ORDER BY dense DESC, vec_id) <= least(greatest(ceil(m * 10 / 0.2), 10), greatest(n_all - 1, 10))), gates
        WHERE semantic >= g[2] AND vec_id <> query_id QUALIFY row_number() OVER (PARTITION BY multiplier, query_id ORDER BY dense DESC, vec_id) <= 10""",
    "book": "SELECT vec_id AS j, label, pos, v FROM x WHERE vec_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 8)",
    "slots": "SELECT j, row_number() OVER (ORDER BY j) - 1 AS code FROM (SELECT DISTINCT j FROM book)",
    "pq": """SELECT vec_id, part, arg_min(code, (round(d, 12), code))::INTEGER AS code FROM (SELECT x.vec_id, (x.pos // 4)::INTEGER AS part, slots.code,
        sum((x.v - book.v) * (x.v - book.v)) AS d FROM x JOIN book USING (pos) JOIN slots USING (j) GROUP BY ALL) GROUP BY vec_id, part""",
    "signs": "SELECT vec_id, label, pos::INTEGER AS pos, (v >= 0)::INTEGER AS bit FROM x",
}


def needs(sql: str) -> list[str]:
    import re

    return [n for n in PARTS if re.search(rf"\b(FROM|JOIN|,)\s+{n}\b", sql)]


def with_parts(sql: str) -> str:
    """The query with the table expressions that it needs, in order."""
    found: set[str] = set()
    todo = needs(sql)
    while todo:
        n = todo.pop()
        if n not in found:
            found.add(n)
            todo += needs(PARTS[n])
    parts = [f"{n} AS ({PARTS[n]})" for n in PARTS if n in found]
    return f"WITH {', '.join(parts)} {sql}" if parts else sql


def r6(x: str, name: str | None = None) -> str:
    return f"round({x}, 6) + 0.0 AS {name or x}"


def lsig(z: str) -> str:
    return f"(least({z}, 0) - ln(1 + exp(-abs({z}))))"


LLR = """SELECT coord, bin, {llr}, {strength}, {mi} FROM (
    SELECT coord, bin, llr, sum((p1 - p0) * llr) OVER w AS strength,
    sum(p1 * ln(2 * p1 / (p1 + p0)) + p0 * ln(2 * p0 / (p1 + p0))) OVER w / 2 AS mi FROM (
    SELECT *, ln(p1 / p0) AS llr FROM ({smooth})) WINDOW w AS (PARTITION BY coord))"""
LAPLACE = "SELECT coord, bin, m::DOUBLE AS m, n1::DOUBLE AS n1, n0::DOUBLE AS n0, (p + 1.0::DOUBLE) / (n1 + 4) AS p1, (n + 1.0::DOUBLE) / (n0 + 4) AS p0 FROM tot"
BAYES = """SELECT coord, bin, m::DOUBLE AS m, n1::DOUBLE AS n1, n0::DOUBLE AS n0, (p + 16 * (m + 1.0::DOUBLE) / (n1 + n0 + 4)) / (n1 + 16) AS p1,
    (n + 16 * (m + 1.0::DOUBLE) / (n1 + n0 + 4)) / (n0 + 16) AS p0 FROM tot"""


def _llr(smooth: str) -> str:
    return LLR.format(smooth=smooth, llr=r6("llr"), strength=r6("strength"), mi=r6("mi"))


RAW_WIDE = "SELECT vec_id, " + ", ".join(f"max(s) FILTER (k = {k}) AS l{k}" for k in range(10)) + " FROM raw GROUP BY vec_id"
BYTES = " || ".join(f"lpad(to_hex((w{b // 4} >> {b % 4 * 8}) & 255), 2, '0')" for b in range(8))

SQL: dict[str, str] = {
    "encoder_centroid": f"SELECT pos::INTEGER AS pos, {r6('c', 'centroid')} FROM c",
    "item_codes": f"SELECT vec_id, w0, w1, pop, {r6('lo')}, {r6('hi')} FROM codes",
    "stream_encode": f"SELECT vec_id, w0, w1, pop, {r6('lo')}, {r6('hi')} FROM codes",
    "packed_codes": f"SELECT vec_id, lower({BYTES}) AS bits FROM codes",
    "norm_check": f"SELECT count(*) AS n_items, {r6('min(n)', 'min_norm')}, {r6('avg(n)', 'mean_norm')}, {r6('max(n)', 'max_norm')}, {r6('max(abs(n - 1))', 'max_error')} FROM (SELECT vec_id, sqrt(sum(v * v)) AS n FROM x GROUP BY vec_id)",
    "normalised": f"SELECT vec_id, pos::INTEGER AS pos, {r6('v / greatest(sqrt(sum(v * v) OVER (PARTITION BY vec_id)), 1e-12)', 'x')} FROM x",
    "sign_codes": "SELECT vec_id, pos, bit FROM signs",
    "centroid_head": f"SELECT 'label' || k AS concept, pos::INTEGER AS pos, {r6('w')}, {r6('b0', 'intercept')} FROM head",
    "program_int4": f"SELECT 'label' || k AS concept, pos::INTEGER AS pos, q::INTEGER AS q, {r6('low + step * q', 'decoded')} FROM q4",
    "program_planes": "SELECT 'label' || k AS concept, plane::INTEGER AS plane, m0, m1 FROM planes",
    "program_scalars": f"SELECT 'label' || k AS concept, {r6('low', 'weight_lo')}, {r6('step', 'weight_scale')}, {r6('base')}, {r6('sum_w')} FROM prog",
    "raw_score": f"SELECT vec_id, {r6('s3', 'label3')}, {r6('s7', 'label7')} FROM pair",
    "fused_scores": f"SELECT vec_id, {', '.join(r6(f'l{k}', f'label{k}') for k in range(10))} FROM ({RAW_WIDE})",
    "exact_linear": f"SELECT vec_id, {', '.join(r6(f'max(s) FILTER (k = {k})', f'label{k}') for k in range(4))} FROM linear GROUP BY vec_id",
    "signed_logprob": f"SELECT vec_id, {r6('semantic * 2', 'score')} FROM sem",
    "mean_logprob": f"SELECT vec_id, {r6('semantic', 'score')} FROM sem",
    "softmin": f"SELECT vec_id, {r6('-0.5 * ln(exp(-s3 / 0.5) + exp(-s7 / 0.5)) + 0.5 * ln(2)', 'score')} FROM pair",
    "composition_rules": f"SELECT vec_id, {r6('least(s3, s7)', 'min_logit')}, {r6('s3 + s7', 'sum_logit')}, {r6('1 / (1 + exp(-s3))', 'p3')}, {r6('s3', 'logit3')} FROM pair",
    "zero_shot": f"SELECT vec_id, {r6('sum(v * d) / sqrt(sum(d * d))', 'score')} FROM x JOIN (SELECT pos, avg(v) FILTER (label = 3) - avg(v) FILTER (label = 7) AS d FROM x GROUP BY pos) USING (pos) GROUP BY vec_id",
    "semantic_topk": f"SELECT vec_id, {r6('semantic * 2', 'score')} FROM sem ORDER BY semantic DESC, vec_id LIMIT 20",
    "early_exit_topk": f"SELECT vec_id, {r6('semantic * 2', 'score')} FROM sem ORDER BY semantic DESC, vec_id LIMIT 20",
    "semantic_topk_negated": f"SELECT vec_id, {r6('score')} FROM (SELECT vec_id, {lsig('-l7')} + {lsig('-l2')} AS score FROM ({RAW_WIDE})) ORDER BY score DESC, vec_id LIMIT 20",
    "dense_topk": f"SELECT query_id, rank::INTEGER AS rank, vec_id, {r6('dense')} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, vec_id) AS rank FROM dense WHERE vec_id <> query_id) WHERE rank <= 10",
    "dense_pool_exact_filter": f"SELECT vec_id, (row_number() OVER (ORDER BY dense DESC, vec_id))::INTEGER AS rank, {r6('dense')} FROM (SELECT vec_id, dense FROM dense WHERE query_id = 0 AND vec_id <> 0 ORDER BY dense DESC, vec_id LIMIT 200) JOIN facets USING (vec_id) WHERE type = 'STANDARD' ORDER BY dense DESC, vec_id LIMIT 20",
    "facet_counts": "SELECT brand, type, count(*) AS n FROM facets GROUP BY brand, type",
    "gate_table": f"SELECT (i - 1)::INTEGER AS gate_index, f AS fraction, {r6('g', 'gate')}, n AS eligible, {r6('n / n_all', 'eligible_fraction')} FROM (SELECT i, f, g, n_all, (SELECT count(*) FROM sem WHERE semantic >= g) AS n FROM (SELECT i, ([0.5, 0.2, 0.1, 0.05, 0.001]::DOUBLE[])[i] AS f, (SELECT quantile_cont(semantic, [0.5, 0.8, 0.9, 0.95, 0.999]) FROM sem)[i] AS g, (SELECT count(*) FROM sem) AS n_all FROM range(1, 6) t(i)) WHERE f * n_all >= 11)",
    "gated_truth_topk": f"SELECT query_id, rank::INTEGER AS rank, vec_id, {r6('dense')} FROM truth",
    "overfetch_recall": f"SELECT query_id, multiplier, hits, n_truth, {r6('CASE WHEN n_truth = 0 THEN 1 ELSE hits / n_truth END', 'recall')} FROM (SELECT q AS query_id, m AS multiplier, (SELECT count(*) FROM fetched f JOIN truth t ON f.query_id = t.query_id AND f.vec_id = t.vec_id WHERE f.query_id = q AND f.multiplier = m) AS hits, (SELECT count(*) FROM truth t WHERE t.query_id = q) AS n_truth FROM (SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0) a(q), (SELECT unnest([0.5, 1.0, 2.0]::DOUBLE[]) AS m))",
    "uniform_codes": "SELECT vec_id, x.pos::INTEGER AS pos, round_even((least(greatest(v, q[1]), q[2]) - q[1]) / greatest(q[2] - q[1], 1e-12) * 15, 0)::INTEGER AS code FROM x JOIN (SELECT pos, quantile_cont(v, [0.005, 0.995]) AS q FROM x GROUP BY pos) USING (pos)",
    "quantile_codes": "SELECT vec_id, pos::INTEGER AS pos, code FROM q2",
    "packed_small_codes": "SELECT vec_id, pos::INTEGER AS pos, code FROM q2",
    "columnar_codes": "SELECT pos::INTEGER AS coord, sum(code)::BIGINT AS total, count(*) FILTER (code = 3) AS n_top FROM q2 GROUP BY pos",
    "bin_centroids": f"SELECT g.coord::INTEGER AS coord, g.bin::INTEGER AS bin, {r6('coalesce(avg(v), min(mean))', 'centroid')} FROM (SELECT coord, bin, (SELECT avg(v) FROM x WHERE pos = coord) AS mean FROM range(0, 64) a(coord), range(0, 4) b(bin)) g LEFT JOIN q2 ON q2.pos = coord AND q2.code = bin GROUP BY ALL",
    "pq_codes": "SELECT vec_id, part, code FROM pq",
    "pq_adc": f"SELECT vec_id, {r6('sum(v * w) + min(b0)', 'score')} FROM pq JOIN slots USING (code) JOIN book ON book.j = slots.j AND book.pos // 4 = part JOIN head ON head.pos = book.pos AND head.k = 3 GROUP BY vec_id",
    "code_histograms": "SELECT coord, bin, p AS pos, n AS neg FROM hist",
    "llr_stats": _llr(LAPLACE),
    "llr_empirical_bayes": _llr(BAYES),
    "llr_program_score": f"SELECT vec_id, {r6('sum(llr) + min(z)', 'score')} FROM q2 JOIN (SELECT * FROM ({LLR.format(smooth=LAPLACE, llr='llr', strength='strength', mi='mi')}) WHERE coord IN (SELECT coord FROM (SELECT DISTINCT coord, strength FROM ({LLR.format(smooth=LAPLACE, llr='llr', strength='strength', mi='mi')})) ORDER BY strength DESC, coord LIMIT 12)) s ON s.coord = q2.pos AND s.bin = q2.code, prior GROUP BY vec_id",
    "newton_round1": f"SELECT coord, bin, {r6('g / (h + 6)', 'step')}, {r6('sum(g * g / (h + 6)) OVER (PARTITION BY coord) / 2', 'gain')} FROM (SELECT pos::INTEGER AS coord, code AS bin, sum((label = 3)::INT - 1 / (1 + exp(-z))) AS g, sum(1 / (1 + exp(-z)) * (1 - 1 / (1 + exp(-z)))) AS h FROM q2, prior GROUP BY pos, code)",
    "box_predicate": f"SELECT vec_id, {r6('avg((code BETWEEN b[1] AND b[2])::INT)', 'inside')} FROM q2 JOIN (SELECT pos, quantile_cont(code, [0.1, 0.9]) AS b FROM q2 WHERE label = 3 GROUP BY pos) USING (pos) GROUP BY vec_id",
    "bitmask_predicate": f"SELECT vec_id, {r6('avg((bit = polarity)::INT)', 'agree')} FROM signs JOIN (SELECT pos, (d > 0)::INT AS polarity FROM (SELECT pos, avg(bit) FILTER (label = 3) - avg(bit) FILTER (label <> 3) AS d FROM signs GROUP BY pos) ORDER BY round(abs(d), 9) DESC, pos LIMIT 16) USING (pos) GROUP BY vec_id",
    "ranking_stats_by_retention": f"SELECT method, query_id, retention, pool_size, k, hits, total_true, {', '.join(map(r6, ('recall', 'purity', 'max_recall', 'recall_efficiency')))} FROM per_query",
    "group_summary": f"SELECT method, retention, count(recall) AS n, {r6('avg(recall)', 'mean')}, {r6('stddev_samp(recall)', 'sd')}, {r6('median(recall)', 'median')}, {r6('quantile_cont(recall, 0.95)', 'p95')} FROM per_query GROUP BY method, retention",
    "pivot_methods": "SELECT query_id, retention, " + ", ".join(r6(f"max(recall) FILTER (method = '{m}')", m) for m in ("dense", "linear", "oracle", "program")) + " FROM per_query GROUP BY query_id, retention",
    "paired_delta": f"SELECT a.query_id, a.retention, a.method, {r6('a.recall - b.recall', 'delta')} FROM per_query a JOIN per_query b USING (query_id, retention) WHERE b.method = 'dense' AND a.method <> 'dense' AND a.recall IS NOT NULL AND b.recall IS NOT NULL",
    "prevalence_depth": f"SELECT quartile::INTEGER AS quartile, 1 AS depth, count(delta) AS n, {r6('avg(delta)', 'mean')}, {r6('stddev_samp(delta)', 'sd')} FROM (SELECT p.delta, len(list_filter(list_distinct(q), lambda e: p.prevalence > e)) AS quartile FROM (SELECT a.recall - b.recall AS delta, a.total_true / a.pool_size AS prevalence FROM per_query a JOIN per_query b USING (query_id, retention) WHERE retention = 0.2 AND a.method = 'program' AND b.method = 'dense') p, (SELECT quantile_cont(total_true / pool_size, [0.25, 0.5, 0.75]) AS q FROM per_query WHERE retention = 0.2 AND method = 'dense')) GROUP BY quartile",
    "best_f1_threshold": f"SELECT {r6('threshold')}, {r6('2 * tp / (n + total)', 'f1')} FROM curve ORDER BY tp / (n + total) DESC, threshold LIMIT 1",
    "f1_at_zero": f"SELECT tp, n, total, {r6('2 * tp / (n + total)', 'f1')} FROM (SELECT count(*) FILTER (score >= 0 AND y = 1) AS tp, count(*) FILTER (score >= 0) AS n, count(*) FILTER (y = 1) AS total FROM y3)",
    "average_precision": f"SELECT {r6('sum(p * tp / n) / max(total)', 'average_precision')} FROM curve",
    "latency_stats": f"SELECT event_type, max(n) AS n, {r6('max(v) FILTER (r = n // 2 + 1)', 'median')}, {r6('max(v) FILTER (r = greatest(1, ceil(n * 0.95::DOUBLE)))', 'p95')} FROM (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) GROUP BY event_type",
    "exact_filter_candidates": "SELECT * FROM (" + " UNION ALL ".join([f"SELECT '{f}' AS field1, {f} AS value1, NULL::VARCHAR AS field2, NULL::VARCHAR AS value2, count(*) AS n FROM facets WHERE {f} <> 'Unknown' GROUP BY {f}" for f in ("brand", "type", "size")] + [f"SELECT '{a}', {a}, '{b}', {b}, count(*) FROM facets WHERE {a} <> 'Unknown' AND {b} <> 'Unknown' GROUP BY {a}, {b}" for a, b in (("brand", "type"), ("type", "size"))]) + ") WHERE n >= 20",
    "split_strict": "SELECT split, count(*) AS n FROM (SELECT CASE WHEN r <= t THEN 'test' WHEN r <= t + ceil((n - t) * 0.2::DOUBLE) THEN 'cal' ELSE 'fit' END AS split FROM (SELECT row_number() OVER () AS r, count(*) OVER () AS n, ceil(count(*) OVER () * 0.35::DOUBLE) AS t FROM embeddings)) GROUP BY split",
    "split_stratified": "SELECT label, split, count(*) AS n FROM (SELECT label, CASE WHEN row_number() OVER (PARTITION BY label) <= ceil(count(*) OVER (PARTITION BY label) * 0.8::DOUBLE) THEN 'fit' ELSE 'cal' END AS split FROM embeddings) GROUP BY label, split",
    "concept_counts": "SELECT label, count(*) AS n, (row_number() OVER (ORDER BY count(*) DESC, label))::INTEGER AS rank FROM embeddings GROUP BY label",
    "truth_mask": "SELECT doc_id FROM labels WHERE quality = 1 AND NOT toxic = 1",
    "storage": "SELECT method, item_bytes, program_bytes, shared_bytes, 5000000 * item_bytes + 100000 * program_bytes + shared_bytes AS total_bytes, round((5000000 * item_bytes + 100000 * program_bytes + shared_bytes) / 1e6, 6) + 0.0 AS total_mb FROM (VALUES ('binary1_ls2_int4', 56::BIGINT, 216::BIGINT, 0::BIGINT), ('pq64_linear', 64, 1548, 393216), ('lut_2bit', 96, 580, 0), ('lut_4bit', 192, 3652, 0), ('fp32_linear', 1536, 1548, 0), ('dense', 1536, 0, 0)) t(method, item_bytes, program_bytes, shared_bytes)",
    "set_operations": "SELECT kind, vec_id FROM (WITH t AS (SELECT query_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, vec_id) AS rank FROM dense WHERE query_id IN (0, 20)) WHERE rank <= 100), a AS (SELECT vec_id FROM t WHERE query_id = 0), b AS (SELECT vec_id FROM t WHERE query_id = 20) SELECT 'union_all' AS kind, vec_id FROM (SELECT * FROM a UNION ALL SELECT * FROM b) UNION ALL SELECT 'union', vec_id FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', vec_id FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', vec_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b))",
    "result_parity": "SELECT q AS query_id, TRUE AS same FROM (SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0) t(q)",
    "query_mentions": "SELECT doc_id, regexp_matches(lower(text), '(^|[^a-z0-9])the([^a-z0-9]|$)') AS has_the, regexp_matches(lower(text), '(^|[^a-z0-9])de la([^a-z0-9]|$)') AS has_de_la FROM documents",
    "event_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "event_sessions": "SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s",
}

ORACLE = {name: with_parts(sql) for name, sql in SQL.items()}

ORACLE["label_threshold"] = with_parts("SELECT query_id, vec_id, (dense >= quantile_cont(dense, 0.6) OVER (PARTITION BY query_id))::INTEGER AS label FROM dense")

PLACES = "(SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS ordinal, count(*) OVER () AS n_all FROM embeddings)"
ORACLE["geometry_corr"] = with_parts(
    f"SELECT count(*) AS n, {r6('corr(d, h)', 'corr')} FROM (SELECT list_dot_product(ea.embedding::DOUBLE[], eb.embedding::DOUBLE[]) AS d, 1 - (bit_count(xor(a.w0, b.w0))::BIGINT + bit_count(xor(a.w1, b.w1))::BIGINT) / 64 AS h FROM (SELECT t.i % n_all AS i, ((t.i * 48271 + 11) % 2147483647) * ((t.i * 48271 + 11) % 2147483647) % 2147483647 % n_all AS j FROM (SELECT count(*) AS n_all, unnest(range(greatest(20000, count(*)))) AS i FROM embeddings) t) p JOIN {PLACES} pa ON pa.ordinal = p.i JOIN {PLACES} pb ON pb.ordinal = p.j JOIN codes a ON a.vec_id = pa.vec_id JOIN codes b ON b.vec_id = pb.vec_id JOIN embeddings ea ON ea.vec_id = pa.vec_id JOIN embeddings eb ON eb.vec_id = pb.vec_id WHERE p.i <> p.j)"
)
ORACLE["candidate_scores"] = with_parts(f"SELECT i AS pos, vec_id, {r6(lsig('l1') + ' + ' + lsig('l2'), 'score')} FROM {PLACES} JOIN (SELECT unnest(range(3 * count(*))) AS i FROM embeddings) ON ordinal = i % n_all JOIN ({RAW_WIDE}) USING (vec_id)")
ORACLE["tiled_codes"] = with_parts(f"SELECT i AS tile_id, vec_id, w0, pop FROM {PLACES} JOIN (SELECT unnest(range(count(*) * 13 // 5)) AS i FROM embeddings) ON ordinal = i % n_all JOIN codes USING (vec_id)")

KNN = "(SELECT a.vec_id AS src, b.vec_id AS dst FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) <= {m})"
BOTH = "SELECT src, dst FROM {knn} UNION SELECT dst, src FROM {knn}"
#: Of one part, which is what the table on which SQL is compared fills.
ORACLE["knn_graph"] = BOTH.format(knn=KNN.format(m=8))
ORACLE["graph_hops"] = f"WITH e AS ({BOTH.format(knn=KNN.format(m=4))}), r AS (SELECT src, dst, 1 AS hops FROM e UNION ALL SELECT a.src, b.dst, 2 FROM e a JOIN e b ON a.dst = b.src) SELECT src, dst, min(hops)::INTEGER AS hops FROM r WHERE src % 20 = 0 AND src <> dst GROUP BY src, dst"
ORACLE["graph_parity"] = "SELECT vec_id AS query_id, TRUE AS same FROM embeddings WHERE vec_id % 20 = 0"
ORACLE["graph_recall"] = "SELECT b::INTEGER AS bridges, count(*) AS n, TRUE AS good FROM embeddings, (SELECT unnest([0, 4]) AS b) WHERE vec_id % 20 = 0 GROUP BY b"


def _rotated() -> str:
    """The codes of rotated vectors: the seeded matrix as literals, and components through it."""
    from facetrank.operators.encode import random_rotation

    values = ", ".join(f"({i}, {j}, {x!r})" for i, row in enumerate(random_rotation(64, 7).tolist()) for j, x in enumerate(row))
    plain = f"x AS ({PARTS['x']})"
    turned = f"x0 AS ({PARTS['x']}), rot(i, j, r) AS (VALUES {values}), x AS (SELECT vec_id, label, j AS pos, sum(v * r::DOUBLE) AS v FROM x0 JOIN rot ON i = pos GROUP BY vec_id, label, j)"
    return ORACLE["item_codes"].replace(plain, turned)


ORACLE["rotated_codes"] = _rotated()
ORACLE["concept_candidates"] = with_parts(
    f"SELECT field, value, n, {r6('n / n_all', 'prevalence')} FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS r FROM (SELECT field, value, count(*) AS n FROM (SELECT 'brand' AS field, brand AS value FROM facets UNION ALL SELECT 'type', type FROM facets UNION ALL SELECT 'size', size FROM facets) WHERE value <> 'Unknown' GROUP BY field, value), (SELECT count(*) AS n_all FROM embeddings) WHERE n >= 5 AND n / n_all BETWEEN 0.01 AND 0.7) WHERE r <= 4 ORDER BY n DESC, field, value LIMIT 14"
)
_AXES = [(f"axis{i}", f"embedding[{i + 1}] > 0") for i in range(6)]
ORACLE["conjunction_counts"] = " UNION ALL ".join(
    [f"SELECT '{a}+{b}' AS concepts, count(*) FILTER ({x} AND {y}) AS n FROM embeddings" for i, (a, x) in enumerate(_AXES) for b, y in _AXES[i + 1 :]]
    + [f"SELECT '{a}+{b}+{c}', count(*) FILTER ({x} AND {y} AND {z}) FROM embeddings" for i, (a, x) in enumerate(_AXES) for j, (b, y) in enumerate(_AXES[i + 1 :], i + 1) for c, z in _AXES[j + 1 :]]
)
ORACLE["ordered_distinct"] = "SELECT conv_id, string_agg(role, ',' ORDER BY first, role) AS roles, bool_or(role IN ('system', 'tool')) AS special FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY conv_id, role) GROUP BY conv_id"
ORACLE["box_intersection"] = with_parts(
    f"SELECT vec_id, {r6('avg((code >= lo AND code <= hi)::INT)', 'inside')}, max(n_empty)::INTEGER AS n_empty FROM q2 JOIN (SELECT *, sum((lo > hi)::INT) OVER () AS n_empty FROM (SELECT a.pos, greatest(a.b[1], CASE WHEN o.own >= o.m THEN c.b[1] ELSE -1e300 END) AS lo, least(a.b[2], CASE WHEN o.own >= o.m THEN 1e300 ELSE c.b[2] END) AS hi FROM (SELECT pos, quantile_cont(code, [0.1, 0.9]) AS b FROM q2 WHERE label = 3 GROUP BY pos) a JOIN (SELECT pos, quantile_cont(code, [0.1, 0.9]) AS b FROM q2 WHERE label = 7 GROUP BY pos) c USING (pos) JOIN (SELECT pos, avg(code) AS m, avg(code) FILTER (label = 7) AS own FROM q2 GROUP BY pos) o USING (pos))) USING (pos) GROUP BY vec_id"
)
ORACLE["code_distance"] = with_parts(f"SELECT a.vec_id, {r6('-avg(abs(a.code - b.code))', 'score')} FROM q2 a JOIN {PLACES} pa ON pa.vec_id = a.vec_id JOIN {PLACES} pb ON pb.ordinal = pa.ordinal + 1 JOIN q2 b ON b.vec_id = pb.vec_id AND b.pos = a.pos GROUP BY a.vec_id")
ORACLE["method_table"] = with_parts(
    f"SELECT method, count(recall) AS n, {r6('avg(recall)', 'mean')}, max(CASE method WHEN 'dense' THEN 1536 WHEN 'linear' THEN 1536 WHEN 'program' THEN 56 END)::BIGINT AS item_bytes FROM per_query WHERE retention = 0.2 GROUP BY method"
)
ORACLE["fixed_oversample"] = with_parts(
    f"SELECT query_id, hits, n_truth, {r6('CASE WHEN n_truth = 0 THEN 1 ELSE hits / n_truth END', 'recall')} FROM (SELECT q AS query_id, (SELECT count(*) FROM (SELECT * FROM (SELECT ds.* FROM ds QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, vec_id) <= 80), gates WHERE semantic >= g[2] AND vec_id <> query_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, vec_id) <= 10) f JOIN truth t ON f.query_id = t.query_id AND f.vec_id = t.vec_id WHERE f.query_id = q) AS hits, (SELECT count(*) FROM truth t WHERE t.query_id = q) AS n_truth FROM (SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0) a(q))"
)
ORACLE["exact_sample"] = "SELECT count(*) // 3 AS n, count(*) // 3 AS n_ids FROM embeddings"
ORACLE["raw_vectors"] = with_parts(f"SELECT vec_id, pos::INTEGER AS pos, {r6('v::FLOAT::DOUBLE', 'x')} FROM x")
ORACLE["substrate_codes"] = ORACLE["quantile_codes"]
