"""Queries that take whole tables: nothing is left out where a table is larger than the one SQL is compared on."""

import duckdb
import numpy as np
import pytest

from facetrank.operators import graph as G
from facetrank.operators import quantize as Q
from facetrank.operators import search as S
from facetrank.plans.oracle import ORACLE
from facetrank.plans.queries import QUERIES

LARGE = "/root/testdata/sf0.1"
#: Queries on codes of quantisers, whose edges are fitted on all rows.
CODES = ["code_distance", "code_histograms", "columnar_codes", "quantile_codes", "substrate_codes", "uniform_codes", "llr_program_score", "newton_round1", "packed_small_codes"]


def embeddings():
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{LARGE}/embeddings.parquet' ORDER BY vec_id").fetchall()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)


@pytest.mark.parametrize("k", [3, 40])
def test_nearest_in_blocks(spark, monkeypatch, k):
    """Blocks smaller than the table, ties by id, with and without the query's own item."""
    monkeypatch.setattr(S, "QUERY_BLOCK", 1)
    monkeypatch.setattr(S, "PLACES", 1)
    x = np.random.default_rng(3).integers(-1, 2, (300, 5)).astype(float)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    queries = items.where("vec_id % 3 = 0").selectExpr("vec_id AS query_id", "embedding AS vector")
    for own in (True, False):
        want = []
        for q in range(0, 300, 3):
            order = [i for i in sorted(range(300), key=lambda i: (-(x[i] @ x[q]), i)) if own or i != q]
            want += [(q, r + 1, i) for r, i in enumerate(order[:k])]
        found = S.nearest(items, queries, k, own=own).select("query_id", "rank", "vec_id").collect()
        assert sorted(map(tuple, found)) == sorted(want)


def test_dense_topk_takes_every_query(spark):
    ids, x = embeddings()
    found = QUERIES["dense_topk"](spark, LARGE).collect()
    assert {r["query_id"] for r in found} == {int(i) for i in ids if i % 20 == 0} and len(found) == 10 * 100
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    for r in found:
        assert abs(np.sort(s[r["query_id"]])[-r["rank"]] - r["dense"]) < 1e-5


@pytest.mark.parametrize("name", ["bootstrap_ci", "graph_search"])
def test_queries_without_sql_take_every_query(spark, name):
    rows = QUERIES[name](spark, LARGE)
    assert rows.agg({"n": "max"}).first()[0] == 100 if name == "bootstrap_ci" else rows.select("query_id").distinct().count() == 100


def test_geometry_pairs_name_every_item(spark):
    """20,000 pairs less those of an item with itself, and the correlation of a NumPy version."""
    _, x = embeddings()
    i = np.arange(20_000, dtype=np.int64)
    mixed = (i * 48271 + 11) % 2147483647
    a, b = i % len(x), mixed * mixed % 2147483647 % len(x)
    a, b = a[a != b], b[a != b]
    assert len(set(a)) == len(x) and len(set(zip(a, b, strict=True))) > 19_000
    bits = x - x.mean(axis=0) > 0
    row = QUERIES["geometry_corr"](spark, LARGE).first()
    assert row["n"] == len(a)
    assert abs(row["corr"] - np.corrcoef((x[a] * x[b]).sum(axis=1), (bits[a] == bits[b]).mean(axis=1))[0, 1]) < 1e-5


@pytest.mark.parametrize(("name", "n"), [("candidate_scores", 6000), ("tiled_codes", 5200)])
def test_bags_name_every_item(spark, name, n):
    ids, _ = embeddings()
    rows = QUERIES[name](spark, LARGE).select("vec_id").collect()
    assert len(rows) == n and {r["vec_id"] for r in rows} == set(ids.tolist())


@pytest.mark.parametrize("part_items", [G.PART_ITEMS, 120])
def test_graph_search_in_parts(spark, monkeypatch, part_items):
    """Nearly all of the exact gated top-k, however the items are dealt."""
    monkeypatch.setattr(G, "PART_ITEMS", part_items)
    small = "/root/testdata/sf0.01"
    beam = {(r["query_id"], r["vec_id"]) for r in QUERIES["graph_search"](spark, small).collect()}
    truth = {(r["query_id"], r["vec_id"]) for r in QUERIES["gated_truth_topk"](spark, small).collect()}
    assert len(truth) == 250 and len(beam) == 250 and len(beam & truth) > 0.9 * 250


def test_graph_work(spark):
    """The gate is asked for a part of the items only (vectors here lie so that a beam of 128 comes by nearly all)."""
    rows = QUERIES["graph_search"](spark, LARGE).collect()
    n = len(embeddings()[0])
    assert all(r["evaluations"] <= r["visited"] <= n for r in rows) and sum(r["evaluations"] for r in rows) < 0.7 * n * len(rows)
    assert {r["same"] for r in QUERIES["graph_parity"](spark, LARGE).collect()} == {True}
    assert all(r["good"] and r["n"] == 100 for r in QUERIES["graph_recall"](spark, LARGE).collect())


def test_dense_scores_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "QUERY_BLOCK", 2)
    items = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, -1.0])], "vec_id bigint, embedding array<double>")
    found = S.dense_scores(items, {q: [float(q), 1.0] for q in range(5)}).collect()
    assert sorted((r["query_id"], r["vec_id"], r["dense"]) for r in found) == sorted((q, i, s) for q in range(5) for i, s in ((0, q + 2.0), (1, 3.0 * q - 1)))


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    """110,000 vectors: 55 copies of sf0.1's, each with its components turned by another number of places."""
    folder = tmp_path_factory.mktemp("many")
    turned = "embedding[1 + k:64] || embedding[1:k] AS embedding, (label + k) % 10 AS label"
    duckdb.sql(f"COPY (SELECT vec_id + 2000 * k AS vec_id, {turned} FROM '{LARGE}/embeddings.parquet', range(55) t(k)) TO '{folder}/embeddings.parquet' (ROW_GROUP_SIZE 10000)")
    return str(folder)


@pytest.mark.parametrize("last_values", [Q.LAST_VALUES, 200])
def test_quantiles_of_odd_values(spark, monkeypatch, last_values):
    """Nulls, NaN, both zeros, infinities, ties and vectors of other lengths, as the library's exact percentile has them."""
    monkeypatch.setattr(Q, "LAST_VALUES", last_values)
    inf, nan, at = np.inf, np.nan, [0.0, 0.005, 0.25, 0.5, 0.75, 1.0]
    odd = [[1.0, None, nan, -0.0], [2.0, 5.0, 1.0, 0.0], None, [3.0], [], [1.0, inf, 2.0, 0.0, 7.0], [1.0, -inf, 2.0, 5e-324], [-1e308, 4.0, nan, -0.0]]
    rng = np.random.default_rng(5)
    for rows in (odd, rng.integers(-2, 3, (2000, 5)).astype(float).tolist(), (rng.standard_cauchy((2000, 5)) ** 7).tolist()):
        items = spark.createDataFrame([(r,) for r in rows], "e array<double>").repartition(3)
        want = items.selectExpr(*[f"percentile(get(e, {i}), array({','.join(f'{a}D' for a in at)})) AS q{i}" for i in range(5)]).first()
        assert np.array_equal(Q.quantiles(items, "e", 5, at), list(want), equal_nan=True)
    assert np.isnan(Q.quantiles(items.where("false"), "e", 5, at)).all()


@pytest.mark.parametrize("name", CODES)
def test_codes_of_many_rows(spark, many, tmp_path, name):
    """Edges are those of all rows, however many there are: every row is that of the query's SQL."""
    QUERIES[name](spark, many).write.parquet(str(tmp_path / "out"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS FROM '{many}/embeddings.parquet'")
    db.sql(f"CREATE TABLE want AS {ORACLE[name]}")
    db.sql(f"CREATE TABLE found AS SELECT {', '.join(c[0] for c in db.sql('DESCRIBE want').fetchall())} FROM '{tmp_path}/out/*.parquet'")
    assert db.sql("SELECT count(*) > 0 FROM want").fetchall() == [(True,)]
    assert db.sql("(FROM want EXCEPT ALL FROM found) UNION ALL (FROM found EXCEPT ALL FROM want) LIMIT 1").fetchall() == []
