"""Behaviour of the operators beyond what the SQL comparison covers."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from facetrank.functions import numeric as N
from facetrank.functions.parsing import parse, parse_concepts, parse_filters, query_text
from facetrank.operators import encode as E
from facetrank.operators import evaluate as V
from facetrank.operators import fit as T
from facetrank.operators import graph as G
from facetrank.operators import lut as L
from facetrank.operators import program as P
from facetrank.operators import quantize as Q
from facetrank.operators import search as S
from facetrank.operators.account import footprints, storage_table
from facetrank.operators.compose import log_probability, soft_min
from facetrank.plans import catalog
from facetrank.plans.executor import SemanticExecutor
from facetrank.sources.store import ProgramStore, append_items, config_hash, key_values, manifest, read_codes, read_encoder, read_vectors, write_index


def vectors(spark, n, dim, seed, unit=True):
    x = np.random.default_rng(seed).standard_normal((n, dim)).astype(np.float32)
    if unit:
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": [r.tolist() for r in x]}), "vec_id bigint, embedding array<float>")
    return x.astype(np.float64), frame


def test_code_layout(spark):
    x, items = vectors(spark, 50, 16, 0)
    enc = E.fit_encoder(items)
    assert (enc.dim, enc.lanes, enc.packed_bytes, enc.item_bytes) == (16, 1, 2, 10.0)
    rows = E.encode(items, enc).orderBy("vec_id").collect()
    rest = x - np.array(enc.centroid)
    for row, r in zip(rows, rest, strict=True):
        assert row["w0"] == sum(1 << i for i, v in enumerate(r) if v > 0)
        assert row["pop"] == (r > 0).sum()
        assert row["lo"] == pytest.approx(r[r <= 0].mean() if (r <= 0).any() else 0)
        assert row["hi"] == pytest.approx(r[r > 0].mean() if (r > 0).any() else 0)


def test_one_sided_rows_and_odd_dimension(spark):
    items = spark.createDataFrame([(0, [1.0] * 40), (1, [-1.0] * 40), (2, [0.0] * 40)], "vec_id bigint, embedding array<double>")
    enc = E.Encoder(tuple([0.0] * 40))
    rows = {r["vec_id"]: r for r in E.encode(items, enc).collect()}
    assert enc.lanes == 2 and rows[0]["lo"] == 0 and rows[0]["hi"] == 1
    assert rows[1]["hi"] == 0 and rows[1]["lo"] == -1
    assert rows[2]["pop"] == 0  # a residual of 0 sets no bit


def test_int4_and_planes():
    w = np.random.default_rng(1).standard_normal(384)
    q, decoded, low, scale = P.quantise_int4(w)
    assert q.min() == 0 and q.max() == 15 and scale > 0
    planes = P.bit_planes(q)
    assert len(planes) == 4 and len(planes[0]) == 12
    again = [sum((planes[t][j // 32] >> j % 32 & 1) << t for t in range(4)) for j in range(384)]
    assert again == q.tolist()
    assert P.quantise_int4([2.0, 2.0, 2.0])[0].tolist() == [0, 0, 0]


def test_packed_score_equals_decoded(spark):
    x, items = vectors(spark, 80, 32, 4)
    w = np.random.default_rng(4).standard_normal(32)
    head = P.Head("h", tuple(w), 0.2)
    for rotation in (None, E.random_rotation(32, 3)):
        enc = E.fit_encoder(items, projection=rotation)
        program = P.compile_head(head, enc)
        assert program.bytes == 40
        rows = E.encode(items, enc).select(program.raw().alias("a"), P.decoded_linear(head, enc).alias("b")).collect()
        assert max(abs(r["a"] - r["b"]) for r in rows) < 1e-5
        exact = x @ w + 0.2
        assert np.corrcoef([r["a"] for r in rows], exact)[0, 1] > 0.75


def test_executor(spark, tmp_path):
    x, items = vectors(spark, 300, 48, 9)
    index, programs = str(tmp_path / "index"), str(tmp_path / "programs")
    write_index(items, E.fit_encoder(items), index)
    with pytest.raises(Exception, match="(?i)exist"):
        write_index(items, E.fit_encoder(items), index)
    run = SemanticExecutor.open(spark, index, programs)
    before = read_codes(spark, index).orderBy("vec_id").collect()
    labelled = items.select("*", (N.component("embedding", 0) > 0).cast("int").alias("a"), (N.component("embedding", 1) > 0).cast("int").alias("b"))
    for name in ("a", "b"):
        run.programs.save(run.fit_predicate(labelled, name, name))
    assert run.programs.names() == ["a", "b"]
    assert read_codes(spark, index).orderBy("vec_id").collect() == before
    top = run.topk(None, ("a",), ("b",), 30).collect()
    assert len(top) == 30 and all(p["score"] >= q["score"] for p, q in zip(top, top[1:], strict=False)) and all(math.isfinite(r["score"]) for r in top)
    assert run.topk_early_exit(("a",), ("b",), 30, sample=0.5).collect() == top
    good = {r[0] for r in labelled.where("a = 1 AND b = 0").select("vec_id").collect()}
    assert sum(r["vec_id"] in good for r in top) > 20
    assert run.topk(None, ("a",), (), 0).count() == 0 and run.topk(None, ("a",), (), 1000).count() == 300
    bag = spark.createDataFrame([(1,), (1,), (5,)], "vec_id bigint")
    assert run.score_candidates(bag, ("a",)).count() == 3
    assert [r["score"] for r in run.score_candidates(bag).collect()] == [0, 0, 0]
    assert run.topk(bag.limit(0), ("a",), (), 5).count() == 0
    with pytest.raises(Exception, match="no such candidate"):
        run.score_candidates(spark.createDataFrame([(9999,)], "vec_id bigint"), ("a",)).collect()
    with pytest.raises(FileExistsError):
        run.programs.save(run.program("a"), overwrite=False)
    with pytest.raises(ValueError):
        run.fit_predicate(labelled.withColumn("one", F.lit(1)), "one", "one")
    with pytest.raises(ValueError):
        run.programs.save(P.Program("no/good", 48, ((0, 0),) * 4, 0, 1, 0, 0))
    append_items(items.withColumn("vec_id", F.col("vec_id") + 1000), index)
    assert manifest(spark, index).first()["n_items"] == 600 and read_encoder(spark, index).dim == 48


def test_plan_order():
    programs = {n: P.Program(n, 32, ((0,),) * 4, 0, 1, 0, 0, positive_rate=r) for n, r in (("x", 0.7), ("y", 0.2), ("z", 0.5))}
    run = SemanticExecutor(None, E.Encoder((0.0,) * 32), programs)
    assert [(r.name, r.positive) for r in run.plan(("z", "y"), ("x", "z"))] == [("y", True), ("x", False), ("z", True), ("z", False)]


def test_composition(spark):
    rows = spark.createDataFrame([(0, 4.0, 4.0), (1, 4.0, -4.0), (2, -4.0, 4.0), (3, -4.0, -4.0)], "id int, a double, b double")
    z = [F.col("a"), F.col("b")]
    for signs, best in (((1, 1), 0), ((1, -1), 1)):
        assert rows.select("id", log_probability(z, signs).alias("s")).orderBy(F.desc("s")).first()["id"] == best
    assert rows.select(log_probability([], ()).alias("s")).first()["s"] == 0
    assert rows.where("id = 0").select(soft_min(z, 1.0).alias("s")).first()["s"] == pytest.approx(4)
    big = spark.createDataFrame([(1000.0,), (-1000.0,)], "z double").select(N.log_sigmoid(F.col("z")).alias("l")).collect()
    assert big[0]["l"] == pytest.approx(0) and big[1]["l"] == pytest.approx(-1000)


def test_boosted_and_pairs():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((1200, 32))
    y = (x[:, 0] + 0.6 * x[:, 1] > 0).astype(float)
    codes = np.stack([np.searchsorted(np.quantile(c, np.arange(1, 16) / 16), c, side="right") for c in x.T], axis=1)
    start, terms = L.boost(codes, y, k=8, bins=16, pool=16, pairs=2)
    score = np.full(len(y), start)
    for a, b, row in terms:
        score += np.asarray(row)[codes[:, a] if b < 0 else codes[:, a] * 16 + codes[:, b]]
    assert len(terms) == 10 and np.isfinite(score).all()
    assert ((score > 0) == (y > 0)).mean() > 0.9


def test_small_code_packing(spark):
    codes = np.random.default_rng(9).integers(0, 16, (17, 40))
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(codes)], "id int, q array<int>")
    back = rows.select("id", Q.unpack(Q.pack(F.col("q"), 40, 4), 40, 4).alias("b")).orderBy("id").collect()
    assert [r["b"] for r in back] == codes.tolist()
    assert rows.select(Q.int16_table(F.array(F.lit(1.5), F.lit(-100.0))).alias("t")).first()["t"] == [1536, -32768]


def test_whitening(spark):
    x, items = vectors(spark, 400, 8, 3, unit=False)
    mean, matrix = E.power_whitener(items, 1.0)
    z = np.array([r[0] for r in items.select(E.whiten("embedding", mean, matrix, False)).collect()])
    assert np.allclose(np.cov(z.T, bias=True), np.eye(8), atol=1e-2)
    assert E.random_dictionary(8, 5).shape == (8, 5)
    r = E.random_rotation(16)
    assert np.allclose(r @ r.T, np.eye(16))


def test_unit_norm_check(spark):
    _, items = vectors(spark, 20, 8, 1)
    assert E.assert_unit_norm(items) is items
    with pytest.raises(ValueError):
        E.assert_unit_norm(items.withColumn("embedding", F.transform("embedding", lambda v: v * 2)))


def test_calibrator(spark):
    flat = spark.createDataFrame([(1.0, 1), (1.0, 0)], "s double, y int")
    assert T.calibrator(flat, "s", F.col("y")) == (0.0, pytest.approx(math.log((1.5 / 3) / (1.5 / 3))))
    one = spark.createDataFrame([(1.0, 1), (2.0, 1)], "s double, y int")
    assert T.calibrator(one, "s", F.col("y"))[0] == 0.0
    rng = np.random.default_rng(0)
    s = rng.standard_normal(2000)
    y = rng.random(2000) < 1 / (1 + np.exp(-(2 * s + 0.5)))
    a, b = T.calibrator(spark.createDataFrame([(float(p), int(q)) for p, q in zip(s, y, strict=True)], "s double, y int"), "s", F.col("y"))
    assert a == pytest.approx(2, abs=0.4) and b == pytest.approx(0.5, abs=0.3)


def test_ranking_edges(spark):
    rows = spark.createDataFrame([("q", i, float(i), 0) for i in range(10)], "query string, id int, score double, t int")
    out = V.retention_curve(rows, ["query"], "score", "id", "t", [0.05, 0.25, 1.0]).orderBy("retention").collect()
    assert [r["k"] for r in out] == [1, 2, 10] and all(r["recall"] is None and r["purity"] == 0 for r in out)
    ties = spark.createDataFrame([(i, 1.0) for i in (5, 3, 9)], "id int, s double")
    assert [r["id"] for r in S.top_k(ties, "s", "id", 2).collect()] == [3, 5]
    assert S.top_k(ties, "s", "id", 0).count() == 0


def test_bootstrap(spark):
    rows = spark.createDataFrame([("m", float(v)) for v in np.random.default_rng(5).random(200)], "method string, v double")
    r = V.bootstrap_ci(rows, ["method"], "v").first()
    assert r["lo"] < r["mean"] < r["hi"] and r["hi"] - r["lo"] < 0.12 and r["n"] == 200


def test_accounting(spark):
    f = {x.method: x for x in footprints()}
    assert (f["binary1_ls2_int4"].item_bytes, f["binary1_ls2_int4"].program_bytes) == (56, 216)
    assert (f["pq64_linear"].program_bytes, f["pq64_linear"].active_program_bytes, f["pq64_linear"].shared_bytes) == (1548, 65548, 393216)
    rows = {r["method"]: r for r in storage_table(spark, 5_000_000, 100_000).collect()}
    assert rows["binary1_ls2_int4"]["total_bytes"] == 301_600_000
    assert rows["pq64_linear"]["total_mb"] == pytest.approx(475.193216)


def test_parser():
    positive, negative = parse_concepts("minimalist black office shoes not sporty")
    assert set(positive) == {"minimalist", "office_appropriate"} and negative == ["technical_sporty"]
    assert parse_concepts("quiet luxury accessories") == (["quiet_luxury"], [])
    values = {"baseColour": ["Black", "Navy Blue", "Blue"], "gender": ["Women"], "articleType": ["Casual Shoes", "Tops"], "subCategory": ["Shoes"]}
    assert parse_filters("black women casual shoes", values) == {"baseColour": "Black", "gender": "Women", "articleType": "Casual Shoes", "subCategory": "Shoes"}
    assert parse_filters("navy blue tops", values) == {"baseColour": "Navy Blue"}
    assert parse("men's retro", values, {"gender": "Any", "baseColour": "Blue"}).filters == {"gender": "Men", "baseColour": "Blue"}
    assert query_text(["a"], [("f", "X_y")], ["b"]) == "a x y not b"


def test_query_benchmark(spark):
    rng = np.random.default_rng(7)
    frame = pd.DataFrame({"vec_id": range(1000), "colour": rng.choice(["Red", "Blue", "Unknown"], 1000), "kind": rng.choice(["Shoe", "Bag"], 1000)} | {f"c{i}": rng.random(1000) < 0.5 for i in range(8)})
    items = spark.createDataFrame(frame)
    one, two = (catalog.query_benchmark(items, ["colour", "kind"], ["kind"], [f"c{i}" for i in range(8)], 10, 77, min_truth=20).collect() for _ in range(2))
    assert one == two and len(one) == 10 and all(s["fit_truth"] >= 20 for s in one)
    with pytest.raises(RuntimeError):
        catalog.query_benchmark(items, ["colour", "kind"], ["kind"], ["c0"], 50, 1, min_truth=900)


def test_split_sizes(spark):
    items = spark.range(1003).withColumnRenamed("id", "vec_id")
    sizes = {r["split"]: r["n"] for r in catalog.split(items, "vec_id").groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes == {"test": 352, "cal": 131, "fit": 520}
    assert catalog.split(items, "vec_id").exceptAll(catalog.split(items, "vec_id")).isEmpty()


def test_descent():
    x = np.arange(20, dtype=float)[:, None]
    top = {0: np.array([10]), 10: np.array([0, 19]), 19: np.array([10])}
    assert G.descend(x, [{}, top], np.array([1.0]), 0) == 19 and G.descend(x, [{}], np.array([1.0]), 3) == 3


def test_boost_by_hand():
    """The greedy choice, the refit and the pairs against loops over all candidates."""
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 4, (300, 9))
    y = (codes[:, 2] + codes[:, 5] * codes[:, 7] + rng.integers(0, 4, 300) > 6).astype(float)
    start, terms = L.boost(codes, y, k=4, bins=4, pool=6, pairs=2, pair_pool=3)

    def newton(cell, margin, l2):
        p = 1 / (1 + np.exp(-margin))
        sums = [(sum((y - p)[cell == b]), sum((p * (1 - p))[cell == b])) for b in range(cell.max() + 1)]
        return [g / (h + l2) for g, h in sums], sum(g * g / (h + l2) for g, h in sums) / 2

    strength = []
    for j in range(9):
        pos, neg = (np.array([((codes[:, j] == b) & (y == v)).sum() for b in range(4)]) for v in (1, 0))
        prior = (pos + neg + 1) / (len(y) + 4)
        p1, p0 = (pos + 4 * prior) / (pos.sum() + 4), (neg + 4 * prior) / (neg.sum() + 4)
        strength.append(((p1 - p0) * np.log(p1 / p0)).sum())
    pool = sorted(range(9), key=lambda j: -strength[j])[:6]
    margin, chosen, table = np.full(300, start), [], {}
    for _ in range(4):
        j = max((j for j in pool if j not in chosen), key=lambda j: newton(codes[:, j], margin, 6.0)[1])
        chosen.append(j)
        table[j] = 0.55 * np.array(newton(codes[:, j], margin, 6.0)[0])
        margin = margin + table[j][codes[:, j]]
    for j in chosen:
        margin = margin - table[j][codes[:, j]]
        table[j] = np.array(newton(codes[:, j], margin, 6.0)[0])
        margin = margin + table[j][codes[:, j]]
    assert [t[0] for t in terms[:4]] == chosen
    assert all(np.allclose(t[2], table[t[0]]) for t in terms[:4])
    assert all(a in chosen[:3] and b in chosen[:3] for a, b, _ in terms[4:]) and len(terms) == 6


def test_boosted_sample(spark):
    rows = spark.createDataFrame([(i, "c", [i % 4, i % 3], int(i % 4 > 1)) for i in range(4000)], "id bigint, concept string, codes array<int>, label int")
    fitted = L.fit_boosted(rows, bins=4, k=1, max_rows=500).first()
    assert fitted["terms"][0]["coord"] == 0


def test_graph(spark):
    x = np.array([[float(i), 1.0] for i in range(6)])
    links = [np.array([j for j in (i - 1, i + 1) if 0 <= j < 6]) for i in range(6)]
    found, visited, asked = G.beam(x, links, np.array([1.0, 0.0]), lambda r: r % 2 == 0, 2, 4, [0])
    assert found == [4, 2] and visited == 6  # rows that fail are walked through
    assert G.beam(x, links, np.array([1.0, 0.0]), lambda r: True, 2, 4, [0], skip=5)[0] == [4, 3]
    _, items = vectors(spark, 400, 16, 2)
    items = items.withColumn("semantic", (F.col("vec_id") % 3).cast("double"))
    queries = items.where("vec_id < 20").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = G.filtered_search(items, G.build_graph(items, 12), queries, 1.0, k=10, ef=200)
    assert G.filtered_search(items.limit(0), G.build_graph(items.limit(0), 12), queries, 1.0, k=10, ef=200).count() == 0
    dense = S.dense_scores(items, S.query_vectors(items, range(20)), keep=["semantic"])
    truth = S.gated_truth(dense, 1.0, 10)
    assert S.recall(found, truth, queries).agg(F.avg("recall")).first()[0] > 0.9


def test_sources(spark, tmp_path):
    np.save(tmp_path / "x.npy", np.arange(12, dtype=np.float32).reshape(4, 3))
    rows = read_vectors(spark, str(tmp_path / "x.npy")).orderBy("row_id").collect()
    assert [list(r["embedding"]) for r in rows][2] == [6.0, 7.0, 8.0]
    assert spark.createDataFrame([("a=1\nb=x",)], "t string").select(key_values("t").alias("m")).first()["m"] == {"a": "1", "b": "x"}
    assert config_hash({"b": 1, "a": 2}) == config_hash({"a": 2, "b": 1})
    assert ProgramStore(spark, str(tmp_path / "none")).names() == []


def test_stream_equals_batch(spark):
    from facetrank.plans.queries import item_codes, stream_encode

    sf = "/root/testdata/sf0.001"
    assert stream_encode(spark, sf).exceptAll(item_codes(spark, sf)).isEmpty()
