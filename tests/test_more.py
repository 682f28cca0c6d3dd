"""Operators without a registered query, or whose cases a query doesn't reach."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetrank.operators import compose as C
from facetrank.operators import encode as E
from facetrank.operators import evaluate as V
from facetrank.operators import fit as T
from facetrank.operators import lut as L
from facetrank.operators import masks as M
from facetrank.operators import program as P
from facetrank.operators import quantize as Q
from facetrank.operators import search as S
from facetrank.operators import substrate as B
from facetrank.sources import assets as A
from facetrank.sources import store
from facetrank.streaming import encode as stream


@pytest.fixture(scope="module")
def items(spark):
    return A.random_items(spark, 300, 16, 3).withColumn("label", (F.col("vec_id") % 3).cast("int")).cache()


def test_truth_mask(spark):
    rows = spark.createDataFrame([(1, True, False), (2, True, True), (3, None, False), (4, True, None)], "id int, a boolean, b boolean")
    assert [r["id"] for r in rows.where(M.truth_mask(["a"], ["b"])).orderBy("id").collect()] == [1, 4]
    assert rows.where(M.truth_mask()).count() == 4
    groups = spark.createDataFrame([("x", 1), ("x", 0), ("y", 0)], "g string, t int")
    assert {r["g"] for r in M.with_truth(groups, ["g"], "t").collect()} == {"x"}


def test_boxes(spark):
    box, empty = M.intersect({0: (1.0, 3.0), 1: (0.0, 1.0)}, M.one_sided({0: (2.0, 5.0), 1: (2.0, 3.0)}, {0: 4.0, 1: 2.0}, {0: 1.0, 1: 2.0}))
    assert box == {0: (2.0, 3.0), 1: (2.0, 1.0)} and empty == [1]
    rows = spark.createDataFrame([([2, 5],), ([9, 9],)], "q array<int>")
    assert [r[0] for r in rows.select(M.share_inside("q", box)).collect()] == [0.5, 0.0]
    assert rows.select(M.share_inside("q", {})).first()[0] == 1.0


def test_concept_limits(spark):
    rows = spark.createDataFrame([("a" if i < 80 else f"b{i % 10}", f"c{i % 7}") for i in range(100)], "x string, y string")
    found = [(r["field"], r["value"]) for r in M.concept_candidates(rows, ["x", "y"], min_count=2, low=0.01, total=5).collect()]
    assert len(found) == 5 and ("x", "a") not in found and sum(f == "y" for f, _ in found) == 4


def test_code_distance(spark):
    rows = spark.createDataFrame([([1, 2, 3], [1, 4, 2]), ([], [])], "a array<int>, b array<int>")
    assert [r[0] for r in rows.select(M.negative_mean_l1("a", "b")).collect()] == [-1.0, None]
    assert not rows.select(M.fields_overlap(F.lit(None).cast("array<int>"), "a")).first()[0]


def test_substrate(spark, items):
    with pytest.raises(ValueError):
        B.build_substrate(items, dim=16, size=20)
    for options in ({"projection": "orthogonal"}, {"projection": "dictionary", "size": 24, "kind": "uniform", "bits": 4}, {"whitening": 0.5}):
        made = B.build_substrate(items, dim=16, **options)
        codes = np.array([r[0] for r in items.select(made.codes()).collect()])
        assert codes.shape == (300, options.get("size", 16)) and codes.min() == 0 and codes.max() == (1 << options.get("bits", 2)) - 1
        assert made.centroids.shape == (codes.shape[1], 1 << options.get("bits", 2)) and (np.diff(made.centroids, axis=1) >= 0).all()


def test_encode_splits(spark, items):
    rows = items.withColumn("split", F.when(F.col("vec_id") < 200, "fit").otherwise("test"))
    encoder, codes = B.encode_splits(rows, "split", keep=["vec_id"])
    x = np.array([r["embedding"] for r in rows.where("split = 'fit'").collect()], float)
    assert np.allclose(encoder.centroid, x.mean(axis=0), atol=1e-6) and codes.count() == 300 and "split" in codes.columns


def test_teacher_score(spark, items):
    rng = np.random.default_rng(1)
    pos, neg = rng.standard_normal((3, 16)), rng.standard_normal((4, 16))
    unit = lambda v: v / np.linalg.norm(v)
    want = {r["vec_id"]: unit(np.array(r["embedding"], float)) @ (unit(pos.mean(axis=0)) - unit(neg.mean(axis=0))) for r in items.collect()}
    got = {r[0]: r[1] for r in items.select("vec_id", B.teacher_score("embedding", pos, neg)).collect()}
    assert all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_serialised_tables(spark):
    samples = spark.createDataFrame([(i, "c", [i % 4, i % 3, i % 5 % 4], int(i % 4 > 1)) for i in range(200)], "id bigint, concept string, codes array<int>, label int")
    fitted = L.fit_boosted(samples, bins=4, k=2, pairs=1)
    row = B.serialise_tables(fitted, 2, 1).first()
    assert len(row["coords"]) == 2 and len(row["pair_tables"][0]) == 16
    with pytest.raises(Exception, match="number of terms"):
        B.serialise_tables(fitted, 24, 2).collect()


def test_add_tables(spark):
    both = L.add_tables({0: [1.0, 2.0]}, {0: [0.5, 0.5], 2: [3.0, 4.0]})
    rows = spark.createDataFrame([([1, 0, 0],)], "q array<int>")
    assert rows.select(L.table_score("q", both, 1.0)).first()[0] == 1.0 + 2.5 + 3.0


def test_grid_threshold(spark):
    rng = np.random.default_rng(4)
    y = rng.random(500) < 0.3
    s = y * 0.7 + rng.random(500)
    rows = spark.createDataFrame([(float(a), int(b), "g") for a, b in zip(s, y, strict=True)], "s double, y int, g string")
    grid = np.linspace(s.min(), s.max(), 160)
    f1 = [2 * (y & (s >= t)).sum() / ((s >= t).sum() + y.sum()) for t in grid]
    for by in ((), ("g",)):
        got = T.best_f1_on_grid(rows, "s", "y", by=by).first()
        assert abs(got["f1"] - max(f1)) < 0.02 and T.best_f1(rows, "s", "y", by=by).first()["f1"] >= got["f1"] - 1e-12
    flat = rows.withColumn("s", F.lit(1.0))
    assert T.best_f1_on_grid(flat, "s", "y").first()["threshold"] == 1.0 and T.best_f1(rows.limit(0), "s", "y").count() == 0


def test_threshold_curve_over_ranges(spark):
    """Running sums over many ranges are those of one."""
    rows = spark.range(5000).select((F.col("id") % 997).cast("double").alias("s"), (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 2).alias("g"))
    got = {(r["g"], r["threshold"]): (r["tp"], r["n"], r["total"]) for r in T.threshold_curve(rows, "s", "y", ["g"]).collect()}
    i = np.arange(5000)
    for g in (0, 1):
        for t in (0, 13, 500, 996):
            here = (i % 2 == g) & (i % 997 >= t)
            assert got[g, float(t)] == ((here & (i % 3 == 0)).sum(), here.sum(), ((i % 2 == g) & (i % 3 == 0)).sum())


def test_result_merges(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "method string, recall double")
    sizes = spark.createDataFrame([("a", 7)], "method string, bytes int")
    assert {tuple(r) for r in V.beside(rows, sizes).collect()} == {("a", 1.0, 7), ("b", 2.0, None)}
    times = spark.createDataFrame([(1, False, 8.0), (1, True, 2.0), (2, False, 1.0)], "n int, early boolean, ms double")
    assert [tuple(r) for r in V.early_exit_gain(times, ["n"]).collect()] == [(1, 8.0, 2.0, 4.0)]
    runs = [("live", 1, None, 0.9, 5.0), ("materialised", 1, None, 0.91, 4.0), ("overfetch", 1, 1.0, 0.5, 3.0), ("overfetch", 1, 2.0, 0.7, 6.0)]
    table = spark.createDataFrame(runs, "system string, fraction int, multiplier double, recall double, ms double")
    assert V.search_comparison(table, ["fraction"]).count() == 2
    with pytest.raises(Exception, match="several"):
        V.search_comparison(table.union(table), ["fraction"]).collect()


def test_assets(spark, items, tmp_path):
    encoder = E.fit_encoder(items)
    head = P.centroid_heads(items, "label", {"l1": 1}, dim=16)[0]
    program = P.compile_head(head, encoder)
    edges = Q.quantile_edges(items, "embedding", 16, 2)
    record = A.export_assets(items, encoder, [program], str(tmp_path / "x"), small=Q.quantile_codes("embedding", edges), dim=16)
    assert record["tables"] == ["binary", "dense", "lut"] and A.read_json(spark, str(tmp_path / "x" / "manifest")) == record
    assert spark.read.parquet(str(tmp_path / "x" / "lut")).count() == 300
    assert store.ProgramStore(spark, str(tmp_path / "x" / "programs")).names() == ["l1"]
    with pytest.raises(Exception, match="exist"):
        A.export_assets(items, encoder, [program], str(tmp_path / "x"))
    about = A.run_manifest(spark, {"a": 1})
    assert about["run_id"].endswith(about["config_hash"]) and about["revision"]


def test_raw_files(spark, tmp_path):
    for kind, dtype in A.RAW.items():
        np.arange(24).astype(dtype).tofile(tmp_path / f"x.{kind}")
        rows = A.read_raw(spark, str(tmp_path / f"x.{kind}"), kind, 6).orderBy("row_id").collect()
        assert [list(r["values"]) for r in rows] == np.arange(24).reshape(4, 6).tolist()
    with pytest.raises(Exception, match="multiple"):
        A.read_raw(spark, str(tmp_path / "x.u8"), "u8", 5).collect()


def test_kept_table(spark, tmp_path):
    made = []
    for meta in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert A.kept_table(spark, f"file://{tmp_path}", meta, lambda: made.append(1) or spark.range(3)).count() == 3
    assert len(made) == 2


def test_generators(spark):
    one, two = (A.random_items(spark, 50, 8, seed).collect() for seed in (1, 1))
    assert one == two and all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-5 for r in one)
    values = np.array([r["values"] for r in A.random_bytes(spark, 200, 32).collect()])
    assert values.min() >= 0 and values.max() <= 255 and abs(values.mean() - 127.5) < 5


def test_published_program_and_tombstones(spark, items, tmp_path):
    """A program that is saved while a stream runs serves the next batch, and deleted ids stay out."""
    encoder = E.fit_encoder(items)
    programs = store.ProgramStore(spark, str(tmp_path / "programs"))
    program = P.compile_head(P.centroid_heads(items, "label", {"l1": 1}, dim=16)[0], encoder)
    programs.save(program)
    programs.save(program.calibrated(2.0, 0.0))
    assert store.ProgramStore(spark, str(tmp_path / "programs")).load("l1").calibration_a == 2.0
    items.write.parquet(str(tmp_path / "in"))
    out = []
    deleted = spark.range(100).withColumnRenamed("id", "vec_id")
    run = stream.without_tombstones(deleted, "vec_id", lambda batch, epoch: out.extend(r["vec_id"] for r in batch.collect()))
    scored = stream.score_stream(spark.readStream.schema(items.schema).parquet(str(tmp_path / "in")), encoder, {"l1": programs.load("l1")})
    scored.writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(out) == list(range(100, 300))


def test_small_parts(spark, items):
    assert S.random_candidates(spark, 40, 300).where("row_id < 0 OR row_id >= 300").isEmpty()
    x = E.random_dictionary(16, 24)
    assert x.shape == (16, 24) and np.allclose(np.linalg.norm(x, axis=0), 1)
    turned = E.pca_rotation(items)
    assert np.allclose(turned.T @ turned, np.eye(16), atol=1e-8)
    assert spark.range(1).select(C.navigation(F.lit(0.5), F.lit(-1.0), 0.2)).first()[0] is not None
