"""The library's queries over the standard tables: one per operator or small group of operators.

``embeddings`` are the items, their ten labels the concepts, and ``part`` gives facets by ``vec_id = p_partkey``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetrank.functions import numeric as N
from facetrank.functions.parsing import mentions
from facetrank.operators import compose as C
from facetrank.operators import encode as E
from facetrank.operators import evaluate as V
from facetrank.operators import fit as T
from facetrank.operators import graph as G
from facetrank.operators import lut as L
from facetrank.operators import masks as M
from facetrank.operators import program as P
from facetrank.operators import quantize as Q
from facetrank.operators import search as S
from facetrank.operators import substrate as B
from facetrank.operators.account import storage_table
from facetrank.plans import catalog
from facetrank.plans.executor import SemanticExecutor, search
from facetrank.sources import assets as A
from facetrank.sources.session import cut, prepare, table
from facetrank.streaming import encode as stream

DIM = 64
CONCEPTS = {f"label{k}": k for k in range(10)}
FACETS = {"brand": "p_brand", "type": "p_type", "size": "p_size"}
FRACTIONS = (0.05, 0.1, 0.2, 0.4)
#: The queries of searches.
ASKED = "vec_id % 20 = 0"


def items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


def encoder(spark: SparkSession, sf: str) -> E.Encoder:
    return E.fit_encoder(items(spark, sf))


def heads(spark: SparkSession, sf: str) -> list[P.Head]:
    return P.centroid_heads(items(spark, sf), "label", CONCEPTS, dim=DIM)


def compiled(spark: SparkSession, sf: str) -> tuple[E.Encoder, dict[str, P.Program]]:
    enc = encoder(spark, sf)
    return enc, {h.name: P.compile_head(h, enc) for h in heads(spark, sf)}


def coded(spark: SparkSession, sf: str, enc: E.Encoder) -> DataFrame:
    return E.encode(items(spark, sf), enc, keep=["vec_id", "label"])


def r6(column):
    """Rounded, and without a negative zero."""
    return F.round(column, 6) + F.lit(0.0)


# -- encoding -------------------------------------------------------------------------------------------------------


def encoder_centroid(spark, sf):
    return E.centroid(items(spark, sf), dim=DIM).select("pos", r6(F.col("centroid")).alias("centroid"))


def item_codes(spark, sf):
    codes = coded(spark, sf, encoder(spark, sf))
    return codes.select("vec_id", "w0", "w1", "pop", r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"))


def packed_codes(spark, sf):
    enc = encoder(spark, sf)
    return coded(spark, sf, enc).select("vec_id", E.packed_hex(enc).alias("bits"))


def norm_check(spark, sf):
    row = E.norm_check(items(spark, sf))
    return row.select("n_items", *[r6(F.col(c)).alias(c) for c in ("min_norm", "mean_norm", "max_norm", "max_error")])


def normalised(spark, sf):
    return items(spark, sf).select("vec_id", F.posexplode(N.normalise("embedding")).alias("pos", "x")).select("vec_id", "pos", r6(F.col("x")).alias("x"))


def sign_codes(spark, sf):
    return items(spark, sf).select("vec_id", F.posexplode(E.sign_codes("embedding", DIM)).alias("pos", "bit"))


def rotated_codes(spark, sf):
    rows = items(spark, sf)
    enc = E.fit_encoder(rows, projection=E.random_rotation(DIM, 7))
    return E.encode(rows, enc, keep=["vec_id"]).select("vec_id", "w0", "w1", "pop", r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"))


def whitened(spark, sf):
    rows = items(spark, sf)
    mean, matrix = E.power_whitener(rows, 0.5)
    return rows.select("vec_id", E.whiten("embedding", mean, matrix).alias("embedding"))


# -- heads, programs, scores ----------------------------------------------------------------------------------------


def centroid_head(spark, sf):
    rows = [(h.name, i, float(w), float(h.intercept)) for h in heads(spark, sf) for i, w in enumerate(h.weights)]
    return spark.createDataFrame(rows, "concept string, pos int, w double, b double").select("concept", "pos", r6(F.col("w")).alias("w"), r6(F.col("b")).alias("intercept"))


def program_int4(spark, sf):
    rows = []
    for h in heads(spark, sf):
        q, decoded, _, _ = P.quantise_int4(h.weights)
        rows += [(h.name, i, int(a), float(b)) for i, (a, b) in enumerate(zip(q, decoded, strict=True))]
    return spark.createDataFrame(rows, "concept string, pos int, q int, d double").select("concept", "pos", "q", r6(F.col("d")).alias("decoded"))


def program_planes(spark, sf):
    rows = [(p.name, t, plane[0], plane[1]) for p in compiled(spark, sf)[1].values() for t, plane in enumerate(p.planes)]
    return spark.createDataFrame(rows, "concept string, plane int, m0 bigint, m1 bigint")


def program_scalars(spark, sf):
    rows = [(p.name, p.weight_lo, p.weight_scale, p.base, p.sum_w) for p in compiled(spark, sf)[1].values()]
    out = spark.createDataFrame(rows, "concept string, weight_lo double, weight_scale double, base double, sum_w double")
    return out.select("concept", *[r6(F.col(c)).alias(c) for c in ("weight_lo", "weight_scale", "base", "sum_w")])


def raw_score(spark, sf):
    """Several programs fused in one projection."""
    enc, programs = compiled(spark, sf)
    return coded(spark, sf, enc).select("vec_id", *[r6(programs[n].raw()).alias(n) for n in ("label3", "label7")])


def fused_scores(spark, sf):
    enc, programs = compiled(spark, sf)
    return coded(spark, sf, enc).select("vec_id", *[r6(p.raw()).alias(n) for n, p in programs.items()])


def exact_linear(spark, sf):
    return items(spark, sf).select("vec_id", *[r6(P.exact_linear(h)).alias(h.name) for h in heads(spark, sf)[:4]])


def _pair(spark, sf) -> tuple[DataFrame, list]:
    enc, programs = compiled(spark, sf)
    return coded(spark, sf, enc), [programs["label3"].logit(), programs["label7"].logit()]


def signed_logprob(spark, sf):
    rows, z = _pair(spark, sf)
    return rows.select("vec_id", r6(C.log_probability(z, (1, -1))).alias("score"))


def mean_logprob(spark, sf):
    rows, z = _pair(spark, sf)
    return rows.select("vec_id", r6(C.mean_log_probability(z, (1, -1))).alias("score"))


def softmin(spark, sf):
    rows, z = _pair(spark, sf)
    return rows.select("vec_id", r6(C.soft_min(z, 0.5)).alias("score"))


def composition_rules(spark, sf):
    rows, z = _pair(spark, sf)
    return rows.select("vec_id", r6(C.minimum(z)).alias("min_logit"), r6(C.raw_sum(z)).alias("sum_logit"), r6(N.sigmoid(z[0])).alias("p3"), r6(N.logit(N.sigmoid(z[0]))).alias("logit3"))


def zero_shot(spark, sf):
    """Similarity to the normalised difference of two classes' mean vectors."""
    sums = items(spark, sf).groupBy("label").agg(F.array(*[F.avg(N.component("embedding", i)) for i in range(DIM)]).alias("m")).where("label IN (3, 7)")
    mean = {r["label"]: np.array(r["m"]) for r in sums.collect()}
    v = mean[3] - mean[7]
    return items(spark, sf).select("vec_id", r6(N.dot("embedding", (v / np.linalg.norm(v)).tolist())).alias("score"))


def semantic_topk(spark, sf, k=20, positive=("label3",), negative=("label7",)):
    enc, programs = compiled(spark, sf)
    best = SemanticExecutor(coded(spark, sf, enc), enc, programs).topk(None, positive, negative, k)
    return best.select("vec_id", r6(F.col("score")).alias("score"))


def early_exit_topk(spark, sf):
    enc, programs = compiled(spark, sf)
    best = SemanticExecutor(coded(spark, sf, enc), enc, programs).topk_early_exit(("label3",), ("label7",), 20, sample=0.5)
    return best.select("vec_id", r6(F.col("score")).alias("score"))


# -- dense search, filters, gates -----------------------------------------------------------------------------------


def _queries(spark, sf) -> DataFrame:
    """(query_id, vector, want) of the items that are queries."""
    return items(spark, sf).where(ASKED).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").alias("want"))


def dense_topk(spark, sf):
    return S.nearest(items(spark, sf), _queries(spark, sf), 10, own=False).select("query_id", "rank", "vec_id", r6(F.col("dense")).alias("dense"))


def dense_pool_exact_filter(spark, sf):
    rows = S.facets(items(spark, sf), table(spark, sf, "part"), "vec_id", "p_partkey", FACETS)
    query = S.query_vectors(rows, [0])[0]
    found = search(rows, query, {"type": "STANDARD"}, None, pool=200, k=20, exclude=0)
    return found.select("vec_id", "rank", r6(F.col("dense")).alias("dense"))


def facet_counts(spark, sf):
    rows = S.facets(items(spark, sf), table(spark, sf, "part"), "vec_id", "p_partkey", FACETS)
    return rows.groupBy("brand", "type").agg(F.count(F.lit(1)).alias("n"))


def _semantic(spark, sf) -> DataFrame:
    """(vec_id, semantic): mean log probability of +label3 -label7."""
    rows, z = _pair(spark, sf)
    return rows.select("vec_id", C.mean_log_probability(z, (1, -1)).alias("semantic"))


def gate_table(spark, sf):
    gates = S.gate_table(_semantic(spark, sf), "semantic", (0.5, 0.2, 0.1, 0.05, 0.001), 10)
    return gates.select("gate_index", "fraction", r6(F.col("gate")).alias("gate"), "eligible", r6(F.col("eligible_fraction")).alias("eligible_fraction"))


def _gates(spark, sf) -> tuple[DataFrame, dict[float, float], int]:
    """The items with ``semantic``, the gates that let through a half, a fifth and a tenth, and the number of items."""
    semantic = _semantic(spark, sf)
    row = semantic.agg(F.percentile("semantic", F.array(F.lit(0.5), F.lit(0.8), F.lit(0.9))).alias("q"), F.count(F.lit(1)).alias("n")).first()
    rows = cut(items(spark, sf).join(semantic, "vec_id").select("vec_id", "embedding", "semantic"))
    return rows, dict(zip((0.5, 0.2, 0.1), row["q"], strict=True)), row["n"]


def _gated(rows, queries, gate: float, k: int) -> DataFrame:
    return S.nearest(rows.where(F.col("semantic") >= N.lit(gate)), queries, k, own=False)


def _fetched(rows, queries, ask: int) -> DataFrame:
    return S.nearest(rows, queries, ask).drop("rank").join(rows.select("vec_id", "semantic"), "vec_id")


def gated_truth_topk(spark, sf):
    rows, gates, _ = _gates(spark, sf)
    return _gated(rows, _queries(spark, sf), gates[0.2], 10).select("query_id", "rank", "vec_id", r6(F.col("dense")).alias("dense"))


def overfetch_recall(spark, sf):
    rows, gates, n = _gates(spark, sf)
    queries = _queries(spark, sf)
    truth = cut(_gated(rows, queries, gates[0.2], 10))
    fetched = cut(_fetched(rows, queries, S.ask_size(0.2, 10, 2.0, n)))
    out = None
    for m in (0.5, 1.0, 2.0):
        found = S.recall(S.over_fetch(fetched, gates[0.2], 0.2, 10, m, n), truth, queries).withColumn("multiplier", F.lit(m))
        out = found if out is None else out.unionByName(found)
    return out.select("query_id", "multiplier", "hits", "n_truth", r6(F.col("recall")).alias("recall"))


def label_threshold(spark, sf):
    """Labels of all items for each query, by a threshold fitted on all items."""
    scored = cut(S.all_scores(items(spark, sf), _queries(spark, sf)))
    limits = scored.groupBy("query_id").agg(F.percentile("dense", 0.6).alias("limit"))
    return scored.join(F.broadcast(limits), "query_id").select("query_id", "vec_id", (F.col("dense") >= F.col("limit")).cast("int").alias("label"))


# -- quantisers -----------------------------------------------------------------------------------------------------


def _codes4(spark, sf, bits=2):
    rows = items(spark, sf)
    edges = Q.quantile_edges(rows, "embedding", DIM, bits)
    return rows.withColumn("codes", Q.quantile_codes("embedding", edges))


def uniform_codes(spark, sf):
    rows = items(spark, sf)
    limits = Q.quantiles(rows, "embedding", DIM, (0.005, 0.995))
    return rows.select("vec_id", F.posexplode(Q.uniform_codes("embedding", limits, 4)).alias("pos", "code"))


def quantile_codes(spark, sf):
    return _codes4(spark, sf).select("vec_id", F.posexplode("codes").alias("pos", "code"))


def bin_centroids(spark, sf):
    return Q.bin_centroids(_codes4(spark, sf), "embedding", "codes", DIM, 4).select("coord", "bin", r6(F.col("centroid")).alias("centroid"))


def packed_small_codes(spark, sf):
    packed = _codes4(spark, sf).withColumn("packed", Q.pack(F.col("codes"), DIM, 2))
    return packed.select("vec_id", F.posexplode(Q.unpack(F.col("packed"), DIM, 2)).alias("pos", "code"))


def columnar_codes(spark, sf):
    long = Q.columnar(_codes4(spark, sf), "vec_id", "codes")
    return long.groupBy("coord").agg(F.sum("code").alias("total"), F.count_if(F.col("code") == 3).alias("n_top"))


def pq_codes(spark, sf):
    book = Q.frozen_codebook(items(spark, sf), "embedding", DIM, 16, 8, "vec_id")
    return items(spark, sf).select("vec_id", F.posexplode(Q.pq_codes("embedding", book)).alias("part", "code"))


def pq_adc(spark, sf):
    rows = items(spark, sf)
    book = Q.frozen_codebook(rows, "embedding", DIM, 16, 8, "vec_id")
    h = heads(spark, sf)[3]
    codes = rows.select("vec_id", Q.pq_codes("embedding", book).alias("codes"))
    return codes.select("vec_id", r6(Q.pq_score(F.col("codes"), Q.pq_table(h.weights, book), h.intercept)).alias("score"))


def pq_trained(spark, sf):
    rows = items(spark, sf)
    book = Q.train_codebook(rows, "embedding", DIM, 4, 16)
    return rows.select("vec_id", Q.pq_codes("embedding", book).alias("codes"))


# -- tables ---------------------------------------------------------------------------------------------------------


def _labelled(spark, sf):
    return _codes4(spark, sf).withColumn("y", (F.col("label") == 3).cast("int"))


def code_histograms(spark, sf):
    return L.histograms(_labelled(spark, sf), "codes", "y", DIM, 4)


def llr_stats(spark, sf):
    stats = L.llr_stats(L.histograms(_labelled(spark, sf), "codes", "y", DIM, 4), 4)
    return stats.select("coord", "bin", *[r6(F.col(c)).alias(c) for c in ("llr", "strength", "mi")])


def llr_empirical_bayes(spark, sf):
    stats = L.llr_stats(L.histograms(_labelled(spark, sf), "codes", "y", DIM, 4), 4, tau=16.0)
    return stats.select("coord", "bin", *[r6(F.col(c)).alias(c) for c in ("llr", "strength", "mi")])


def llr_program_score(spark, sf):
    rows = _labelled(spark, sf)
    best = L.strongest(L.llr_stats(L.histograms(rows, "codes", "y", DIM, 4), 4), 12)
    return rows.select("vec_id", r6(L.table_score("codes", L.tables(best), L.prior_logit(rows, "y"))).alias("score"))


def newton_round1(spark, sf):
    rows = _labelled(spark, sf)
    found = L.newton_round(rows, "codes", "y", F.lit(L.prior_logit(rows, "y")))
    return found.select("coord", "bin", r6(F.col("step")).alias("step"), r6(F.col("gain")).alias("gain"))


def _samples(spark, sf):
    labels = F.explode(F.array(*[F.struct(F.lit(n).alias("concept"), (F.col("label") == k).cast("int").alias("y")) for n, k in list(CONCEPTS.items())[:4]]))
    return _codes4(spark, sf).select(F.col("vec_id").alias("id"), "codes", labels.alias("c")).select("id", "codes", "c.concept", F.col("c.y").alias("label"))


def boosted_lut(spark, sf, pairs=0):
    fitted = L.fit_boosted(_samples(spark, sf), bins=4, k=12, pairs=pairs).orderBy("concept").collect()
    scores = []
    for r in fitted:
        terms = [(t["coord"], t["other"], t["entries"]) for t in r["terms"]]
        scores.append(L.boosted_score("codes", r["intercept"], terms, 4).alias(r["concept"]))
    return _codes4(spark, sf).select("vec_id", *scores)


def box_predicate(spark, sf):
    boxes = L.box(_codes4(spark, sf), "codes", DIM, F.col("label") == 3, 0.1, 0.9)
    found = [(r["coord"], r["lo"], r["hi"]) for r in boxes.orderBy("coord").collect()]
    return _codes4(spark, sf).select("vec_id", r6(L.inside_share("codes", found)).alias("inside"))


def bitmask_predicate(spark, sf):
    """The coordinates whose sign differs most between a class and the rest, and the share of them that agree."""
    bits = items(spark, sf).select("vec_id", (F.col("label") == 3).alias("y"), F.posexplode(E.sign_codes("embedding", DIM)).alias("coord", "bit"))
    rates = bits.groupBy("coord").agg((F.avg(F.when(F.col("y"), F.col("bit"))) - F.avg(F.when(~F.col("y"), F.col("bit")))).alias("d"))
    best = rates.orderBy(F.desc(F.round(F.abs("d"), 9)), "coord").limit(16).select("coord", (F.col("d") > 0).cast("int").alias("polarity"))
    return bits.join(F.broadcast(best), "coord").groupBy("vec_id").agg(r6(F.avg((F.col("bit") == F.col("polarity")).cast("double"))).alias("agree"))


# -- evaluation -----------------------------------------------------------------------------------------------------

METHODS = ("dense", "linear", "oracle", "program")


def _evaluation(spark, sf) -> DataFrame:
    """(method, query_id, vec_id, score, t) over each query's dense pool of 200; the query's label is the truth."""
    rows = items(spark, sf)
    queries = _queries(spark, sf)
    enc, programs = compiled(spark, sf)
    all_heads = {h.name: h for h in heads(spark, sf)}
    codes = rows.select("*", *[c.alias(n) for n, c in E.code_columns(enc).items()])
    codes = codes.select("vec_id", "label", F.array(*[programs[n].raw() for n in CONCEPTS]).alias("program"), F.array(*[P.exact_linear(all_heads[n]) for n in CONCEPTS]).alias("linear"))
    pool = S.nearest(rows, queries, 200, own=False).join(codes, "vec_id").join(queries.select("query_id", "want"), "query_id")
    truth = (F.col("label") == F.col("want")).cast("int")
    scores = {"dense": F.col("dense"), "oracle": truth.cast("double"), **{m: F.get(m, F.col("want").cast("int")) for m in ("linear", "program")}}
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.round(s, 9).alias("score")) for m, s in scores.items()]))
    return pool.select("query_id", "vec_id", truth.alias("t"), each.alias("s")).select("s.method", "query_id", "vec_id", "s.score", "t")


def _per_query(spark, sf) -> DataFrame:
    return V.retention_curve(_evaluation(spark, sf), ["method", "query_id"], "score", "vec_id", "t", FRACTIONS)


def ranking_stats_by_retention(spark, sf):
    stats = ("recall", "purity", "max_recall", "recall_efficiency")
    return _per_query(spark, sf).select("method", "query_id", "retention", "pool_size", "k", "hits", "total_true", *[r6(F.col(c)).alias(c) for c in stats])


def _rounded_groups(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return rows.select(*keys, "n", *[r6(F.col(c)).alias(c) for c in columns])


def group_summary(spark, sf):
    found = V.group_summary(_per_query(spark, sf), ["method", "retention"], "recall")
    return _rounded_groups(found, ["method", "retention"], ["mean", "sd", "median", "p95"])


def pivot_methods(spark, sf):
    wide = V.pivot_methods(_per_query(spark, sf), ["query_id", "retention"], "recall", METHODS)
    return wide.select("query_id", "retention", *[r6(F.col(m)).alias(m) for m in METHODS])


def paired_delta(spark, sf):
    delta = V.paired_delta(_per_query(spark, sf), ["query_id", "retention"], "recall", "dense")
    return delta.select("query_id", "retention", "method", r6(F.col("delta")).alias("delta"))


def prevalence_depth(spark, sf):
    rows = cut(_per_query(spark, sf)).where("retention = 0.2").withColumns({"prevalence": F.col("total_true") / F.col("pool_size"), "depth": F.lit(1)})
    found = V.prevalence_depth(rows, ("program", "dense"), ["query_id"], "recall", "prevalence", "depth")
    return found.select("quartile", "depth", "n", r6(F.col("mean")).alias("mean"), r6(F.col("sd")).alias("sd"))


def bootstrap_ci(spark, sf):
    return V.bootstrap_ci(_per_query(spark, sf), ["method", "retention"], "recall", n_boot=500)


def matched_frontier(spark, sf):
    """For each gate, the smallest multiplier whose recall is near that of the exact search."""
    rows, gates, n = _gates(spark, sf)
    queries = _queries(spark, sf)
    multipliers = (0.5, 1.0, 2.0, 4.0)
    fetched = cut(_fetched(rows, queries, max(S.ask_size(f, 10, m, n) for f in gates for m in multipliers)))
    found = []
    for fraction, gate in gates.items():
        truth = cut(_gated(rows, queries, gate, 10))
        for m in multipliers:
            recall = S.recall(S.over_fetch(fetched, gate, fraction, 10, m, n), truth, queries).agg(F.avg("recall")).first()[0]
            found.append((fraction, m, round(recall, 9), 1.0))
    rows = spark.createDataFrame(found, "fraction double, cost double, recall double, live_recall double")
    best = V.matched_frontier(rows, ["fraction"])
    return best.select("fraction", F.col("cost").alias("multiplier"), r6(F.col("recall")).alias("recall"), "matched")


def _scored_labels(spark, sf):
    enc, programs = compiled(spark, sf)
    return coded(spark, sf, enc).select("vec_id", F.round(programs["label3"].raw(), 6).alias("score"), (F.col("label") == 3).cast("int").alias("y"))


def best_f1_threshold(spark, sf):
    return T.best_f1(_scored_labels(spark, sf), "score", "y").select(r6(F.col("threshold")).alias("threshold"), r6(F.col("f1")).alias("f1"))


def f1_at_zero(spark, sf):
    return T.f1_at(_scored_labels(spark, sf), "score", "y", 0.0).select("tp", "n", "total", r6(F.col("f1")).alias("f1"))


def average_precision(spark, sf):
    return T.average_precision(_scored_labels(spark, sf), "score", "y").select(r6(F.col("average_precision")).alias("average_precision"))


def _ordinals(spark, sf) -> tuple[DataFrame, int]:
    """(ordinal, vec_id): the places from 0 of all items in order of id, and their number."""
    ids = items(spark, sf).select("vec_id")
    placed = ids.orderBy("vec_id").rdd.zipWithIndex().map(lambda r: (r[1], r[0][0]))
    return spark.createDataFrame(placed, "ordinal bigint, vec_id bigint"), ids.count()


def geometry_corr(spark, sf):
    """Correlation of code agreement with exact similarity over pairs drawn from all items: each is the first of a pair,
    20,000 pairs at least."""
    places, n = _ordinals(spark, sf)
    places = cut(places)
    codes = items(spark, sf).select("vec_id", "embedding", *[c.alias(k) for k, c in E.code_columns(encoder(spark, sf)).items()]).join(places, "vec_id")
    mixed = (F.col("id") * 48271 + 11) % 2147483647
    pairs = spark.range(max(20_000, n)).select((F.col("id") % n).alias("i"), (mixed * mixed % 2147483647 % n).alias("j")).where("i <> j")
    a, b = codes.alias("a"), codes.alias("b")
    met = pairs.join(a, F.col("i") == F.col("a.ordinal")).join(b, F.col("j") == F.col("b.ordinal"))
    exact = N.dot_columns(F.col("a.embedding"), F.col("b.embedding"))
    return met.select(exact.alias("x"), E.hamming_agreement(2, DIM).alias("y")).agg(F.count(F.lit(1)).alias("n"), r6(F.corr("x", "y")).alias("corr"))


def candidate_scores(spark, sf):
    """A bag that names every item three times."""
    enc, programs = compiled(spark, sf)
    places, n = _ordinals(spark, sf)
    bag = spark.range(3 * n).select(F.col("id").alias("pos"), (F.col("id") % n).alias("ordinal")).join(places, "ordinal").select("pos", "vec_id")
    scored = SemanticExecutor(coded(spark, sf, enc), enc, programs).score_candidates(bag, ("label1", "label2"))
    return scored.select("pos", "vec_id", r6(F.col("score")).alias("score"))


def tiled_codes(spark, sf):
    """All items' codes, 2.6 times over."""
    places, n = _ordinals(spark, sf)
    codes = coded(spark, sf, encoder(spark, sf)).join(places, "vec_id").select("ordinal", "vec_id", "w0", "pop")
    return S.tile(codes, "ordinal", n, n * 13 // 5).select("tile_id", "vec_id", "w0", "pop")


def latency_stats(spark, sf):
    return V.latency_stats(table(spark, sf, "events"), ["event_type"], "value").select("event_type", "n", r6(F.col("median")).alias("median"), r6(F.col("p95")).alias("p95"))


# -- fits -----------------------------------------------------------------------------------------------------------


def trained_head(spark, sf):
    h = T.linear_head(items(spark, sf), F.col("label") == 3, "label3")
    return items(spark, sf).select("vec_id", P.exact_linear(h).alias("score"))


def calibrated_program(spark, sf):
    """A predicate fitted, compiled and calibrated from labels, and its probability for each item."""
    enc = encoder(spark, sf)
    codes = coded(spark, sf, enc)
    run = SemanticExecutor(codes, enc, {})
    rows = items(spark, sf).withColumn("y", (F.col("label") == 3).cast("int"))
    return codes.select("vec_id", N.sigmoid(run.fit_predicate(rows, "y", "label3").logit()).alias("p"))


def neural_ceiling(spark, sf):
    from pyspark.ml.functions import array_to_vector

    model = T.ceiling(items(spark, sf), F.col("label") == 3, "embedding", DIM, hidden=8)
    rows = items(spark, sf).select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    return model.transform(rows).select("vec_id", F.col("prediction").cast("int").alias("predicted"))


# -- catalog and sets -----------------------------------------------------------------------------------------------


def exact_filter_candidates(spark, sf):
    rows = S.facets(items(spark, sf), table(spark, sf, "part"), "vec_id", "p_partkey", FACETS)
    return catalog.exact_filter_candidates(rows, list(FACETS), ["type"], min_count=20)


def query_specs(spark, sf):
    rows = S.facets(items(spark, sf), table(spark, sf, "part"), "vec_id", "p_partkey", FACETS)
    concepts = {f"axis{i}": N.component("embedding", i) > 0 for i in range(6)}
    rows = rows.select("vec_id", *FACETS, *[c.alias(n) for n, c in concepts.items()])
    return catalog.query_benchmark(rows, list(FACETS), ["type"], list(concepts), 12, 7, min_truth=20)


def split_strict(spark, sf):
    return catalog.split(items(spark, sf), "vec_id").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def split_stratified(spark, sf):
    return catalog.stratified_split(items(spark, sf), "vec_id", "label").groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


def concept_counts(spark, sf):
    return items(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "label")))


def truth_mask(spark, sf):
    """AND of wanted and unwanted labels, over a second source of labels."""
    return table(spark, sf, "labels").where(M.truth_mask([F.col("quality") == 1], [F.col("toxic") == 1])).select("doc_id")


def concept_candidates(spark, sf):
    rows = S.facets(items(spark, sf), table(spark, sf, "part"), "vec_id", "p_partkey", FACETS)
    found = M.concept_candidates(rows, list(FACETS), min_count=5, low=0.01)
    return found.select("field", "value", "n", r6(F.col("prevalence")).alias("prevalence"))


def conjunction_counts(spark, sf):
    axes = {f"axis{i}": N.component("embedding", i) > 0 for i in range(6)}
    return M.conjunction_counts(items(spark, sf), axes).select(F.array_join("concepts", "+").alias("concepts"), "n")


def ordered_distinct(spark, sf):
    """The roles of each conversation in the order in which they come in."""
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("t"))
    roles = M.ordered_distinct(F.transform("t", lambda x: x["role"]))
    return turns.select("conv_id", F.array_join(roles, ",").alias("roles"), M.fields_overlap(roles, F.array(F.lit("system"), F.lit("tool"))).alias("special"))


def box_intersection(spark, sf):
    """Share of the coordinates in which an item is inside the boxes of two classes, one of them open on one side."""
    coded_rows = cut(_codes4(spark, sf).select("vec_id", "label", "codes"))
    mean = {r["coord"]: r["m"] for r in coded_rows.select(F.posexplode("codes").alias("coord", "q")).groupBy("coord").agg(F.avg("q").alias("m")).collect()}
    boxes = []
    for label in (3, 7):
        found = L.box(coded_rows, "codes", DIM, F.col("label") == label, 0.1, 0.9)
        boxes.append({r["coord"]: (r["lo"], r["hi"]) for r in found.collect()})
    own = {r["coord"]: r["m"] for r in coded_rows.where("label = 7").select(F.posexplode("codes").alias("coord", "q")).groupBy("coord").agg(F.avg("q").alias("m")).collect()}
    both, empty = M.intersect(boxes[0], M.one_sided(boxes[1], own, mean))
    return coded_rows.select("vec_id", r6(M.share_inside("codes", both)).alias("inside"), F.lit(len(empty)).alias("n_empty"))


def code_distance(spark, sf):
    """Each item's code against that of the next item in order of id."""
    places, n = _ordinals(spark, sf)
    codes = cut(_codes4(spark, sf).select("vec_id", "codes").join(places, "vec_id"))
    after = codes.select((F.col("ordinal") - 1).alias("ordinal"), F.col("codes").alias("other"))
    return codes.join(after, "ordinal").select("vec_id", r6(M.negative_mean_l1("codes", "other")).alias("score"))


def method_table(spark, sf):
    """Mean recall of each method beside what an item of it takes; a method without a footprint stays."""
    named = F.when(F.col("method") == "dense", "dense").when(F.col("method") == "linear", "fp32_linear").when(F.col("method") == "program", "binary1_ls2_int4")
    summary = V.group_summary(_per_query(spark, sf).where("retention = 0.2"), ["method"], "recall").withColumn("representation", named)
    sizes = storage_table(spark, 5_000_000, 100_000).select(F.col("method").alias("representation"), "item_bytes")
    return V.beside(summary, sizes, on=["representation"]).select("method", "n", r6(F.col("mean")).alias("mean"), "item_bytes")


def fixed_oversample(spark, sf):
    """Filter after fetching eight times as many as are wanted, whatever the gate."""
    rows, gates, n = _gates(spark, sf)
    queries = _queries(spark, sf)
    found = S.over_fetch(cut(_fetched(rows, queries, 80)), gates[0.2], 1.0, 10, 8.0, n)
    return S.recall(found, cut(_gated(rows, queries, gates[0.2], 10)), queries).select("query_id", "hits", "n_truth", r6(F.col("recall")).alias("recall"))


def exact_sample(spark, sf):
    """A seeded sample of an exact size."""
    rows = items(spark, sf)
    return catalog.sample_exact(rows, "vec_id", rows.count() // 3).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("vec_id").alias("n_ids"))


def raw_vectors(spark, sf):
    """Vectors through the bytes of a raw file's rows and back."""
    back = F.pandas_udf(lambda rows: rows.map(lambda x: np.frombuffer(x, "<f4")), "array<float>")
    rows = items(spark, sf).select("vec_id", A.raw_bytes("embedding").alias("raw"))
    return rows.select("vec_id", F.posexplode(back("raw")).alias("pos", "x")).select("vec_id", "pos", r6(F.col("x").cast("double")).alias("x"))


def substrate_codes(spark, sf):
    """The whole preparation in one call: quantile codes without whitening or projection."""
    made = B.build_substrate(items(spark, sf), dim=DIM)
    return items(spark, sf).select("vec_id", F.posexplode(made.codes()).alias("pos", "code"))


def storage(spark, sf):
    out = storage_table(spark, 5_000_000, 100_000)
    return out.select("method", "item_bytes", "program_bytes", "shared_bytes", "total_bytes", r6(F.col("total_mb")).alias("total_mb"))


def set_operations(spark, sf):
    """Union, intersection and difference of two dense results, as bags and as sets."""
    scores = S.dense_scores(items(spark, sf), S.query_vectors(items(spark, sf), (0, 20)))
    a = S.ranked(scores.where("query_id = 0"), ["query_id"], "dense", "vec_id", 100).select("vec_id")
    b = S.ranked(scores.where("query_id = 20"), ["query_id"], "dense", "vec_id", 100).select("vec_id")
    parts = {"union_all": a.unionAll(b), "union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.exceptAll(b)}
    out = None
    for name, rows in parts.items():
        one = rows.select(F.lit(name).alias("kind"), "vec_id")
        out = one if out is None else out.union(one)
    return out


def result_parity(spark, sf):
    """Whether two plans give the same items for each query: the gate before, and after the dense order."""
    rows, gates, n = _gates(spark, sf)
    queries = _queries(spark, sf)
    live = _gated(rows, queries, gates[0.2], 10)
    after = S.over_fetch(_fetched(rows, queries, S.ask_size(0.2, 10, 100.0, n)), gates[0.2], 0.2, 10, 100.0, n)
    return G.same_ids(live, after)


def query_mentions(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", mentions("text", "the").alias("has_the"), mentions("text", "de la").alias("has_de_la"))


# -- graph and streams ----------------------------------------------------------------------------------------------


def _graph_items(spark, sf) -> tuple[DataFrame, G.LiveGate, float]:
    """Items with their codes and semantic scores, the same score as a live gate, and a gate for a fifth of all."""
    enc, programs = compiled(spark, sf)
    live = G.LiveGate((programs["label3"], programs["label7"]), (1, -1))
    score = C.mean_log_probability([p.logit() for p in live.programs], live.signs)
    rows = items(spark, sf).select("vec_id", "embedding", *[c.alias(n) for n, c in E.code_columns(enc).items()])
    rows = cut(rows.withColumn("semantic", score))
    # Just below the limit, so that rounding can't tell the two ways of scoring apart.
    gate = rows.agg(F.percentile("semantic", 0.8).alias("g")).first()["g"]
    return rows, live, (gate or 0.0) - 1e-9


def graph_search(spark, sf):
    """Live: the gate is worked out from the codes of the items that the search comes to."""
    rows, live, gate = _graph_items(spark, sf)
    return G.filtered_search(rows, cut(G.build_graph(rows, 16)), _queries(spark, sf), gate, k=10, ef=128, semantic=live)


def graph_parity(spark, sf):
    """Whether the live and the materialised search find the same items."""
    rows, live, gate = _graph_items(spark, sf)
    edges, queries = cut(G.build_graph(rows, 16)), _queries(spark, sf)
    return G.same_ids(*(G.filtered_search(rows, edges, queries, gate, k=10, ef=128, semantic=s) for s in (live, "semantic")))


def graph_recall(spark, sf):
    """Whether the graph finds nine in ten of the exact gated top-k, plainly and over bridges."""
    rows, _, gate = _graph_items(spark, sf)
    edges, queries = cut(G.build_graph(rows, 16)), _queries(spark, sf)
    truth = cut(_gated(rows, queries, gate, 10))
    out = None
    for bridges in (0, 4):
        found = G.filtered_search(rows, edges, queries, gate, k=10, ef=128, bridges=bridges)
        one = S.recall(found, truth, queries).agg(F.count(F.lit(1)).alias("n"), (F.avg("recall") >= 0.9).alias("good")).select(F.lit(bridges).alias("bridges"), "n", "good")
        out = one if out is None else out.union(one)
    return out


def knn_graph(spark, sf):
    return G.knn_graph(items(spark, sf), 8)


def graph_hops(spark, sf):
    """What each query's item reaches over two links."""
    frontier = _queries(spark, sf).select(F.col("query_id").alias("src"))
    return G.two_hops(cut(G.knn_graph(items(spark, sf), 4)), frontier)


def stream_encode(spark, sf):
    """A stream of items encoded under the frozen encoder, read back when it has caught up."""
    import uuid

    from facetrank.sources.session import shared_folder

    enc = encoder(spark, sf)
    source = spark.readStream.schema(items(spark, sf).schema).parquet(f"{sf}/embeddings.parque[t]")
    out = stream.encode_stream(source, enc).drop("label")
    place = f"{shared_folder(spark)}/facetrank/stream-{uuid.uuid4().hex}"
    stream.write_codes(out, f"{place}/codes", f"{place}/log").awaitTermination()
    return spark.read.parquet(f"{place}/codes").select("vec_id", "w0", "w1", "pop", r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"))


def event_windows(spark, sf):
    return stream.tumbling(table(spark, sf, "events")).select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


def event_sessions(spark, sf):
    return stream.sessions(table(spark, sf, "events"), "6 hours")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        encoder_centroid, item_codes, packed_codes, norm_check, normalised, sign_codes, rotated_codes, whitened, centroid_head, program_int4, program_planes, program_scalars, raw_score,
        fused_scores, exact_linear, signed_logprob, mean_logprob, softmin, composition_rules, zero_shot, semantic_topk, early_exit_topk, dense_topk,
        dense_pool_exact_filter, facet_counts, gate_table, gated_truth_topk, overfetch_recall, uniform_codes, quantile_codes, bin_centroids, packed_small_codes,
        columnar_codes, pq_codes, pq_adc, pq_trained, code_histograms, llr_stats, llr_empirical_bayes, llr_program_score, newton_round1, boosted_lut, box_predicate, bitmask_predicate,
        ranking_stats_by_retention, group_summary, pivot_methods, paired_delta, prevalence_depth, bootstrap_ci, matched_frontier, best_f1_threshold, f1_at_zero, average_precision,
        concept_candidates, conjunction_counts, ordered_distinct, box_intersection, code_distance, method_table, fixed_oversample, exact_sample, raw_vectors, substrate_codes,
        candidate_scores, label_threshold, tiled_codes, geometry_corr, latency_stats, trained_head, calibrated_program, neural_ceiling, exact_filter_candidates, query_specs, split_strict, split_stratified, concept_counts, truth_mask,
        storage, set_operations, result_parity, query_mentions, graph_search, graph_parity, graph_recall, knn_graph, graph_hops, stream_encode, event_windows, event_sessions,
    )
}
QUERIES["semantic_topk_negated"] = partial(semantic_topk, positive=(), negative=("label7", "label2"))
QUERIES["pair_lut"] = partial(boosted_lut, pairs=3)
