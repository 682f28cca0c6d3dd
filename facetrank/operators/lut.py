"""Lookup-table programs over small codes: log-likelihood-ratio factors, boosted tables, pair tables.

Histograms are one distributed aggregate over (coordinate, bin). The boosted fit is sequential by nature and works on one
concept's sample in one Python group per concept, so concepts are fitted in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetrank.functions.numeric import constant, let, lit, sum_of
from facetrank.sources.session import prepare

#: Labelled rows of a concept that a boosted fit learns from.
MAX_ROWS = 200_000


def histograms(coded: DataFrame, codes: str, label: str, dim: int, bins: int) -> DataFrame:
    """(coord, bin, pos, neg) over the full grid of coordinates and bins."""
    y = F.col(label).cast("bigint")
    long = coded.select(F.posexplode(codes).alias("coord", "bin"), y.alias("y"))
    counts = long.groupBy("coord", "bin").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    grid = coded.sparkSession.range(dim).select(F.col("id").cast("int").alias("coord"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    zero = F.lit(0).cast("bigint")
    return grid.join(counts, ["coord", "bin"], "left").select("coord", "bin", F.coalesce("pos", zero).alias("pos"), F.coalesce("neg", zero).alias("neg"))


def llr_stats(counts: DataFrame, bins: int, alpha: float = 1.0, tau: float | None = None) -> DataFrame:
    """(coord, bin, llr, strength, mi) from histograms.

    Laplace smoothing with ``alpha``, or empirical-Bayes smoothing where ``tau`` is given: ``tau`` pseudo-counts are
    spread as the coordinate's own marginal is. Strength is the divergence of the two distributions in both directions, mi
    what a bin says of a label that is as often 1 as 0.
    """
    w = Window.partitionBy("coord")
    rows = counts.withColumns({"n1": F.sum("pos").over(w), "n0": F.sum("neg").over(w), "m": F.col("pos") + F.col("neg")})
    n = F.col("n1") + F.col("n0")
    if tau is None:
        p1, p0 = (F.col("pos") + alpha) / (F.col("n1") + alpha * bins), (F.col("neg") + alpha) / (F.col("n0") + alpha * bins)
    else:
        prior = (F.col("m") + alpha) / (n + alpha * bins)
        p1, p0 = (F.col("pos") + tau * prior) / (F.col("n1") + tau), (F.col("neg") + tau * prior) / (F.col("n0") + tau)
    rows = rows.withColumns({"p1": p1, "p0": p0}).withColumn("llr", F.log(F.col("p1") / F.col("p0")))
    both = F.col("p1") + F.col("p0")
    part = F.col("p1") * F.log(2 * F.col("p1") / both) + F.col("p0") * F.log(2 * F.col("p0") / both)
    return rows.select("coord", "bin", "llr", F.sum((F.col("p1") - F.col("p0")) * F.col("llr")).over(w).alias("strength"), (F.sum(part).over(w) / 2).alias("mi"))


def strongest(stats: DataFrame, k: int) -> DataFrame:
    """The rows of the k coordinates of the greatest strength."""
    best = stats.select("coord", "strength").distinct().orderBy(F.desc("strength"), "coord").limit(k).select("coord")
    return stats.join(best, "coord", "left_semi")


def prior_logit(coded: DataFrame, label: str) -> float:
    row = coded.agg(F.sum(F.col(label).cast("double")).alias("s"), F.count(F.lit(1)).alias("n")).first()
    p = ((row["s"] or 0.0) + 0.5) / (row["n"] + 1)
    return float(np.log(p / (1 - p)))


def tables(stats: DataFrame) -> dict[int, list[float]]:
    """Coordinate -> entries by bin; a program of a few coordinates."""
    out: dict[int, list[float]] = {}
    for r in stats.orderBy("coord", "bin").select("coord", "bin", "llr").collect():  # coordinates times bins
        out.setdefault(r["coord"], []).append(r["llr"])
    return out


def table_score(codes: Column | str, entries: dict[int, Sequence[float]], intercept: float) -> Column:
    """intercept plus one looked-up entry a coordinate."""
    column = F.col(codes) if isinstance(codes, str) else codes
    rows = constant([{"j": j, "row": list(row)} for j, row in entries.items()], "array<struct<j: int, row: array<double>>>")
    return lit(intercept) + let(column, lambda q: sum_of(F.transform(rows, lambda t: F.get(t["row"], F.get(q, t["j"])))))


def add_tables(*programs: dict[int, Sequence[float]]) -> dict[int, list[float]]:
    """Composition of programs by adding their tables, coordinate by coordinate."""
    out: dict[int, np.ndarray] = {}
    for program in programs:
        for j, row in program.items():
            out[j] = out.get(j, 0) + np.asarray(row, float)
    return {j: row.tolist() for j, row in sorted(out.items())}


def newton_round(coded: DataFrame, codes: str, label: str, margin: Column, l2: float = 6.0) -> DataFrame:
    """(coord, bin, step, gain): the Newton step of each bin at the present margin, and each coordinate's gain."""
    p = 1 / (1 + F.exp(-margin))
    long = coded.select(F.posexplode(codes).alias("coord", "bin"), (F.col(label).cast("double") - p).alias("g"), (p * (1 - p)).alias("h"))
    sums = long.groupBy("coord", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    gain = F.sum(F.col("g") * F.col("g") / (F.col("h") + l2)).over(Window.partitionBy("coord")) / 2
    return sums.select("coord", "bin", (F.col("g") / (F.col("h") + l2)).alias("step"), gain.alias("gain"))


class _Cells:
    """Sums over the bins of several code columns at once: column c's bin b is cell c * bins + b."""

    def __init__(self, columns: np.ndarray, bins: int):
        self.n, self.bins = columns.shape[1], bins
        self.cell = (columns + np.arange(self.n) * bins).ravel()

    def sums(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.cell, np.repeat(weights, self.n), self.n * self.bins).reshape(self.n, self.bins)

    def steps(self, g: np.ndarray, h: np.ndarray, l2: float) -> tuple[np.ndarray, np.ndarray]:
        """Newton steps of all bins, and the gain of each column."""
        gs, hs = self.sums(g), self.sums(h) + l2
        return gs / hs, (gs * gs / hs).sum(axis=1) / 2


def _slopes(y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    e = np.exp(-np.abs(margin))
    p = np.clip(np.where(margin >= 0, 1, e) / (1 + e), 1e-6, 1 - 1e-6)
    return y - p, p * (1 - p)


def _divergence(codes: np.ndarray, y: np.ndarray, bins: int) -> np.ndarray:
    """Strength of each coordinate as in :func:`llr_stats`, with ``bins`` pseudo-counts."""
    cells = _Cells(codes, bins)
    one, zero = cells.sums(y), cells.sums(1 - y)
    prior = (one + zero + 1) / ((one + zero).sum(axis=1, keepdims=True) + bins)
    p1, p0 = ((x + bins * prior) / (x.sum(axis=1, keepdims=True) + bins) for x in (one, zero))
    return ((p1 - p0) * np.log(p1 / p0)).sum(axis=1)


def boost(codes: np.ndarray, y: np.ndarray, *, k: int, bins: int, pool: int = 128, l2: float = 6.0, rate: float = 0.55, refine: int = 1, pairs: int = 0, pair_pool: int = 16, pair_l2: float = 10.0, pair_rate: float = 0.5) -> tuple[float, list[tuple]]:
    """(intercept, terms): tables chosen greedily by gain, each then fitted afresh beside the others, then pair tables.

    Candidates are the ``pool`` coordinates of the greatest strength; a chosen table is damped by ``rate``, a refitted one
    is not. Pairs are of the first ``pair_pool`` coordinates chosen. A term is (coordinate, -1, entries) or (coordinate,
    coordinate, entries of the joint bin q1 * bins + q2). Of equal gains the first candidate goes.
    """
    start = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    margin = np.full(len(y), start)
    pool_of = np.argsort(-_divergence(codes, y, bins), kind="stable")[:pool]
    cells, left = _Cells(codes[:, pool_of], bins), np.ones(len(pool_of), bool)
    order: list[int] = []
    entries: dict[int, np.ndarray] = {}
    for _ in range(min(k, len(pool_of))):
        steps, gains = cells.steps(*_slopes(y, margin), l2)
        at = int(np.argmax(np.where(left, gains, -np.inf)))
        left[at] = False
        j = int(pool_of[at])
        order.append(j)
        entries[j] = rate * steps[at]
        margin += entries[j][codes[:, j]]
    for j in order * refine:
        margin -= entries[j][codes[:, j]]
        entries[j] = _Cells(codes[:, [j]], bins).steps(*_slopes(y, margin), l2)[0][0]
        margin += entries[j][codes[:, j]]
    terms: list[tuple] = [(j, -1, entries[j].tolist()) for j in order]
    candidates = list(combinations(order[:pair_pool], 2))
    if pairs and candidates:
        joint = np.stack([codes[:, a] * bins + codes[:, b] for a, b in candidates], axis=1)
        cells, left = _Cells(joint, bins * bins), np.ones(len(candidates), bool)
        for _ in range(min(pairs, len(candidates))):
            steps, gains = cells.steps(*_slopes(y, margin), pair_l2)
            at = int(np.argmax(np.where(left, gains, -np.inf)))
            left[at] = False
            row = pair_rate * steps[at]
            margin += row[joint[:, at]]
            terms.append((*candidates[at], row.tolist()))
    return float(start), terms


def fit_boosted(samples: DataFrame, *, concept: str = "concept", codes: str = "codes", label: str = "label", bins: int, k: int = 28, pairs: int = 0, max_rows: int = MAX_ROWS) -> DataFrame:
    """(concept, intercept, terms array<struct<coord, other, entries>>), one concept's sample a group.

    A fit learns from about ``max_rows`` labelled rows of a concept at most, drawn by a hash, so that a group fits in a
    task however large the table is. Scores are for all rows.
    """
    prepare(samples.sparkSession)
    schema = "concept string, intercept double, terms array<struct<coord:int, other:int, entries:array<double>>>"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id") if "id" in frame else frame
        start, terms = boost(np.stack(frame["codes"].to_numpy()).astype(int), frame["label"].to_numpy(float), k=k, bins=bins, pairs=pairs)
        return pd.DataFrame({"concept": [frame["concept"].iloc[0]], "intercept": [start], "terms": [[{"coord": a, "other": b, "entries": row} for a, b, row in terms]]})

    names = [F.col(concept).cast("string").alias("concept"), F.col(codes).alias("codes"), F.col(label).cast("int").alias("label")]
    extra = [F.col("id")] if "id" in samples.columns else []
    rows = samples.select(*names, *extra)
    counts = {r["concept"]: r["n"] for r in rows.groupBy("concept").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a concept
    drawn = F.lit(True)
    for name, n in counts.items():
        if n > max_rows:
            share = F.pmod(F.xxhash64(*(extra or [F.col("codes")]), F.lit(7)), F.lit(1 << 20)) < F.lit(int(max_rows / n * (1 << 20)))
            drawn = drawn & ((F.col("concept") != F.lit(name)) | share)
    return rows.where(drawn).groupBy("concept").applyInPandas(run, schema)


def boosted_score(codes: Column | str, intercept: float, terms: Sequence[tuple], bins: int) -> Column:
    column = F.col(codes) if isinstance(codes, str) else codes
    rows = constant([{"a": a, "b": b, "row": list(row)} for a, b, row in terms], "array<struct<a: int, b: int, row: array<double>>>")

    def entry(q: Column, t: Column) -> Column:
        first = F.get(q, t["a"])
        return F.get(t["row"], F.when(t["b"] < 0, first).otherwise(first * bins + F.get(q, t["b"])).cast("int"))

    return lit(intercept) + let(column, lambda q: sum_of(F.transform(rows, lambda t: entry(q, t))))


def box(coded: DataFrame, codes: str, dim: int, label: Column, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(coord, lo, hi): quantiles of the positives' codes, a hard box predicate."""
    row = coded.where(label).agg(F.array(*[F.percentile(F.get(F.col(codes), F.lit(i)), F.array(lit(low), lit(high))) for i in range(dim)]).alias("q"))
    return row.select(F.posexplode("q").alias("coord", "b")).select("coord", F.col("b")[0].alias("lo"), F.col("b")[1].alias("hi"))


def inside_share(codes: Column | str, boxes: Sequence[tuple[int, float, float]]) -> Column:
    """Share of a box's coordinates that a code is inside of."""
    column = F.col(codes) if isinstance(codes, str) else codes
    rows = constant([{"j": j, "lo": lo, "hi": hi} for j, lo, hi in boxes], "array<struct<j: int, lo: double, hi: double>>")
    inside = let(column, lambda q: sum_of(F.transform(rows, lambda t: F.get(q, t["j"]).between(t["lo"], t["hi"]).cast("double"))))
    return inside / F.lit(len(boxes))
