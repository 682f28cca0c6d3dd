"""Trained heads, calibrators and thresholds."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetrank.functions.numeric import lit
from facetrank.operators.program import Head
from facetrank.sources.session import cut


def _vector(embedding: str) -> Column:
    return array_to_vector(F.transform(F.col(embedding), lambda x: x.cast("double")))


def linear_head(items: DataFrame, label: Column, name: str, embedding: str = "embedding", alpha: float = 1e-4) -> Head:
    """Logistic loss with balanced class weights and L2 penalty ``alpha``, by distributed L-BFGS."""
    rows = items.select(_vector(embedding).alias("features"), label.cast("double").alias("y"))
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) != 2:
        raise ValueError(f"{name}: the labels must have two classes")
    total = sum(n.values())
    rows = rows.withColumn("w", F.when(F.col("y") == 1, lit(total / (2 * n[1.0]))).otherwise(lit(total / (2 * n[0.0]))))
    model = LogisticRegression(featuresCol="features", labelCol="y", weightCol="w", regParam=alpha, standardization=False, maxIter=100).fit(rows)
    return Head(name, tuple(float(x) for x in model.coefficients), float(model.intercept))


def ceiling(items: DataFrame, label: Column, embedding: str, dim: int, hidden: int = 64, seed: int = 7):
    """A small neural network, as an upper mark for linear heads."""
    rows = items.select(_vector(embedding).alias("features"), label.cast("double").alias("label"))
    return MultilayerPerceptronClassifier(layers=[dim, hidden, 2], seed=seed, maxIter=60).fit(rows)


def calibrator(scored: DataFrame, score: str, label: Column, c: float = 1000.0) -> tuple[float, float]:
    """(a, b) of a * score + b; constant where the scores or the labels don't vary."""
    rows = scored.select(F.col(score).cast("double").alias("s"), label.cast("double").alias("y"))
    row = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"), F.stddev_pop("s").alias("sd")).first()
    n, p = row["n"], row["p"] or 0.0
    if n == 0 or p in (0.0, float(n)) or row["sd"] < 1e-12:
        rate = (p + 0.5) / (n + 1)
        return 0.0, float(np.log(rate / (1 - rate)))
    model = LogisticRegression(featuresCol="f", labelCol="y", regParam=1 / (c * n), standardization=False, maxIter=100)
    fitted = model.fit(rows.select(array_to_vector(F.array("s")).alias("f"), "y"))
    return float(fitted.coefficients[0]), float(fitted.intercept)


def quantile_labels(scored: DataFrame, score: str, fit: Column, prevalence: float = 0.4) -> DataFrame:
    """``scored`` with ``label``: whether a score reaches the fit sample's quantile 1 - prevalence (one number)."""
    limit = scored.where(fit).agg(F.percentile(score, lit(1 - prevalence)).alias("t")).first()["t"]
    return scored.withColumn("label", (F.col(score) >= lit(float("nan") if limit is None else limit)).cast("int"))


def threshold_curve(scored: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, threshold, tp, n, total, f1) at every distinct score: equal scores are taken together.

    Counts are summed by score first. Scores are then dealt by range, each range is summed by itself, and the sums of the
    ranges before are added, so no task sees all scores even where there is one group; the sums of ranges are one row for
    each group and range.
    """
    by = list(by)
    groups = scored.groupBy(*by, F.col(score).alias("threshold")).agg(F.sum(F.col(label).cast("bigint")).alias("p"), F.count(F.lit(1)).alias("c"))
    dealt = cut(groups.repartitionByRange(*map(F.col, by), F.desc("threshold")).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy(*by, "_part").agg(F.sum("p").alias("_p"), F.sum("c").alias("_c"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    ahead = sums.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_part").alias("_of"), F.coalesce(F.sum("_p").over(before), zero).alias("_ahead_p"), F.coalesce(F.sum("_c").over(before), zero).alias("_ahead_c"), F.sum("_p").over(Window.partitionBy(*by)).alias("total"))
    same = F.col("_part") == F.col("_of")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    run = Window.partitionBy(*by, "_part").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.join(ahead, same).select(*by, "threshold", "p", (F.sum("p").over(run) + F.col("_ahead_p")).alias("tp"), (F.sum("c").over(run) + F.col("_ahead_c")).alias("n"), "total")
    return rows.withColumn("f1", F.try_divide(2 * F.col("tp"), F.col("n") + F.col("total")))


def best_f1(scored: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, threshold, f1): the threshold of the greatest F1, the lowest one of equals; an aggregate, combined by tasks."""
    curve = threshold_curve(scored, score, label, by)
    best = F.max(F.struct("f1", (-F.col("threshold")).alias("low"))).alias("x")
    found = (curve.groupBy(*by) if by else curve).agg(best)
    return found.where("x IS NOT NULL").select(*by, (-F.col("x.low")).alias("threshold"), F.col("x.f1").alias("f1"))


def best_f1_on_grid(scored: DataFrame, score: str, label: str, points: int = 160, by: Sequence[str] = ()) -> DataFrame:
    """(by, threshold, f1) over ``points`` even steps between the least and the greatest score, the lowest one of equals:
    an approximation that needs no order, one count of each step."""
    by = list(by)
    ends = scored.groupBy(*by).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"), F.sum(F.col(label).cast("bigint")).alias("_total"))
    if by:
        rows = scored.join(ends, by)
    else:
        rows = scored.crossJoin(F.broadcast(ends))  # one row
    step = F.try_divide(F.col("_hi") - F.col("_lo"), lit(points - 1))
    # The last step that is at or under the score.
    at = F.greatest(F.lit(0), F.least(F.lit(points - 1), F.floor(F.coalesce(F.try_divide(F.col(score) - F.col("_lo"), step), lit(points - 1))))).cast("int")
    counts = rows.withColumn("_at", at).groupBy(*by, "_lo", "_hi", "_total", "_at").agg(F.sum(F.col(label).cast("bigint")).alias("p"), F.count(F.lit(1)).alias("c"))
    run = Window.partitionBy(*by).orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)  # ``points`` rows a group
    curve = counts.select(*by, (F.col("_lo") + F.col("_at") * F.coalesce(step, lit(0))).alias("threshold"), F.try_divide(2 * F.sum("p").over(run), F.sum("c").over(run) + F.col("_total")).alias("f1"))
    best = F.max(F.struct("f1", (-F.col("threshold")).alias("low"))).alias("x")
    found = (curve.groupBy(*by) if by else curve).agg(best)
    return found.where("x IS NOT NULL").select(*by, (-F.col("x.low")).alias("threshold"), F.col("x.f1").alias("f1"))


def average_precision(scored: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, average_precision): precision at each distinct score, weighted by the share of positives there."""
    curve = threshold_curve(scored, score, label, by)
    value = F.try_divide(F.sum(F.col("p") * F.col("tp") / F.col("n")), F.max("total").cast("double"))
    return (curve.groupBy(*by) if by else curve).agg(value.alias("average_precision"))


def f1_at(scored: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    hit = F.col(score) >= lit(threshold)
    y = F.col(label).cast("boolean")
    counts = scored.agg(F.count_if(hit & y).alias("tp"), F.count_if(hit).alias("n"), F.count_if(y).alias("total"))
    return counts.withColumn("f1", F.try_divide(2 * F.col("tp"), F.col("n") + F.col("total")))
