"""Predicates as masks and boxes, and the choice of concepts and fields that queries are made of."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetrank.functions.numeric import constant, let, lit, sum_of


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def truth_mask(positive: Sequence[Column | str] = (), negative: Sequence[Column | str] = ()) -> Column:
    """Whether all wanted labels hold and no unwanted one does; true without predicates. A label that isn't known
    doesn't hold."""
    terms = [F.coalesce(_column(c).cast("boolean"), F.lit(False)) for c in positive]
    terms += [~F.coalesce(_column(c).cast("boolean"), F.lit(False)) for c in negative]
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def with_truth(rows: DataFrame, by: Sequence[str], truth: str) -> DataFrame:
    """The rows of the groups in which something is true; a window that every task sums first isn't needed for a few
    groups, so their keys are joined."""
    some = rows.groupBy(*by).agg(F.sum(F.col(truth).cast("bigint")).alias("_n")).where("_n > 0").drop("_n")
    return rows.join(some, list(by), "left_semi")


def concept_candidates(items: DataFrame, fields: Sequence[str], *, min_count: int = 350, low: float = 0.025, high: float = 0.7, per_field: int = 4, total: int = 14, missing: str = "Unknown") -> DataFrame:
    """(field, value, n, prevalence): the values that can serve as concepts, frequent but not nearly everywhere, the most
    frequent ``per_field`` of a field and ``total`` in all."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    n_items = items.count()
    counts = items.select(each.alias("x")).select("x.*").where(F.col("value") != missing).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("prevalence", F.col("n") / F.lit(max(n_items, 1)))
    fit = counts.where((F.col("n") >= min_count) & F.col("prevalence").between(low, high))
    first = Window.partitionBy("field").orderBy(F.desc("n"), "value")
    few = fit.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= per_field).drop("_r")
    return few.orderBy(F.desc("n"), "field", "value").limit(total)


def conjunction_counts(items: DataFrame, concepts: Mapping[str, Column], sizes: Sequence[int] = (2, 3)) -> DataFrame:
    """(concepts, n): how many items have all of each two and three concepts, in one aggregate."""
    groups = [g for size in sizes for g in combinations(concepts, size)]
    counts = [F.count_if(truth_mask([concepts[c] for c in g])).alias(f"n{i}") for i, g in enumerate(groups)]
    rows = [F.struct(F.array(*map(F.lit, g)).alias("concepts"), F.col(f"n{i}").alias("n")) for i, g in enumerate(groups)]
    return items.agg(*counts).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def fields_overlap(left: Column | str, right: Column | str) -> Column:
    """Whether two sets of fields have one in common."""
    return F.coalesce(F.arrays_overlap(_column(left), _column(right)), F.lit(False))


def ordered_distinct(values: Column | str) -> Column:
    """The values of an array without repeats, each where it came first."""
    return F.array_distinct(_column(values))


Box = Mapping[int, tuple[float, float]]


def one_sided(box: Box, centre: Mapping[int, float], overall: Mapping[int, float]) -> dict[int, tuple[float, float]]:
    """A box of which each coordinate is bounded only on the side that faces all items: a class that lies above the
    overall mean keeps its lower bound, one below its upper bound."""
    inf = float("inf")
    return {j: (lo, inf) if centre[j] >= overall[j] else (-inf, hi) for j, (lo, hi) in box.items()}


def intersect(*boxes: Box) -> tuple[dict[int, tuple[float, float]], list[int]]:
    """(box that lies in all of them, coordinates in which nothing does)."""
    out: dict[int, tuple[float, float]] = {}
    for box in boxes:
        for j, (lo, hi) in box.items():
            a, b = out.get(j, (float("-inf"), float("inf")))
            out[j] = (max(a, lo), min(b, hi))
    return out, sorted(j for j, (lo, hi) in out.items() if lo > hi)


def share_inside(codes: Column | str, box: Box) -> Column:
    """Share of a box's coordinates that a code is inside of; 1 for a box without coordinates."""
    big = 1e300  # a literal can't hold infinity
    rows = constant([{"j": j, "lo": max(lo, -big), "hi": min(hi, big)} for j, (lo, hi) in box.items()], "array<struct<j: int, lo: double, hi: double>>")
    if not box:
        return lit(1)
    inside = let(_column(codes), lambda q: sum_of(F.transform(rows, lambda t: F.get(q, t["j"]).between(t["lo"], t["hi"]).cast("double"))))
    return inside / F.lit(len(box))


def negative_mean_l1(left: Column | str, right: Column | str) -> Column:
    """Minus the mean distance of two codes' entries: a stand-in for similarity."""
    apart = F.zip_with(_column(left), _column(right), lambda a, b: F.abs(a - b).cast("double"))
    return F.try_divide(-sum_of(apart), F.size(_column(left)).cast("double"))
