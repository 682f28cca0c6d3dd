"""Splits and compound-query benchmarks."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetrank.functions.parsing import query_text


#: One compound query a row: what it asks for, the text that says so, and how many fit items satisfy it.
BENCHMARK = "query_id string, text string, exact array<array<string>>, positive array<string>, negative array<string>, fit_truth bigint"
#: Fixed value: the share of queries that have a negated concept.
NEGATED_SHARE = 0.55


def split(items: DataFrame, item_id: str, seed: int = 7, test: float = 0.35, calibration: float = 0.2, strict: bool = True) -> DataFrame:
    """``items`` with ``split``: test, cal or fit, of exact sizes, by the order of a seeded hash.

    Not strict: calibration is the fit sample itself, so only test and fit are told apart. Ranks come from counts of
    hash ranges before the exact cut, so that no task orders the whole table.
    """
    h = F.xxhash64(item_id, F.lit(seed))
    n = items.count()
    n_test = -(-n * round(test * 10_000) // 10_000)
    n_cal = -(-(n - n_test) * round(calibration * 10_000) // 10_000) if strict else 0
    rows = items.withColumn("_h", h)
    lines = [_nth(rows, item_id, k) for k in (n_test, n_test + n_cal)]
    return rows.withColumn("split", F.when(_before(item_id, lines[0]), "test").when(_before(item_id, lines[1]), "cal").otherwise("fit")).drop("_h")


def _nth(rows: DataFrame, item_id: str, k: int):
    """The k-th (hash, id) in order, found by narrowing to one hash bucket; None for k = 0."""
    if k <= 0:
        return None
    counts = rows.groupBy(F.shiftright("_h", 48).alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy("b").collect()  # at most 65,536
    seen = 0
    for r in counts:
        if seen + r["n"] >= k:
            some = rows.where(F.shiftright("_h", 48) == r["b"]).select("_h", item_id).orderBy("_h", item_id).limit(k - seen).collect()
            return tuple(some[-1])
        seen += r["n"]
    return None


def _before(item_id: str, line: tuple | None) -> Column:
    """Whether a row comes up to a (hash, id) in order."""
    if line is None:
        return F.lit(False)
    return (F.col("_h") < F.lit(line[0])) | ((F.col("_h") == F.lit(line[0])) & (F.col(item_id) <= F.lit(line[1])))


def sample_exact(items: DataFrame, item_id: str, n: int, seed: int = 7) -> DataFrame:
    """``n`` items (or all), the first by the order of a seeded hash; the same ones for the same seed."""
    rows = items.withColumn("_h", F.xxhash64(item_id, F.lit(seed)))
    if n >= items.count():
        return items
    return rows.where(_before(item_id, _nth(rows, item_id, n))).drop("_h")


def stratified_split(items: DataFrame, item_id: str, label: str, seed: int = 7, share: float = 0.8) -> DataFrame:
    """``items`` with ``split``: fit or cal, the share taken within each label by the order of a seeded hash.

    Labels are classes, so few. The driver gets counts of hash ranges (65,536 a label at most) and then the hashes of the
    one range of each label in which the cut falls, so a label may hold most items.
    """
    rows = items.withColumns({"_h": F.xxhash64(item_id, F.lit(seed)), "_b": F.shiftright(F.xxhash64(item_id, F.lit(seed)), 48)})
    counts: dict[object, dict[int, int]] = {}
    for r in rows.groupBy(F.col(label).alias("label"), "_b").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r["label"], {})[r["_b"]] = r["n"]
    places = {}
    for value, ranges in counts.items():
        left = math.ceil(sum(ranges.values()) * share)
        for b in sorted(ranges):
            if left <= ranges[b]:
                places[value] = (b, left)
                break
            left -= ranges[b]
    lines: dict[object, tuple] = {}
    if places:
        here = F.lit(False)
        for value, (b, _) in places.items():
            here = here | (F.col(label).eqNullSafe(F.lit(value)) & (F.col("_b") == b))
        near: dict[object, list[tuple]] = {}
        for r in rows.where(here).select(F.col(label).alias("label"), "_h", F.col(item_id).alias("id")).collect():
            near.setdefault(r["label"], []).append((r["_h"], r["id"]))
        lines = {value: sorted(near[value])[left - 1] for value, (_, left) in places.items() if left > 0}
    first = F.lit(False)
    for value, line in lines.items():
        first = first | (F.col(label).eqNullSafe(F.lit(value)) & _before(item_id, line))
    return rows.withColumn("split", F.when(first, "fit").otherwise("cal")).drop("_h", "_b")


def exact_filter_candidates(items: DataFrame, fields: Sequence[str], anchors: Sequence[str], min_count: int = 200, missing: str = "Unknown") -> DataFrame:
    """(field1, value1, field2, value2, n): single facet values, and pairs of different facets of which one is an
    anchor, that at least ``min_count`` items have; a single value has nulls in the second place.

    All counts come from one pass with grouping sets; no item meets another.
    """
    pairs = [(a, b) for i, a in enumerate(fields) for b in fields[i + 1 :] if a in anchors or b in anchors]
    parts = [F.struct(F.lit(f).alias("field1"), F.col(f).alias("value1"), F.lit(None).cast("string").alias("field2"), F.lit(None).cast("string").alias("value2")) for f in fields]
    parts += [F.struct(F.lit(a).alias("field1"), F.col(a).alias("value1"), F.lit(b).alias("field2"), F.col(b).alias("value2")) for a, b in pairs]
    long = items.select(F.explode(F.array(*parts)).alias("p")).select("p.*").where(f"value1 <> '{missing}' AND (value2 IS NULL OR value2 <> '{missing}')")
    return long.groupBy("field1", "value1", "field2", "value2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def query_benchmark(items: DataFrame, fields: Sequence[str], anchors: Sequence[str], concepts: Sequence[str], n_queries: int, seed: int, min_truth: int = 100, max_positive: int = 3, negatives: bool = True, batch: int = 64) -> DataFrame:
    """Random compound queries that at least ``min_truth`` of the fit items satisfy; boolean columns hold the concepts.

    Proposals are drawn on the driver and counted in batches, each in one aggregate over the items.
    """
    rng = random.Random(seed)
    rows = exact_filter_candidates(items, fields, anchors, max(2 * min_truth, 1)).orderBy("field1", "value1", "field2", "value2").collect()
    exacts = [(), *[((r["field1"], r["value1"]),) + (((r["field2"], r["value2"]),) if r["field2"] else ()) for r in rows]]
    seen, out = set(), []
    for _ in range(max(200, n_queries * 10)):
        proposals = []
        for _ in range(batch):
            positive = tuple(sorted(rng.sample(list(concepts), rng.randint(1, min(max_positive, len(concepts))))))
            rest = [c for c in concepts if c not in positive]
            negative = (rng.choice(rest),) if negatives and rest and rng.random() < NEGATED_SHARE else ()
            spec = (rng.choice(exacts), positive, negative)
            if spec not in seen:
                seen.add(spec)
                proposals.append(spec)
        if not proposals:
            break
        counts = []
        for i, (exact, positive, negative) in enumerate(proposals):
            true = F.lit(True)
            for f, v in exact:
                true = true & (F.col(f) == F.lit(v))
            for c in positive:
                true = true & F.col(c)
            for c in negative:
                true = true & ~F.col(c)
            counts.append(F.count_if(true).alias(f"n{i}"))
        row = items.agg(*counts).first()
        for i, (exact, positive, negative) in enumerate(proposals):
            if row[f"n{i}"] >= min_truth and len(out) < n_queries:
                out.append((f"q{len(out):04d}", query_text(positive, exact, negative), [list(e) for e in exact], list(positive), list(negative), row[f"n{i}"]))
        if len(out) >= n_queries:
            return items.sparkSession.createDataFrame(out, BENCHMARK)
    raise RuntimeError(f"only {len(out)} valid queries: lower min_truth or n_queries")
