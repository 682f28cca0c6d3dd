"""Scalar and product quantisers, their tables, and packed small codes.

Edges and centroids are per coordinate, so their size is dimensions times bins; they are fitted in distributed aggregates
over all rows and are literals in the encoding projection.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetrank.functions.numeric import constant, let, lit, sum_of, vector
from facetrank.sources.session import prepare


#: Bits of a value that a round of :func:`quantiles` tells apart: the first round, and those that follow.
FIRST_BITS, MORE_BITS = 16, 8
#: As soon as so few values are left, they are told apart altogether; the driver then gets 20 bytes of each.
LAST_VALUES = 500_000
#: Values that a task works on at a time.
VALUES_BLOCK = 1 << 19


def _keys(x: np.ndarray) -> np.ndarray:
    """Whole numbers of 64 bits in the order of the doubles ``x``: both zeros are one, and NaN is above all."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _values(keys: np.ndarray) -> np.ndarray:
    return np.where(keys >> np.uint64(63), keys & np.uint64((1 << 63) - 1), ~keys).view(np.float64)


def _components(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(coordinates, values) of the vectors in the first column, without nulls."""
    step = max(1, VALUES_BLOCK // dim)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            lists = batch.column(0).slice(at, step).drop_null()
            sizes, flat = pc.list_value_length(lists).to_numpy(), lists.flatten()
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            some = flat.is_valid().to_numpy(zero_copy_only=False) & (place < dim)
            yield place[some], flat.to_numpy(zero_copy_only=False)[some]


def _digits(rows: DataFrame, dim: int, coords: np.ndarray, prefixes: np.ndarray, bits: int, left: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, digit, n) in order: of the values of coordinate coords[slot] whose key starts with prefixes[slot], how many
    have each value of the next ``bits`` bits, after which ``left`` are left. Slots are in order of their coordinates."""
    first = np.searchsorted(coords, np.arange(dim + 1))
    slot_of = np.full((dim, max(1, int(np.diff(first).max()))), -1)
    slot_of[coords, np.arange(len(coords)) - first[coords]] = np.arange(len(coords))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.uint64((1 << bits) - 1)
        for place, x in _components(batches, dim):
            keys = _keys(x)
            start, digit = keys >> np.uint64(left + bits - 1) >> np.uint64(1), (keys >> np.uint64(left) & mask).astype(np.int64)
            for slots in slot_of.T:
                slot = slots[place]
                hit = (slot >= 0) & (prefixes[slot] == start)
                slot, d, n = slot[hit], digit[hit], np.ones(int(hit.sum()), np.int64)
                if bits <= FIRST_BITS:
                    cell, n = np.unique(slot << bits | d, return_counts=True)
                    slot, d = cell >> bits, cell & int(mask)
                yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(d), pa.array(n.astype(np.int64))], names=["slot", "digit", "n"])

    found = rows.mapInArrow(run, "slot int, digit bigint, n bigint").groupBy("slot", "digit").agg(F.sum("n").alias("n")).toArrow()
    slot, digit, n = (found.column(c).to_numpy() for c in ("slot", "digit", "n"))
    order = np.lexsort((digit, slot))
    return slot[order], digit[order], n[order]


def quantiles(items: DataFrame, embedding: str, dim: int, at: Sequence[float]) -> list[list[float]]:
    """Linear-interpolation quantiles of each coordinate, exact over all rows; nulls don't count, and a coordinate without
    values has NaN.

    The values of the wanted ranks are found digit by digit, in the order of the doubles: a round counts the next digit of
    the values that share what is known of a wanted one. Tasks send counts, so none holds the values of a coordinate. A
    round reads the items once; there were three for 3,076,920 rows of 64 dimensions, and there are seven at most, whatever
    the values are.
    """
    prepare(items.sparkSession)
    rows = items.select(vector(embedding).alias("v"))
    coords, prefixes, bits, left = np.arange(dim), np.zeros(dim, np.uint64), FIRST_BITS, 64
    there, slots = None, None
    while left:
        left -= bits
        slot, digit, n = _digits(rows, dim, coords, prefixes, bits, left)
        until = np.cumsum(n)
        before = np.concatenate([[0], until])[np.searchsorted(slot, np.arange(len(coords)))]
        if there is None:  # the ranks that are wanted, now that each coordinate's number of values is known
            count = np.bincount(slot, n, dim).astype(np.int64)
            there = np.flatnonzero(count)
            if not len(there):
                break
            exact = (count[there, None] - 1) * np.asarray(at, float)
            low, high = np.floor(exact), np.ceil(exact)
            ranks = np.stack([low, high], axis=2).astype(np.int64).ravel()
            slots = np.repeat(there, 2 * len(at))
        ranks = before[slots] + ranks
        cell = np.searchsorted(until, ranks, side="right")
        ranks = ranks - (until - n)[cell]
        some, slots = np.unique(cell, return_inverse=True)
        coords, prefixes = coords[slot[some]], prefixes[slot[some]] << np.uint64(bits) | digit[some].astype(np.uint64)
        bits = left if n[some].sum() <= LAST_VALUES else min(MORE_BITS, left)
    out = np.full((dim, len(at)), np.nan)
    if len(there):
        lo, hi = np.moveaxis(_values(prefixes[slots]).reshape(len(there), len(at), 2), 2, 0)
        with np.errstate(invalid="ignore"):
            out[there] = np.where((low == high) | (lo == hi), lo, (high - exact) * lo + (exact - low) * hi)
    return out.tolist()


def uniform_codes(vector: Column | str, limits: Sequence[Sequence[float]], bits: int) -> Column:
    """Each component clipped to its (low, high) and rounded to 2**bits even steps."""
    top = lit((1 << bits) - 1)
    column = F.col(vector) if isinstance(vector, str) else vector
    spans = constant([{"low": lo, "high": hi, "width": max(hi - lo, 1e-12)} for lo, hi in limits], "array<struct<low: double, high: double, width: double>>")

    def code(x: Column, s: Column) -> Column:
        inside = F.least(F.greatest(x.cast("double"), s["low"]), s["high"])
        return F.rint((inside - s["low"]) / s["width"] * top).cast("int")

    return F.zip_with(column, spans, code)


def quantile_edges(items: DataFrame, embedding: str, dim: int, bits: int) -> list[list[float]]:
    levels = 1 << bits
    return quantiles(items, embedding, dim, [k / levels for k in range(1, levels)])


def quantile_codes(vector: Column | str, edges: Sequence[Sequence[float]]) -> Column:
    """The number of edges that are at most the component."""
    column = F.col(vector) if isinstance(vector, str) else vector
    return F.zip_with(column, constant([list(e) for e in edges], "array<array<double>>"), lambda x, row: F.size(F.filter(row, lambda e: e <= x.cast("double"))))


def bin_centroids(coded: DataFrame, embedding: str, codes: str, dim: int, bins: int) -> DataFrame:
    """(coord, bin, centroid): mean of what fell into each bin; an empty bin has its coordinate's mean."""
    pairs = F.arrays_zip(F.transform(F.col(embedding), lambda x: x.cast("double")).alias("z"), F.col(codes).alias("q"))
    long = coded.select(F.posexplode(pairs).alias("coord", "p")).select("coord", F.col("p.q").alias("bin"), F.col("p.z").alias("z"))
    sums = long.groupBy("coord", "bin").agg(F.sum("z").alias("s"), F.count(F.lit(1)).alias("n"))
    spark = coded.sparkSession
    grid = spark.range(dim).withColumnRenamed("id", "coord").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    mean = sums.groupBy("coord").agg((F.sum("s") / F.sum("n")).alias("mean"))
    return grid.join(sums, ["coord", "bin"], "left").join(mean, "coord").select(F.col("coord").cast("int"), "bin", F.coalesce(F.col("s") / F.col("n"), "mean").alias("centroid"))


def pack(codes: Column, count: int, bits: int) -> Column:
    """Small codes side by side in 62-bit words (array of bigint), the first in the lowest bits."""
    per, zero = 62 // bits, F.lit(0).cast("bigint")

    def word(at: int) -> Column:
        some = F.transform(F.slice(codes, at + 1, min(per, count - at)), lambda c, i: F.call_function("shiftleft", c.cast("bigint"), i * bits))
        return F.aggregate(some, zero, lambda acc, x: acc + x)

    return F.array(*[word(at) for at in range(0, count, per)])


def unpack(packed: Column, count: int, bits: int) -> Column:
    """The codes of :func:`pack` as an array again."""
    per = 62 // bits
    each = F.transform(packed, lambda word: F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda i: F.call_function("shiftright", word, i * bits).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")))
    return F.slice(F.flatten(each), 1, count)


def columnar(coded: DataFrame, item: str, codes: str) -> DataFrame:
    """(coord, item, code): the coordinate-major layout of item-major codes."""
    return coded.select(F.posexplode(codes).alias("coord", "code"), F.col(item).alias("item")).select("coord", "item", "code")


def int16_table(values: Column, scale: int = 1024) -> Column:
    """Table entries as 16-bit whole numbers, half away from zero."""
    return F.transform(values, lambda v: F.least(F.greatest(F.round(v * scale), lit(-32768)), lit(32767)).cast("smallint"))


# -- product quantisation -------------------------------------------------------------------------------------------


def frozen_codebook(items: DataFrame, embedding: str, dim: int, parts: int, size: int, order: str) -> np.ndarray:
    """[parts, size, width]: sub-vectors of the first ``size`` rows by ``order``, a codebook that needs no training."""
    rows = items.orderBy(order).select(embedding).limit(size).collect()  # ``size`` rows
    return np.array([r[0] for r in rows], float).reshape(len(rows), parts, dim // parts).transpose(1, 0, 2)


def train_codebook(items: DataFrame, embedding: str, dim: int, parts: int, size: int, seed: int = 7, rounds: int = 10) -> np.ndarray:
    """k-means in each part, by the library's distributed implementation."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    width, book = dim // parts, []
    for m in range(parts):
        sub = items.select(array_to_vector(F.transform(F.slice(embedding, m * width + 1, width), lambda x: x.cast("double"))).alias("features"))
        centres = KMeans(k=size, seed=seed + m, maxIter=rounds, initMode="random").fit(sub).clusterCenters()
        book.append([*centres, *[centres[-1]] * (size - len(centres))])
    return np.array(book)


def pq_codes(vector: Column | str, codebook: np.ndarray) -> Column:
    """The nearest centroid of each part, the first of equally near ones."""
    column = F.col(vector) if isinstance(vector, str) else vector
    width = codebook.shape[2]
    book = constant(codebook.tolist(), "array<array<array<double>>>")

    def nearest(part: Column, m: Column) -> Column:
        mine = F.slice(column, m * width + 1, F.lit(width))
        far = F.transform(part, lambda centre: sum_of(F.zip_with(mine, centre, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))))
        return let(far, lambda d: F.array_position(d, F.array_min(d)) - 1).cast("int")

    return F.transform(book, nearest)


def pq_table(weights: Sequence[float], codebook: np.ndarray) -> np.ndarray:
    """[parts, size]: what each centroid adds to a linear score."""
    w = np.asarray(weights, float).reshape(codebook.shape[0], 1, codebook.shape[2])
    return (codebook * w).sum(axis=2)


def pq_score(codes: Column, table: np.ndarray, intercept: float) -> Column:
    return lit(intercept) + sum_of(F.zip_with(constant(table.tolist(), "array<array<double>>"), codes, lambda row, c: F.get(row, c)))
