"""Compiled concept programs: int4 weights in bit planes, scored by population counts over item codes.

A program is a few hundred bytes, so it is compiled on the driver and becomes literals in a Column. Scoring many items
with many programs is then one projection inside generated code: no join, no shuffle, no Python.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetrank.functions.numeric import component, constant, lit, log_sigmoid, sum_of, total
from facetrank.operators.encode import LANE, Encoder

PLANES = 4
NAME = re.compile(r"[A-Za-z0-9_.-]+")


@dataclass(frozen=True)
class Head:
    """A linear decision: weights and intercept over the original dimensions."""

    name: str
    weights: tuple[float, ...]
    intercept: float


@dataclass(frozen=True)
class Program:
    name: str
    dim: int
    planes: tuple[tuple[int, ...], ...]
    weight_lo: float
    weight_scale: float
    base: float
    sum_w: float
    calibration_a: float = 1.0
    calibration_b: float = 0.0
    positive_rate: float = 0.5
    generation: str = "g1"

    @property
    def bytes(self) -> int:
        """Bit planes and six 4-byte scalars."""
        return PLANES * -(-self.dim // 8) + 24

    def raw(self) -> Column:
        """Approximate linear score from w0.., pop, lo and hi of the row."""
        counts = []
        for t, plane in enumerate(self.planes):
            hits = [F.bit_count(F.col(f"w{lane}").bitwiseAND(F.lit(mask))).cast("bigint") for lane, mask in enumerate(plane) if mask]
            if hits:
                counts.append(total(hits) * F.lit(1 << t))
        p = lit(self.weight_lo) * F.col("pop") + lit(self.weight_scale) * (total(counts) if counts else lit(0))
        return lit(self.base) + F.col("lo") * (lit(self.sum_w) - p) + F.col("hi") * p

    def logit(self) -> Column:
        return lit(self.calibration_a) * self.raw() + lit(self.calibration_b)

    def log_prob(self, positive: bool = True) -> Column:
        z = self.logit()
        return log_sigmoid(z if positive else -z)

    def acceptance(self, positive: bool = True) -> float:
        """Share of items that the predicate is expected to accept."""
        return self.positive_rate if positive else 1 - self.positive_rate

    def calibrated(self, a: float, b: float, positive_rate: float | None = None) -> Program:
        return replace(self, calibration_a=a, calibration_b=b, positive_rate=self.positive_rate if positive_rate is None else positive_rate)


def check_name(name: str) -> str:
    if not NAME.fullmatch(name):
        raise ValueError(f"a program's name has letters, digits, '_', '.' and '-' only: {name!r}")
    return name


def quantise_int4(weights: Sequence[float]) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(values 0..15, decoded weights, lowest weight, step)."""
    w = np.asarray(weights, float)
    low = float(w.min())
    scale = max(float(w.max()) - low, 1e-12) / 15
    q = np.clip(np.rint((w - low) / scale), 0, 15).astype(np.int64)
    return q, low + scale * q, low, scale


def bit_planes(q: np.ndarray) -> tuple[tuple[int, ...], ...]:
    """Four planes of 32-bit lanes: bit j of a lane is that bit of the value of its dimension j."""
    lanes = -(-len(q) // LANE)
    return tuple(tuple(sum(int(v >> t & 1) << j for j, v in enumerate(q[lane * LANE : (lane + 1) * LANE])) for lane in range(lanes)) for t in range(PLANES))


def compile_head(head: Head, encoder: Encoder) -> Program:
    """A linear head as a program over the encoder's codes (weights go through the same rotation as items)."""
    if len(head.weights) != encoder.dim:
        raise ValueError(f"{head.name}: {len(head.weights)} weights for {encoder.dim} dimensions")
    w = np.asarray(head.weights, float)
    if encoder.projection is not None:
        w = w @ np.array(encoder.projection)
    q, decoded, low, scale = quantise_int4(w)
    base = head.intercept + float(np.dot(np.array(encoder.centroid), decoded))
    return Program(check_name(head.name), encoder.dim, bit_planes(q), low, scale, base, float(decoded.sum()), generation=encoder.generation)


def centroid_head(items: DataFrame, label: str, value, name: str, embedding: str = "embedding", dim: int = 64) -> Head:
    """Difference of the means of a class and of the rest, with the threshold midway."""
    return centroid_heads(items, label, {name: value}, embedding, dim)[0]


def centroid_heads(items: DataFrame, label: str, values: dict[str, object], embedding: str = "embedding", dim: int = 64) -> list[Head]:
    """A head for each class named, from one aggregate by class (as many rows as there are classes)."""
    sums = items.groupBy(F.col(label).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(component(embedding, i)) for i in range(dim)]).alias("s"))
    rows = {r["k"]: (r["n"], np.array(r["s"])) for r in sums.collect()}  # one row a class
    n_all, all_sum = sum(n for n, _ in rows.values()), sum(s for _, s in rows.values())
    out = []
    for name, value in values.items():
        if value not in rows or rows[value][0] == n_all:
            raise ValueError(f"{name}: needs rows inside and outside the class")
        n, s = rows[value]
        inside, outside = s / n, (all_sum - s) / (n_all - n)
        w = inside - outside
        out.append(Head(name, tuple(w.tolist()), -float(np.dot(w, inside + outside)) / 2))
    return out


def exact_linear(head: Head, embedding: str = "embedding") -> Column:
    """The head's own score, over the vector."""
    from facetrank.functions.numeric import dot

    return dot(embedding, head.weights) + lit(head.intercept)


def decoded_linear(head: Head, encoder: Encoder, int4: bool = True) -> Column:
    """The same score from unpacked bits, as a check on the packed form: b + c.w + lo (sum w - P) + hi P."""
    w = np.asarray(head.weights, float)
    if encoder.projection is not None:
        w = w @ np.array(encoder.projection)
    if int4:
        w = quantise_int4(w)[1]
    lanes = F.array(*[F.col(f"w{i}") for i in range(encoder.lanes)])
    pairs = constant([{"i": i, "w": float(x)} for i, x in enumerate(w)], "array<struct<i: int, w: double>>")

    def bit(t: Column) -> Column:
        lane = F.get(lanes, F.floor(t["i"] / LANE).cast("int"))
        return F.call_function("shiftright", lane, t["i"] % LANE).bitwiseAND(F.lit(1)).cast("double") * t["w"]

    p = sum_of(F.transform(pairs, bit))
    return lit(head.intercept + float(np.dot(encoder.centroid, w))) + F.col("lo") * (lit(float(w.sum())) - p) + F.col("hi") * p
