"""Item encoders: centred sign bits in 32-bit lanes with two least-squares levels per item, and projections.

An encoder is fitted once in one aggregate over the fit sample (a mean per dimension); encoding is a projection of each
row by itself, without a shuffle, and so the same for a batch, an append or a stream.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetrank.functions.numeric import component, constant, lit, norm, sum_of, total

LANE = 32


@dataclass(frozen=True)
class Encoder:
    """The frozen transform: an optional rotation, then the centroid."""

    centroid: tuple[float, ...]
    projection: tuple[tuple[float, ...], ...] | None = None
    generation: str = "g1"
    seed: int = 7
    extra: dict = field(default_factory=dict, compare=False)

    @property
    def dim(self) -> int:
        return len(self.centroid)

    @property
    def lanes(self) -> int:
        return -(-self.dim // LANE)

    @property
    def packed_bytes(self) -> int:
        return -(-self.dim // 8)

    @property
    def item_bytes(self) -> float:
        """Sign bits and two 4-byte levels."""
        return float(self.packed_bytes + 8)


def dimension(items: DataFrame, embedding: str = "embedding") -> int:
    row = items.select(F.size(embedding).alias("n")).where("n > 0").first()
    if row is None:
        raise ValueError("no vectors to take the dimension from")
    return row["n"]


def centroid(items: DataFrame, embedding: str = "embedding", dim: int | None = None) -> DataFrame:
    """(pos, centroid): the mean of each dimension; one pass, one partial row per task."""
    dim = dim or dimension(items, embedding)
    means = items.agg(F.array(*[F.avg(component(embedding, i)) for i in range(dim)]).alias("c"))
    return means.select(F.posexplode("c").alias("pos", "centroid"))


def random_rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix: the Q of a Gaussian matrix, with signs fixed so that it is uniform."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def random_dictionary(dim: int, size: int, seed: int = 7) -> np.ndarray:
    """Independent random unit columns."""
    m = np.random.default_rng(seed).standard_normal((dim, size))
    return m / np.linalg.norm(m, axis=0)


def covariance(items: DataFrame, embedding: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """(mean, covariance) of the vectors; the driver gets dimension squared numbers."""
    dim = dimension(items, embedding)
    first = [F.avg(component(embedding, i)) for i in range(dim)]
    mean = np.array(items.agg(F.array(*first).alias("m")).first()["m"])
    pairs = items.select(F.transform(F.col(embedding), lambda x: x.cast("double")).alias("v"))
    left = pairs.select(F.posexplode("v").alias("i", "x"), "v")
    sums = left.groupBy("i").agg(F.array(*[F.avg(F.col("x") * F.get("v", F.lit(j))) for j in range(dim)]).alias("row"))
    second = np.zeros((dim, dim))
    for r in sums.collect():  # one row a dimension
        second[r["i"]] = r["row"]
    return mean, second - np.outer(mean, mean)


def pca_rotation(items: DataFrame, embedding: str = "embedding") -> np.ndarray:
    """Eigenvectors of the covariance, largest eigenvalue first."""
    return np.linalg.eigh(covariance(items, embedding)[1])[1][:, ::-1]


def power_whitener(items: DataFrame, gamma: float, embedding: str = "embedding", eps_ratio: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(mean, matrix): eigenvalues to the power -gamma/2, floored at eps_ratio of the largest."""
    mean, cov = covariance(items, embedding)
    values, vectors = np.linalg.eigh(cov)
    values = np.maximum(values, values.max() * eps_ratio + 1e-12)
    return mean, vectors * values ** (-gamma / 2)


def project(vector: Column | str, matrix: np.ndarray, mean: np.ndarray | None = None) -> Column:
    """vector @ matrix (after subtracting a mean) as an array column."""
    column = F.col(vector) if isinstance(vector, str) else vector
    shift = -(mean @ matrix) if mean is not None else np.zeros(matrix.shape[1])
    rows = constant([{"w": matrix[:, j].tolist(), "s": float(shift[j])} for j in range(matrix.shape[1])], "array<struct<w: array<double>, s: double>>")
    return F.transform(rows, lambda r: sum_of(F.zip_with(column, r["w"], lambda a, b: a.cast("double") * b)) + r["s"])


def whiten(vector: Column | str, mean: np.ndarray, matrix: np.ndarray, renormalise: bool = True) -> Column:
    out = project(vector, matrix, mean)
    length = F.greatest(norm(out), lit(1e-12))
    return F.transform(out, lambda x: x / length) if renormalise else out


def fit_encoder(items: DataFrame, embedding: str = "embedding", projection: np.ndarray | None = None, generation: str = "g1", seed: int = 7) -> Encoder:
    """Centroid of the (rotated) fit sample."""
    if projection is not None:
        items = items.select(project(embedding, projection).alias(embedding))
    rows = centroid(items, embedding).orderBy("pos").collect()  # one row a dimension
    rotation = None if projection is None else tuple(map(tuple, projection.tolist()))
    return Encoder(tuple(r["centroid"] for r in rows), rotation, generation, seed)


def code_columns(encoder: Encoder, embedding: Column | str = "embedding") -> dict[str, Column]:
    """w0.. (lanes of sign bits), pop, lo and hi of a vector, as columns of the row itself.

    A bit is set where the residual is strictly positive; lo and hi are the means of the other and of these residuals,
    0 where there are none.
    """
    vector = F.col(embedding) if isinstance(embedding, str) else embedding
    if encoder.projection is not None:
        vector = project(vector, np.array(encoder.projection))
    rest = F.zip_with(vector, constant(list(encoder.centroid)), lambda x, c: x.cast("double") - c)
    zero = F.lit(0).cast("bigint")
    out = {}
    for lane in range(encoder.lanes):
        part = F.slice(rest, lane * LANE + 1, LANE)
        bits = F.transform(part, lambda r, i: F.when(r > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(zero))
        out[f"w{lane}"] = F.aggregate(bits, zero, lambda acc, x: acc + x)
    pop = F.aggregate(rest, zero, lambda acc, r: acc + F.when(r > 0, 1).otherwise(0))
    above = F.aggregate(rest, lit(0), lambda acc, r: acc + F.greatest(r, lit(0)))
    below = F.aggregate(rest, lit(0), lambda acc, r: acc + F.least(r, lit(0)))
    out["pop"] = pop
    out["lo"] = F.coalesce(F.try_divide(below, (F.lit(encoder.dim) - pop).cast("double")), lit(0))
    out["hi"] = F.coalesce(F.try_divide(above, pop.cast("double")), lit(0))
    return out


def encode(items: DataFrame, encoder: Encoder, embedding: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """The code of each row beside the columns named (all but the vector by default)."""
    names = [c for c in items.columns if c != embedding] if keep is None else keep
    return items.select(*names, *[c.alias(n) for n, c in code_columns(encoder, embedding).items()])


def packed_hex(encoder: Encoder) -> Column:
    """The sign bits as bytes, bit j of byte b for dimension 8b + j, in hexadecimal."""
    octets = []
    for b in range(encoder.packed_bytes):
        octet = F.shiftright(F.col(f"w{b * 8 // LANE}"), b * 8 % LANE).bitwiseAND(F.lit(255))
        octets.append(F.lpad(F.lower(F.hex(octet)), 2, "0"))
    return F.concat(*octets)


def sign_codes(vector: Column | str, dim: int) -> Column:
    """One-bit codes of another kind: 1 where the component itself is 0 or more."""
    column = F.col(vector) if isinstance(vector, str) else vector
    return F.transform(F.slice(column, 1, dim), lambda x: (x >= 0).cast("int"))


def norm_check(items: DataFrame, embedding: str = "embedding") -> DataFrame:
    """One row: n, least, mean and greatest length, and the greatest distance of a length from 1."""
    n = norm(embedding)
    return items.select(n.alias("n")).agg(
        F.count(F.lit(1)).alias("n_items"), F.min("n").alias("min_norm"), F.avg("n").alias("mean_norm"), F.max("n").alias("max_norm"), F.max(F.abs(F.col("n") - 1)).alias("max_error")
    )


def assert_unit_norm(items: DataFrame, embedding: str = "embedding", tolerance: float = 2e-3) -> DataFrame:
    row = norm_check(items, embedding).first()
    if row["max_error"] is not None and row["max_error"] > tolerance:
        raise ValueError(f"vectors are not of unit length: off by {row['max_error']:.3g}")
    return items


def hamming_agreement(lanes: int, dim: int, left: str = "a", right: str = "b") -> Column:
    """Share of sign bits that two codes have in common."""
    apart = total([F.bit_count(F.col(f"{left}.w{i}").bitwiseXOR(F.col(f"{right}.w{i}"))) for i in range(lanes)])
    return 1 - apart / F.lit(dim)
