"""Whole preparations in one call: an encoder with its splits, a quantised substrate, and programs of tables to send."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetrank.functions.numeric import normalise
from facetrank.operators.encode import Encoder, encode, fit_encoder, power_whitener, project, random_dictionary, random_rotation, whiten
from facetrank.operators.quantize import bin_centroids, quantile_codes, quantile_edges, quantiles, uniform_codes


def encode_splits(items: DataFrame, split: str, *, embedding: str = "embedding", projection: np.ndarray | None = None, keep: Sequence[str] | None = None) -> tuple[Encoder, DataFrame]:
    """(encoder fitted on the rows whose ``split`` is fit, codes of all rows with their split)."""
    encoder = fit_encoder(items.where(F.col(split) == "fit"), embedding, projection)
    names = [c for c in items.columns if c != embedding] if keep is None else list(dict.fromkeys([*keep, split]))
    return encoder, encode(items, encoder, embedding, keep=names)


@dataclass(frozen=True)
class Substrate:
    """What turns a vector into small codes: whitening, projection, edges or limits, and the centroids of the bins."""

    whitening: tuple[np.ndarray, np.ndarray] | None
    projection: np.ndarray | None
    kind: str
    bits: int
    bounds: list[list[float]]
    centroids: np.ndarray

    def coordinates(self, embedding: Column | str = "embedding") -> Column:
        out = F.col(embedding) if isinstance(embedding, str) else embedding
        if self.whitening is not None:
            out = whiten(out, *self.whitening)
        return out if self.projection is None else project(out, self.projection)

    def codes(self, embedding: Column | str = "embedding") -> Column:
        z = self.coordinates(embedding)
        return quantile_codes(z, self.bounds) if self.kind == "quantile" else uniform_codes(z, self.bounds, self.bits)


def build_substrate(items: DataFrame, *, embedding: str = "embedding", dim: int, size: int | None = None, whitening: float | None = None, projection: str = "identity", kind: str = "quantile", bits: int = 2, seed: int = 7) -> Substrate:
    """Whitening (a power, if any), projection (identity, orthogonal or dictionary), quantiser (quantile or uniform) and
    centroids, each fitted on what the one before gives."""
    if projection not in ("identity", "orthogonal", "dictionary") or kind not in ("quantile", "uniform"):
        raise ValueError(f"no such projection or quantiser: {projection}, {kind}")
    size = dim if size is None else size
    if projection != "dictionary" and size != dim:
        raise ValueError("only a dictionary can have another number of coordinates than the vectors have dimensions")
    made = {"identity": lambda: None, "orthogonal": lambda: random_rotation(dim, seed), "dictionary": lambda: random_dictionary(dim, size, seed)}[projection]()
    white = None if whitening is None else power_whitener(items, whitening, embedding)
    bare = Substrate(white, made, kind, bits, [], np.empty(0))
    rows = items.select(bare.coordinates(embedding).alias("z"))
    bounds = quantile_edges(rows, "z", size, bits) if kind == "quantile" else quantiles(rows, "z", size, (0.005, 0.995))
    whole = Substrate(white, made, kind, bits, bounds, np.empty(0))
    coded = rows.withColumn("q", quantile_codes("z", bounds) if kind == "quantile" else uniform_codes("z", bounds, bits))
    centroids = np.zeros((size, 1 << bits))
    for r in bin_centroids(coded, "z", "q", size, 1 << bits).collect():  # coordinates times bins
        centroids[r["coord"], r["bin"]] = r["centroid"]
    return Substrate(whole.whitening, whole.projection, kind, bits, bounds, centroids)


def teacher_score(vector: Column | str, positive: np.ndarray, negative: np.ndarray) -> Column:
    """Similarity to the normalised mean of positive prompts less that to the normalised mean of negative ones."""
    from facetrank.functions.numeric import dot

    means = [np.asarray(x, float).mean(axis=0) for x in (positive, negative)]
    one, two = (m / max(np.linalg.norm(m), 1e-12) for m in means)
    unit = normalise(vector)
    return dot(unit, one.tolist()) - dot(unit, two.tolist())


def serialise_tables(fitted: DataFrame, unary: int = 24, pairs: int = 2) -> DataFrame:
    """``fitted`` boosted tables (concept, intercept, terms) as records of a fixed number of terms: (concept, intercept,
    coords, tables, pair_coords, pair_tables). Another number of terms is an error, raised when a row is read."""
    one = F.filter("terms", lambda t: t["other"] < 0)
    two = F.filter("terms", lambda t: t["other"] >= 0)
    right = (F.size(one) == unary) & (F.size(two) == pairs)
    checked = F.when(right, F.col("concept")).otherwise(F.raise_error(F.concat(F.lit("not the number of terms that is served: "), F.col("concept"))))
    return fitted.select(
        checked.alias("concept"), "intercept", F.transform(one, lambda t: t["coord"]).alias("coords"), F.transform(one, lambda t: t["entries"]).alias("tables"),
        F.transform(two, lambda t: F.struct(t["coord"].alias("a"), t["other"].alias("b"))).alias("pair_coords"), F.transform(two, lambda t: t["entries"]).alias("pair_tables"),
    )
