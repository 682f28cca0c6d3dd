"""Column arithmetic: stable logistic functions, vector products and rounding, all inside whole-stage codegen."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vectors up to this many dimensions are unrolled into generated code. Longer ones are one higher-order expression with
#: a folded constant, since unrolled sums of many programs outgrow the size of a generated method.
UNROLL = 16


def lit(x: float) -> Column:
    return F.lit(float(x))


def constant(values, kind: str = "array<double>") -> Column:
    """A nested literal in one expression, which the optimizer folds."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def vector(column: Column | str) -> Column:
    """An array column as doubles."""
    return F.transform(F.col(column) if isinstance(column, str) else column, lambda x: x.cast("double"))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sum_of(values: Column) -> Column:
    return F.aggregate(values, lit(0), lambda acc, x: acc + x)


def log_sigmoid(z: Column) -> Column:
    """log(1 / (1 + exp(-z))) without overflow on either side."""
    return F.least(z, lit(0)) - F.log1p(F.exp(-F.abs(z)))


def sigmoid(z: Column) -> Column:
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def logit(p: Column, eps: float = 1e-8) -> Column:
    p = clip(p, eps, 1 - eps)
    return F.log(p / (1 - p))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, lit(low)), lit(high))


def total(terms: Sequence[Column]) -> Column:
    return reduce(add, terms) if terms else lit(0)


def component(vector: Column | str, i: int) -> Column:
    return F.get(F.col(vector) if isinstance(vector, str) else vector, F.lit(i)).cast("double")


def dot(vector: Column | str, weights: Sequence[float]) -> Column:
    """Inner product of an array column with a vector known to the driver."""
    column = F.col(vector) if isinstance(vector, str) else vector
    if len(weights) <= UNROLL:
        return total([component(column, i) * lit(w) for i, w in enumerate(weights)])
    return sum_of(F.zip_with(column, constant([float(w) for w in weights]), lambda a, b: a.cast("double") * b))


def dot_columns(a: Column, b: Column) -> Column:
    """Inner product of two array columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), lit(0), lambda acc, x: acc + x)


def norm(vector: Column | str) -> Column:
    column = F.col(vector) if isinstance(vector, str) else vector
    return F.sqrt(F.aggregate(column, lit(0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalise(vector: Column | str, floor: float = 1e-12) -> Column:
    """A unit-length copy of an array column; lengths under ``floor`` count as ``floor``."""
    column = F.col(vector) if isinstance(vector, str) else vector
    length = F.greatest(norm(column), lit(floor))
    return F.transform(column, lambda x: x.cast("double") / length)


def normalised_distance(similarity: Column) -> Column:
    return 1 - clip(similarity, -1, 1)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def decimal_mb(n_bytes: Column) -> Column:
    return n_bytes.cast("double") / 1e6


def decimal_gb(n_bytes: Column) -> Column:
    return n_bytes.cast("double") / 1e9
