"""Composition of calibrated predicates: AND and NOT as sums of log probabilities, and the rules it is compared with."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetrank.functions.numeric import lit, log_sigmoid, total


def signed(logits: Sequence[Column], signs: Sequence[int]) -> list[Column]:
    return [z if s > 0 else -z for z, s in zip(logits, signs, strict=True)]


def log_probability(logits: Sequence[Column], signs: Sequence[int]) -> Column:
    """Sum of log sigmoid(sign * logit); 0 without predicates."""
    return total([log_sigmoid(z) for z in signed(logits, signs)])


def mean_log_probability(logits: Sequence[Column], signs: Sequence[int]) -> Column:
    """The sum over the number of predicates, so that one gate serves any number."""
    return log_probability(logits, signs) / F.lit(max(len(logits), 1))


def soft_min(logits: Sequence[Column], tau: float = 1.0) -> Column:
    """-tau log mean exp(-z / tau)."""
    tau = max(tau, 1e-8)
    scaled = [-z / lit(tau) for z in logits]
    top = F.greatest(*scaled) if len(scaled) > 1 else scaled[0]
    return -lit(tau) * (top + F.log(total([F.exp(s - top) for s in scaled]))) + lit(tau) * F.log(F.lit(float(len(scaled))))


def minimum(logits: Sequence[Column]) -> Column:
    return F.least(*logits) if len(logits) > 1 else logits[0]


def raw_sum(logits: Sequence[Column]) -> Column:
    return total(list(logits))


def navigation(dense: Column, semantic: Column, weight: float) -> Column:
    """A dense score helped by the semantic one (kept to show what it costs in recall)."""
    return dense + lit(weight) * semantic
