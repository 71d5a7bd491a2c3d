"""Scalar column helpers shared by the operators. Undefined results are NULL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def softplus(x: Column) -> Column:
    """log(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def logit(p: Column, eps: float = 1e-6) -> Column:
    clipped = F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))
    return F.log(clipped / (1.0 - clipped))


def zscore(x: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / std; a constant or undefined spread gives 0."""
    return F.when(std > 0.0, (x - mean) / std).otherwise(F.lit(0.0))


def binary_entropy(p: Column, eps: float = 1e-7) -> Column:
    """Entropy in bits of a Bernoulli(p), p clipped away from 0 and 1."""
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))
    return -(q * F.log2(q) + (1.0 - q) * F.log2(1.0 - q))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def guarded_ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den)


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def array_mean(a: Column) -> Column:
    return array_sum(a) / F.size(a)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where a lambda uses it for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def array_std(a: Column) -> Column:
    """Population standard deviation of a short array."""
    return bind(array_mean(a), lambda m: F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m)) / F.size(a)))


def softmax(a: Column) -> Column:
    def shares(e: Column) -> Column:
        return bind(array_sum(e), lambda total: F.transform(e, lambda x: x / total))

    return bind(bind(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp(x - top))), shares)


def dcf(pmiss: Column, pfa: Column, prior: float) -> Column:
    """Detection cost with unit costs, normalised by the cheaper trivial system."""
    return (F.lit(prior) * pmiss + F.lit(1.0 - prior) * pfa) / F.lit(min(prior, 1.0 - prior))


def bayes_threshold(prior: float) -> float:
    return math.log((1.0 - prior) / prior)


NO_PART = "\x00null"


def hash_key(*parts, sep: str = "\x1f") -> Column:
    """sha256 hex of the parts joined by a separator; equal in Python and SQL.

    A NULL part counts as the text ``NO_PART``, so it is not skipped.
    """
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.sha2(F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit(NO_PART)) for c in cols]), 256)


def hash_number(hex_key: Column, digits: int = 8) -> Column:
    """Leading hex digits of a hash as a non-negative bigint (digits <= 15)."""
    return F.conv(F.substring(hex_key, 1, digits), 16, 10).cast("bigint")
