"""Pairwise vector scores over two ``array<double>`` columns.

``PAIRWISE`` maps a metric name to a builder of a column expression, so users
extend the registry with a plain function.  Larger values always mean "more
alike".  Cosine is NULL when either vector is (numerically) zero.

Per-utterance quantities (norms, unit vectors, projections) are computed with
the same helpers before the trial join, so each is paid once per utterance.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import array_sum, bind

TINY = 1e-12


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def scale(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x * k)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def unit(a: Column) -> Column:
    """Length-normalised vector, NULL for a zero vector."""
    return bind(norm(a), lambda n: F.when(n > TINY, F.transform(a, lambda x: x / n)))


def matvec(rows: Column, v: Column) -> Column:
    """Matrix (array of rows) times vector."""
    return F.transform(rows, lambda r: dot(r, v))


def centre_own(a: Column) -> Column:
    return bind(array_sum(a) / F.size(a), lambda m: F.transform(a, lambda x: x - m))


def cosine(a: Column, b: Column) -> Column:
    den = norm(a) * norm(b)
    return F.when(F.abs(den) > TINY, dot(a, b) / den)


def sq_l2(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l1(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def pearson(a: Column, b: Column) -> Column:
    return cosine(centre_own(a), centre_own(b))


def angular(a: Column, b: Column) -> Column:
    c = F.least(F.greatest(cosine(a, b), F.lit(-1.0)), F.lit(1.0))
    # least/greatest skip NULLs, so keep the undefined cosine undefined
    return F.when(cosine(a, b).isNotNull(), 1.0 - F.acos(c) / F.lit(math.pi))


def rbf(a: Column, b: Column, gamma: float = 1.0) -> Column:
    if not (math.isfinite(gamma) and gamma > 0.0):
        raise ValueError("rbf gamma must be positive and finite")
    return F.exp(-F.lit(gamma) * sq_l2(a, b))


def log_norm(a: Column) -> Column:
    return F.log(norm(a) + F.lit(TINY))


PAIRWISE: dict[str, Callable[[Column, Column], Column]] = {
    "cosine": cosine,
    "dot_raw": dot,
    "neg_l2_raw": lambda a, b: -F.sqrt(sq_l2(a, b)),
    "neg_sq_l2_raw": lambda a, b: -sq_l2(a, b),
    "neg_l1_raw": lambda a, b: -l1(a, b),
    "pearson_corr": pearson,
    "angular_similarity_diagnostic": angular,
    "rbf_similarity_diagnostic": rbf,
    "log_norm_enroll": lambda a, b: log_norm(a),
    "log_norm_test": lambda a, b: log_norm(b),
    "log_norm_product": lambda a, b: log_norm(a) + log_norm(b),
    "abs_log_norm_ratio": lambda a, b: F.abs(log_norm(a) - log_norm(b)),
    "min_log_norm": lambda a, b: F.least(log_norm(a), log_norm(b)),
    "max_log_norm": lambda a, b: F.greatest(log_norm(a), log_norm(b)),
}


def pairwise_scores(a: Column, b: Column, metrics, *, rbf_gamma: float = 1.0, prefix: str = "score_") -> list[Column]:
    """One aliased column per metric name; unknown names raise."""
    out = []
    for name in metrics:
        if name not in PAIRWISE:
            raise ValueError(f"unknown pairwise metric: {name}")
        expr = rbf(a, b, rbf_gamma) if name == "rbf_similarity_diagnostic" else PAIRWISE[name](a, b)
        out.append(expr.alias(prefix + name))
    return out


def pairwise_arrow(metrics, *, rbf_gamma: float = 1.0):
    """The same metrics as one Arrow pandas UDF returning a struct.

    For wide vectors and many metrics one batched numpy pass is cheaper than
    fourteen interpreted array expressions.
    """
    names = list(metrics)
    for name in names:
        if name not in PAIRWISE:
            raise ValueError(f"unknown pairwise metric: {name}")

    @F.pandas_udf(", ".join(f"`{n}` double" for n in names))
    def block(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        if len(left) == 0:
            return pd.DataFrame({n: pd.Series(dtype="float64") for n in names})
        a, b = np.stack(left.to_numpy()).astype(float), np.stack(right.to_numpy()).astype(float)
        na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        inner = np.einsum("ij,ij->i", a, b)
        gap = a - b
        sq = np.einsum("ij,ij->i", gap, gap)

        def ratio(top, den):
            ok = np.abs(den) > TINY
            return np.where(ok, top / np.where(ok, den, 1.0), np.nan)

        cos = ratio(inner, na * nb)
        ac, bc = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
        la, lb = np.log(na + TINY), np.log(nb + TINY)
        values = {
            "cosine": lambda: cos,
            "dot_raw": lambda: inner,
            "neg_l2_raw": lambda: -np.sqrt(sq),
            "neg_sq_l2_raw": lambda: -sq,
            "neg_l1_raw": lambda: -np.abs(gap).sum(axis=1),
            "pearson_corr": lambda: ratio(
                np.einsum("ij,ij->i", ac, bc), np.linalg.norm(ac, axis=1) * np.linalg.norm(bc, axis=1)
            ),
            "angular_similarity_diagnostic": lambda: 1.0 - np.arccos(np.clip(cos, -1.0, 1.0)) / np.pi,
            "rbf_similarity_diagnostic": lambda: np.exp(-rbf_gamma * sq),
            "log_norm_enroll": lambda: la,
            "log_norm_test": lambda: lb,
            "log_norm_product": lambda: la + lb,
            "abs_log_norm_ratio": lambda: np.abs(la - lb),
            "min_log_norm": lambda: np.minimum(la, lb),
            "max_log_norm": lambda: np.maximum(la, lb),
        }
        # object dtype keeps NaN out: an undefined score is NULL
        return pd.DataFrame({n: pd.Series(values[n]()).astype(object).where(lambda s: s.notna(), None) for n in names})

    return block
