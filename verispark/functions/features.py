"""Trial features: durations, model inputs by mode, fusion and expanded features."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import array_std, array_sum, softmax

# Feature column names.
QUALITY = ["qmf1", "qmf2", "qmf3", "qmf4_sum", "qmf4_diff"]
RELIABILITY = ["min_duration", "duration_ratio", "short_duration_risk"]
LANGUAGE = ["target"]

# The columns that join a single score in each feature mode.
SINGLE_MODES = {
    "c3_qmf": QUALITY,
    "c4_lang": LANGUAGE,
    "c5_reject": RELIABILITY,
    "c6_fusion": QUALITY + RELIABILITY + LANGUAGE,
    "c6_no_quality": RELIABILITY + LANGUAGE,
    "c6_no_language": QUALITY + RELIABILITY,
    "c6_no_reliability": QUALITY + LANGUAGE,
    "c6_score_only": [],
    "c7_2_binary": RELIABILITY + LANGUAGE,
    "c7_3_conf_reject": RELIABILITY + LANGUAGE,
}

# Fixed values: (use the scores, other columns) of each fusion mode.
FUSION_MODES = {
    "c10_full": (True, LANGUAGE + RELIABILITY),
    "c10_score_only": (True, []),
    "c10_no_language": (True, RELIABILITY),
    "c10_no_reliability": (True, LANGUAGE),
    "c10_language_only": (False, LANGUAGE),
    "c10_reliability_only": (False, RELIABILITY),
}


def feature_columns(mode: str, scores: Sequence[str]) -> list[str]:
    """Input columns of a mode: one score for the single-encoder modes, all for fusion."""
    if mode in SINGLE_MODES:
        if len(scores) != 1:
            raise ValueError(f"{mode} takes exactly one score column")
        return [*scores, *SINGLE_MODES[mode]]
    if mode in FUSION_MODES:
        with_scores, extra = FUSION_MODES[mode]
        return [*(scores if with_scores else []), *extra]
    raise ValueError(f"unknown feature mode: {mode}")


def duration_features(df: DataFrame, center: float | Column) -> DataFrame:
    """Eight duration columns; NULL unless both durations are positive.

    ``center`` is the reference duration of qmf3/qmf4.
    """
    e, t = F.col("enroll_duration_sec"), F.col("test_duration_sec")
    c = center if isinstance(center, Column) else F.lit(float(center))
    ok = (e > 0) & (t > 0) & ~F.isnan(e) & ~F.isnan(t)
    low = F.least(e, t)
    ratio, le, lt = F.log(e / t), F.log(e / c), F.log(t / c)
    values = {
        "min_duration": low,
        "duration_ratio": low / F.greatest(e, t),
        "short_duration_risk": 1.0 / F.sqrt(low),
        "qmf1": F.abs(ratio),
        "qmf2": ratio * ratio,
        "qmf3": le * lt,
        "qmf4_sum": (le + lt) * (le + lt),
        "qmf4_diff": -((le - lt) * (le - lt)),
    }
    return df.withColumns({name: F.when(ok, expr) for name, expr in values.items()})


def same_language_flag(df: DataFrame) -> DataFrame:
    """Wide-table ``target``: 1 for equal known languages, else 0."""
    return df.withColumn("target", (F.col("language_condition") == "same_language").cast("int"))


# --- score fusion features over an array column of per-encoder scores ----------


def z_array(scores: Column, mean: Column, std: Column) -> Column:
    """Per-encoder z-scores; a constant encoder is divided by 1."""
    safe = F.transform(std, lambda s: F.when(s > 0.0, s).otherwise(F.lit(1.0)))
    return F.zip_with(F.zip_with(scores, mean, lambda x, m: x - m), safe, lambda d, s: d / s)


def summary_features(z: Column, weights: Column) -> dict[str, Column]:
    return {
        "z_mean": array_sum(z) / F.size(z),
        "z_std": array_std(z),
        "z_max": F.array_max(z),
        "z_min": F.array_min(z),
        "z_range": F.array_max(z) - F.array_min(z),
        "z_weighted": array_sum(F.zip_with(z, weights, lambda x, w: x * w)),
    }


def entropy_features(z: Column, size: int, eps: float = 1e-12) -> dict[str, Column]:
    """Normalised softmax entropy, top-two margin and top probability."""
    p = F.transform(softmax(z), lambda x: F.least(F.greatest(x, F.lit(eps)), F.lit(1.0)))
    ordered = F.sort_array(p)
    return {
        "entropy": -array_sum(F.transform(p, lambda x: x * F.log(x))) / F.lit(math.log(size)),
        "top_margin": F.array_max(p) - F.get(ordered, F.lit(size - 2)),
        "max_prob": F.array_max(p),
    }


def rich_expand(df: DataFrame, scores: Sequence[str], meta: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Expanded feature columns of k scores and m metadata values (6+4 give 112).

    The features are a set of families, each a function of the row's scores ``s``,
    metadata ``m``, order statistics (ascending, ``up``) and mean.  Everything is a
    plain column expression, so the expansion stays one projection.
    """
    frame = df.withColumn("_up", F.array_sort(F.array(*scores)))
    frame = frame.withColumn("_mean", array_sum(F.col("_up")) / len(scores))
    row = _ScoreRow([F.col(c) for c in scores], [F.col(c) for c in meta], list(scores), list(meta))
    return frame.select(*keep, *[value.alias(name) for name, value in row.features().items()])


def rich_names(scores: Sequence[str], meta: Sequence[str]) -> list[str]:
    """Names of the features of ``rich_expand``, in its order."""
    return list(_MatrixRow(np.zeros((1, len(scores) + len(meta))), scores, meta).features())


def rich_matrix(x: np.ndarray, scores: Sequence[str], meta: Sequence[str]) -> np.ndarray:
    """``rich_expand`` of the rows of a matrix (its columns scores, then meta), inside a task."""
    found = _MatrixRow(x, scores, meta).features()
    out = np.empty((len(x), len(found)))
    for i, value in enumerate(found.values()):
        out[:, i] = value
    return out


class _ScoreRow:
    """Feature families of one trial, as {name: column}."""

    def __init__(self, s: list[Column], m: list[Column], score_names: list[str], meta_names: list[str]):
        self.s, self.m, self.names, self.meta = s, m, score_names, meta_names
        self.k, self.mean = len(s), F.col("_mean")

    def features(self) -> dict[str, Column]:
        families = [self.metadata(), self.order(), self.moments(), self.pairs(), self.inputs(), self.crossed()]
        return {name: value for family in families for name, value in family.items()}

    def up(self, i: int) -> Column:
        """i-th smallest score, from 0."""
        return F.get("_up", F.lit(i))

    def quantile(self, numerator: int, denominator: int) -> Column:
        """Linear interpolation at a fraction of the way from the smallest to the largest score."""
        below, part = divmod((self.k - 1) * numerator, denominator)
        here = self.up(below)
        return here if part == 0 else here * (1 - part / denominator) + self.up(below + 1) * (part / denominator)

    def inputs(self) -> dict[str, Column]:
        return {f"in_{n}": c for n, c in zip(self.names + self.meta, self.s + self.m)}

    def moments(self) -> dict[str, Column]:
        off = {f"centred_{n}": c - self.mean for n, c in zip(self.names, self.s)}
        return off | {"s_mean": self.mean, "s_std": self.spread()}

    def spread(self):
        squares = F.aggregate("_up", F.lit(0.0), lambda acc, x: acc + (x - self.mean) * (x - self.mean))
        return F.sqrt(squares / self.k)

    absolute = staticmethod(F.abs)

    def order(self) -> dict[str, Column]:
        k = self.k
        falling = [self.up(k - 1 - i) for i in range(k)]
        steps = [a - b for a, b in zip(falling, falling[1:])]
        return {
            **{f"desc{i}": c for i, c in enumerate(falling, 1)},
            **{f"gap{i}": c for i, c in enumerate(steps, 1)},
            **{f"top{i}": c for i, c in enumerate(falling[:3], 1)},
            "top_gap": steps[0] if steps else F.lit(0.0),
            "s_min": self.up(0),
            "s_max": self.up(k - 1),
            "s_range": self.up(k - 1) - self.up(0),
            "s_q25": self.quantile(1, 4),
            "s_median": self.quantile(1, 2),
            "s_q75": self.quantile(3, 4),
        }

    def pairs(self) -> dict[str, Column]:
        out = {}
        for (i, a), (j, b) in combinations(enumerate(self.s, 1), 2):
            out |= {f"prod{i}_{j}": a * b, f"diff{i}_{j}": a - b, f"absdiff{i}_{j}": self.absolute(a - b)}
        return out

    def crossed(self) -> dict[str, Column]:
        return {f"x_{n}_{w}": a * b for w, b in zip(self.meta, self.m) for n, a in zip(self.names, self.s)}

    def metadata(self) -> dict[str, Column]:
        return {f"sq_{n}": c * c for n, c in zip(self.meta, self.m)}


class _MatrixRow(_ScoreRow):
    """The same families of many trials at once, as arrays."""

    def __init__(self, x: np.ndarray, score_names: Sequence[str], meta_names: Sequence[str]):
        columns = list(np.ascontiguousarray(x.T))
        self.k, self.names, self.meta = len(score_names), list(score_names), list(meta_names)
        self.s, self.m = columns[: self.k], columns[self.k :]
        self._up = np.sort(np.array(self.s), axis=0)
        self.mean = sum(self._up) / self.k

    def up(self, i: int) -> np.ndarray:
        return self._up[i]

    def spread(self) -> np.ndarray:
        return np.sqrt(sum((v - self.mean) ** 2 for v in self._up) / self.k)

    absolute = staticmethod(np.abs)
