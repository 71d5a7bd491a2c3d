"""Fitted similarity backends.

A fit is one or two distributed passes that reduce utterances to d x d moment
matrices (partial sums per partition, then a keyed sum), followed by dense
algebra on matrices whose size depends only on the embedding width.  Scoring
transforms each utterance once and then joins the trials.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..functions.scalars import hash_key, hash_number
from .ranking import top_n_per_group
from .scoring import attach_sides, by_component, checked_sides, in_cells, known_missing, side_blocks, vector_bytes

FLOOR = 1e-5
MAX_DIM = 4096  # widest embedding whose d x d moments may be held on the driver


class BackendFitError(ValueError):
    """A backend cannot be fitted on the given data."""


@dataclass
class Backend:
    """A fitted backend: small dense arrays and a description."""

    metric: str
    mean: np.ndarray | None = None
    matrix: np.ndarray | None = None
    meta: dict[str, str] = field(default_factory=dict)
    status: str = "ok"


# --- fit data ------------------------------------------------------------------


def utterance_speakers(
    protocol: DataFrame, limit: DataFrame | None = None, *, max_utterances: int | None = None
) -> DataFrame:
    """Distinct (utterance, speaker) of both trial sides; a conflict raises."""
    sides = protocol.select(
        F.explode(
            F.array(
                F.struct(F.col("enroll_utt").alias("utterance"), F.col("enroll_speaker").alias("speaker")),
                F.struct(F.col("test_utt").alias("utterance"), F.col("test_speaker").alias("speaker")),
            )
        ).alias("x")
    ).select("x.*")
    sides = sides.filter(F.col("utterance").isNotNull() & F.col("speaker").isNotNull())
    if limit is not None:
        sides = sides.join(limit.select(F.col("speaker_id").alias("speaker")), "speaker", "left_semi")
    one = sides.groupBy("utterance").agg(F.min("speaker").alias("speaker"), F.max("speaker").alias("_other"))
    clash = F.raise_error(F.concat(F.lit("utterance has two speakers: "), F.col("utterance"))).cast("string")
    out = one.select(
        "utterance", F.when(F.col("speaker") == F.col("_other"), F.col("speaker")).otherwise(clash).alias("speaker")
    )
    return out.orderBy("speaker", "utterance").limit(max_utterances) if max_utterances else out


def fingerprint(column: str):
    """Order-free fingerprint of a set of texts: sums of sha256 slices.

    Merges across partitions, so a set of any size needs no collecting.
    """
    h = F.sha2(F.col(column), 256)
    parts = [F.sum(hash_number(F.substring(h, 1 + 12 * i, 12), 12).cast("decimal(38,0)")) for i in range(4)]
    return F.sha2(F.concat_ws(":", *[F.coalesce(p, F.lit(0)).cast("string") for p in parts]), 256)


def set_hash(df: DataFrame, column: str, name: str) -> DataFrame:
    """One row with the sha256 of a set of distinct texts, at any size.

    Texts are put into 4096 buckets by the first three hex digits of their sha256;
    a bucket's hash is that of its sorted texts' hashes, the set's hash that of its
    buckets' hashes in order (an empty bucket's is the empty text).  No task sees more
    than a bucket.
    """
    hashed = df.select(F.sha2(F.col(column), 256).alias("_h")).withColumn("_b", F.substring("_h", 1, 3))
    buckets = hashed.groupBy("_b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_h")), "\n"), 256).alias("_h"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_h"))), lambda x: F.concat(x["_b"], F.lit(":"), x["_h"])), "\n")
    return buckets.agg(F.sha2(listed, 256).alias(name))


def leakage_manifest(fit: DataFrame, test: DataFrame) -> DataFrame:
    """Speaker counts, set hashes, order-free fingerprints and overlap of fit and test speakers."""
    f, t = fit.select("speaker_id").distinct(), test.select("speaker_id").distinct()
    both = f.join(t, "speaker_id", "left_semi")

    def side(df: DataFrame, name: str) -> DataFrame:
        counts = df.agg(F.count(F.lit(1)).alias(f"{name}_speaker_count"), fingerprint("speaker_id").alias(f"{name}_fingerprint"))
        return counts.withColumn(f"{name}_speaker_hash", set_hash(df, "speaker_id", "h").scalar())

    preview = both.orderBy("speaker_id").limit(10).agg(
        F.array_join(F.array_sort(F.collect_list("speaker_id")), ",").alias("p")
    )
    counts_t = side(t, "test")
    return side(f, "fit").select(
        "*",
        *[counts_t.select(c).scalar().alias(c) for c in counts_t.columns],
        both.agg(F.count(F.lit(1))).scalar().alias("overlap_count"),
        preview.scalar().alias("overlap_preview"),
    )


def assert_no_leakage(fit: DataFrame, test: DataFrame) -> None:
    shared = fit.select("speaker_id").join(test.select("speaker_id"), "speaker_id", "left_semi").limit(1).collect()
    if shared:
        raise BackendFitError(f"fit speakers intersect test speakers, e.g. {shared[0].speaker_id}")


# --- moments -------------------------------------------------------------------


def mean_vectors(df: DataFrame, keys: Sequence[str], vec: str = "vec") -> DataFrame:
    """Element-wise mean per key with partial aggregation (no vectors collected)."""
    v = array_to_vector(F.col(vec))
    return df.groupBy(*keys).agg(
        vector_to_array(Summarizer.mean(v)).alias("mean"), F.count(F.lit(1)).alias("n")
    )


def global_mean(df: DataFrame, vec: str = "vec") -> np.ndarray:
    row = mean_vectors(df, [], vec).first()
    if row is None or row.n < 2:
        raise BackendFitError("too few fitting utterances")
    return np.asarray(row["mean"])


@dataclass
class Moments:
    n: int
    scatter: np.ndarray  # sum of x x^T
    fourth: float  # sum of |x|^4


def moments(df: DataFrame, vec: str = "vec", shift: np.ndarray | None = None, weight: str | None = None) -> Moments:
    """Scatter matrix of (x - shift), summed per partition and then per matrix row."""
    cols = [F.col(vec).alias("v"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = fourth = n = None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack(pdf["v"].to_numpy()).astype(float)
            x = x - shift if shift is not None else x
            w = pdf["w"].to_numpy()
            s = (x * w[:, None]).T @ x
            q = float(np.sum(w * np.sum(x * x, axis=1) ** 2))
            total, fourth, n = (s, q, len(x)) if total is None else (total + s, fourth + q, n + len(x))
        if total is not None:
            d = total.shape[0]
            yield pd.DataFrame({"i": range(d), "row": list(total), "fourth": [fourth] * d, "n": [n] * d})

    parts = df.select(*cols).mapInPandas(partial, "i int, row array<double>, fourth double, n bigint")
    summed = parts.groupBy("i").agg(
        vector_to_array(Summarizer.sum(array_to_vector(F.col("row")))).alias("row"),
        F.sum("fourth").alias("fourth"),
        F.sum("n").alias("n"),
    )
    rows = summed.orderBy("i").limit(MAX_DIM + 1).collect()  # one row per embedding dimension
    if not rows:
        raise BackendFitError("no fitting vectors")
    if len(rows) > MAX_DIM:
        raise BackendFitError("embedding too wide for a dense covariance")
    return Moments(int(rows[0].n), np.array([r.row for r in rows]), float(rows[0].fourth))


def covariance(m: Moments, method: str = "ledoit_wolf") -> tuple[np.ndarray, float]:
    """(covariance, shrinkage) of centred data from its moments."""
    s, d, n = m.scatter / m.n, m.scatter.shape[0], m.n
    mu = float(np.trace(s)) / d
    if method == "empirical":
        return s, 0.0
    if method == "ledoit_wolf":
        spread = float(np.sum((s - mu * np.eye(d)) ** 2)) / d
        noise = (m.fourth - n * float(np.sum(s * s))) / (n * n * d)
        rho = 0.0 if spread == 0.0 else min(max(noise, 0.0), spread) / spread
    elif method == "oas":
        alpha = float(np.mean(s * s))
        den = (n + 1.0) * (alpha - mu * mu / d)
        rho = 1.0 if den == 0.0 else min((alpha + mu * mu) / den, 1.0)
    else:
        raise BackendFitError(f"unknown covariance method: {method}")
    return (1.0 - rho) * s + rho * mu * np.eye(d), rho


def whitening(cov: np.ndarray, floor: float = FLOOR, output_dim: int | None = None) -> np.ndarray:
    """Columns v/sqrt(lambda), largest eigenvalue first, eigenvalues floored."""
    if floor <= 0.0 or not math.isfinite(floor):
        raise BackendFitError("eigenvalue floor must be positive")
    if output_dim is not None and output_dim <= 0:
        raise BackendFitError("output_dim must be positive")
    values, vectors = np.linalg.eigh(cov)
    take = np.argsort(values)[::-1][: output_dim or len(values)]
    return vectors[:, take] / np.sqrt(np.maximum(values[take], floor))


def speaker_residuals(df: DataFrame, *, min_utterances: int = 2) -> DataFrame:
    """vec minus its speaker's mean, for speakers with enough utterances."""
    means = mean_vectors(df, ["speaker"]).filter(F.col("n") >= min_utterances)
    joined = df.join(means, "speaker")
    return joined.select("utterance", "speaker", V.subtract(F.col("vec"), F.col("mean")).alias("vec"))


def _checked_residuals(df: DataFrame) -> DataFrame:
    res = speaker_residuals(df)
    if len(res.select("speaker").distinct().limit(2).collect()) < 2:
        raise BackendFitError("need two speakers with at least two utterances")
    return res


# --- fits ----------------------------------------------------------------------


def fit_centered_cosine(df: DataFrame, **_) -> Backend:
    return Backend("centered_cosine", mean=global_mean(df))


def fit_whitened_cosine(df: DataFrame, *, method: str = "ledoit_wolf", floor: float = FLOOR, output_dim=None) -> Backend:
    mean = global_mean(df)
    cov, rho = covariance(moments(df, shift=mean), method)
    return Backend("whitened_cosine", mean, whitening(cov, floor, output_dim), {"shrinkage": repr(rho)})


def fit_wccn_cosine(df: DataFrame, *, method: str = "ledoit_wolf", floor: float = FLOOR) -> Backend:
    cov, rho = covariance(moments(_checked_residuals(df)), method)
    return Backend("wccn_cosine", np.zeros(len(cov)), whitening(cov, floor), {"shrinkage": repr(rho)})


def fit_lda_cosine(df: DataFrame, *, output_dim: int = 128) -> Backend:
    """Directions maximising between over within scatter, scaled to unit within variance."""
    mean = global_mean(df)
    within = moments(speaker_residuals(df, min_utterances=1))
    per = mean_vectors(df, ["speaker"])
    between = moments(per, vec="mean", shift=mean, weight="n")
    classes = between.n
    if classes < 2:
        raise BackendFitError("LDA needs at least two speakers")
    sw = within.scatter / max(within.n - classes, 1)
    values, vectors = np.linalg.eigh(sw)
    keep = values > 1e-10 * max(float(values.max()), 1e-300)
    white = vectors[:, keep] / np.sqrt(values[keep])
    gains, turn = np.linalg.eigh(white.T @ (between.scatter / (classes - 1)) @ white)
    dim = min(output_dim, len(mean), classes - 1, white.shape[1])
    return Backend("lda_cosine", mean, white @ turn[:, np.argsort(gains)[::-1][:dim]], {"dim": str(dim)})


def fit_neg_mahalanobis(
    df: DataFrame, *, method: str = "ledoit_wolf", floor: float = FLOOR, diagonal: bool = False, within: bool = True
) -> Backend:
    if within:
        mom = moments(_checked_residuals(df))
    else:
        mom = moments(df, shift=global_mean(df))
    cov, rho = covariance(mom, method)
    if diagonal:
        precision = np.diag(1.0 / np.maximum(np.diag(cov), floor))
    else:
        values, vectors = np.linalg.eigh(cov)
        precision = (vectors / np.maximum(values, floor)) @ vectors.T
    meta = {"shrinkage": repr(rho), "diagonal": str(diagonal).lower()}
    return Backend("neg_mahalanobis", matrix=precision, meta=meta)


def select_cohort(df: DataFrame, *, per_speaker: int = 1, max_size: int = 1000, seed: str = "asnorm_cohort_v1") -> DataFrame:
    """Utterances with the lowest salted hash per speaker, then overall."""
    keyed = df.withColumn("cohort_key", hash_key(F.lit(seed), F.col("speaker"), F.col("utterance")))
    mine = top_n_per_group(keyed, ["speaker"], [F.col("cohort_key")], per_speaker, spread=["utterance"])
    return mine.drop("row_number").orderBy("cohort_key").limit(max_size)


def fit_asnorm_cosine(df: DataFrame, *, top_k: int = 100, floor: float = 1e-4, max_size: int = 1000, **kw) -> Backend:
    if top_k <= 0 or max_size <= 0:
        raise BackendFitError("top_k and max_size must be positive")
    rows = select_cohort(df, max_size=max_size, **kw).select("vec").collect()  # at most max_size vectors
    if not rows:
        raise BackendFitError("empty cohort")
    cohort = np.array([r.vec for r in rows])
    return Backend("asnorm_cosine", matrix=cohort, meta={"top_k": str(min(top_k, len(cohort))), "sigma_floor": repr(floor)})


FITTERS = {
    "centered_cosine": fit_centered_cosine,
    "whitened_cosine": fit_whitened_cosine,
    "wccn_cosine": fit_wccn_cosine,
    "lda_cosine": fit_lda_cosine,
    "neg_mahalanobis": fit_neg_mahalanobis,
    "asnorm_cosine": fit_asnorm_cosine,
}


def fit_backend(metric: str, df: DataFrame, *, held_out: DataFrame | None = None, **options) -> Backend:
    """Fit one backend; a failed fit gives a blocked backend instead of an error.

    ``held_out`` (speaker_id) names speakers that must not be fitted on; if one is,
    that is an error and never a blocked backend.
    """
    if metric not in FITTERS:
        raise ValueError(f"unknown backend: {metric}")
    if held_out is not None:
        assert_no_leakage(df.select(F.col("speaker").alias("speaker_id")).distinct(), held_out)
    try:
        return FITTERS[metric](df, **options)
    except (BackendFitError, np.linalg.LinAlgError) as err:
        return Backend(metric, status="blocked", meta={"reason": str(err)})


ARTEFACT = (
    "extractor string, metric string, status string, mean array<double>, "
    "matrix array<array<double>>, meta map<string,string>"
)


def artefact_table(spark: SparkSession, backends: dict[str, list[Backend]]) -> DataFrame:
    """Fitted backends per encoder as a table, to be written and read back."""
    rows = [
        (
            extractor,
            b.metric,
            b.status,
            None if b.mean is None else b.mean.tolist(),
            None if b.matrix is None else b.matrix.tolist(),
            b.meta,
        )
        for extractor, fitted in backends.items()
        for b in fitted
    ]
    return spark.createDataFrame(rows, ARTEFACT)


def load_backend(table: DataFrame, extractor: str, metric: str) -> Backend:
    row = table.filter((F.col("extractor") == extractor) & (F.col("metric") == metric)).first()
    if row is None:
        raise ValueError(f"no artefact for {extractor}/{metric}")
    return Backend(
        metric,
        None if row.mean is None else np.array(row.mean),
        None if row.matrix is None else np.array(row.matrix),
        dict(row.meta),
        row.status,
    )


# --- scoring -------------------------------------------------------------------


def project(column, mean: np.ndarray | None, matrix: np.ndarray | None):
    """(x - mean) @ matrix per utterance as one Arrow batch operation."""

    @F.pandas_udf("array<double>")
    def apply(v: pd.Series) -> pd.Series:
        if len(v) == 0:
            return pd.Series([], dtype=object)
        x = np.stack(v.to_numpy()).astype(float)
        x = x - mean if mean is not None else x
        return pd.Series(list(x @ matrix if matrix is not None else x))

    return apply(column)


def _cohort_statistics(backend: Backend):
    """A function of a vector column: mean and population std (floored) of its top-k cohort cosines."""
    k, floor = int(backend.meta["top_k"]), float(backend.meta["sigma_floor"])
    norms = np.linalg.norm(backend.matrix, axis=1, keepdims=True)
    cohort = (backend.matrix / np.maximum(norms, V.TINY)).T

    @F.pandas_udf("mu double, sigma double")
    def stats(v: pd.Series) -> pd.DataFrame:
        if len(v) == 0:
            return pd.DataFrame({"mu": [], "sigma": []}, dtype=float)
        x = np.stack(v.to_numpy()).astype(float)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), V.TINY)
        cos = x @ cohort
        top = np.partition(cos, cos.shape[1] - k, axis=1)[:, -k:]
        return pd.DataFrame({"mu": top.mean(axis=1), "sigma": np.maximum(top.std(axis=1), floor)})

    return stats


def asnorm_stats(embeddings: DataFrame, backend: Backend) -> DataFrame:
    """Mean and population std (floored) of each utterance's top-k cohort cosines."""
    return embeddings.withColumn("_s", _cohort_statistics(backend)(F.col("vec"))).select(
        *embeddings.columns, F.col("_s.mu").alias("mu"), F.col("_s.sigma").alias("sigma")
    )


def _side_columns(backend: Backend, vec) -> dict:
    """Columns an utterance brings to its trials; ``u`` is still to be scaled to unit length."""
    if backend.metric == "neg_mahalanobis":
        return {"x": vec, "p": project(vec, None, backend.matrix)}
    if backend.metric == "asnorm_cosine":
        return {"u": vec, "s": _cohort_statistics(backend)(vec)}
    plain = backend.mean is None and backend.matrix is None
    return {"u": vec if plain else project(vec, backend.mean, backend.matrix)}


def _pair_score(backend: Backend, side: Callable):
    """The score of a trial from both sides' columns; ``side(which, name)`` names them."""
    e, t = (lambda name: side("enroll", name)), (lambda name: side("test", name))
    if backend.metric == "neg_mahalanobis":
        return -(V.dot(e("x"), e("p")) + V.dot(t("x"), t("p")) - 2.0 * V.dot(e("p"), t("x")))
    raw = V.dot(e("u"), t("u"))
    if backend.metric == "asnorm_cosine":
        return 0.5 * ((raw - e("s")["mu"]) / e("s")["sigma"] + (raw - t("s")["mu"]) / t("s")["sigma"])
    return raw


def _cell_scores(live: dict[str, tuple[str, Backend]], columns: Sequence[str]) -> Callable:
    """For ``in_cells``: the backends' scores of a cell's trials, from plain vectors projected once a block.

    ``columns`` are the vectors, then ``mu`` and ``sigma`` of every AS-norm, then ``here``.
    """

    def sides(block: pa.RecordBatch) -> tuple[dict, dict]:
        arrays = dict(zip(columns, block["_v"].flatten()))
        plain = {c: by_component(arrays[c]) for c, _ in live.values()}
        vectors, numbers = {}, {}
        for n, (c, b) in live.items():
            x = plain[c]
            if b.metric == "neg_mahalanobis":
                p = b.matrix.T @ x
                vectors[n], numbers[n] = (p, x), [(x * p).sum(axis=0)]
                continue
            if b.metric != "asnorm_cosine":
                x = x - b.mean[:, None] if b.mean is not None else x
                x = b.matrix.T @ x if b.matrix is not None else x
            norm = np.sqrt((x * x).sum(axis=0))
            u = x / np.where(norm > V.TINY, norm, np.nan)
            vectors[n] = (u, u)
            numbers[n] = [arrays[f"{n}__{k}"].to_numpy(zero_copy_only=False) for k in ("mu", "sigma")] if b.metric == "asnorm_cosine" else []
        return vectors, numbers

    def values(blocks: list[pa.RecordBatch]) -> Callable:
        (enroll, of_e), (test, of_t) = (sides(b) for b in blocks)

        def give(at: list[pa.Array]) -> list[pa.Array]:
            here = [~np.asarray(i.is_null()) for i in at]
            both = here[0] & here[1]
            e, t = (pc.fill_null(i, 0).to_numpy()[both] for i in at)
            out = [pa.array(h, mask=~h) for h in here]
            for n, (_, b) in live.items():
                x, y = enroll[n][0], test[n][1]
                raw = np.zeros(len(e))
                for k in range(len(x) if len(e) else 0):
                    raw += x[k][e] * y[k][t]
                if b.metric == "neg_mahalanobis":
                    raw = -(of_e[n][0][e] + of_t[n][0][t] - 2.0 * raw)
                elif b.metric == "asnorm_cosine":
                    raw = 0.5 * ((raw - of_e[n][0][e]) / of_e[n][1][e] + (raw - of_t[n][0][t]) / of_t[n][1][t])
                score = np.full(len(both), np.nan)
                score[both] = raw
                out.append(pa.array(score, mask=np.isnan(score)))
            return out

        return give

    return values


def _input_dim(backend: Backend) -> int | None:
    """Components of the vectors a backend takes, where it says so."""
    if backend.mean is not None:
        return len(backend.mean)
    return None if backend.matrix is None else backend.matrix.shape[backend.metric == "asnorm_cosine"]


def _brought_bytes(backend: Backend, dim: int) -> int:
    """Estimated bytes of what an utterance brings to a join for one backend."""
    if backend.metric == "neg_mahalanobis":
        return vector_bytes(2, dim)
    plain = backend.matrix is None or backend.metric == "asnorm_cosine"
    return vector_bytes(1, dim if plain else backend.matrix.shape[1])


def score_backends(
    trials: DataFrame,
    embeddings: DataFrame,
    fitted: dict[str, tuple[str, Backend]],
    *,
    blocked: str = "error",
    on_missing: str = "error",
    rows: int | None = None,
    dim: int = MAX_DIM,
) -> DataFrame:
    """One score column per entry of ``fitted`` ({name: (vector column, backend)}) from one lookup of both sides.

    A small table of all that utterances bring is joined by broadcast.  A larger one is
    met in cells as plain vectors, and everything else is computed inside the cell, so
    neither projections nor vectors move with a trial.  ``rows`` is the number of
    utterances and ``dim`` their components, where known.
    ``blocked`` says what an unfitted backend does: ``error`` or a NULL column.
    """
    live = {n: (c, b) for n, (c, b) in fitted.items() if b.status == "ok"}
    if blocked == "error" and len(live) < len(fitted):
        name, (_, backend) = next((n, x) for n, x in fitted.items() if n not in live)
        raise BackendFitError(f"{name} is blocked: {backend.meta.get('reason', '')}")
    none = F.lit(None).cast("double")
    vectors = list(dict.fromkeys(c for c, _ in live.values()))
    dim = next((d for d in (_input_dim(b) for _, b in live.values()) if d), dim)
    width = sum(_brought_bytes(b, dim) for _, b in live.values())
    blocks = side_blocks(trials, rows, vector_bytes(len(vectors) + len(live), dim), width)
    if blocks:
        known_missing(on_missing)
        norms = {n: _cohort_statistics(b)(F.col(c)) for n, (c, b) in live.items() if b.metric == "asnorm_cosine"}
        per = embeddings.select("utterance", *[F.col(c).cast("array<double>").alias(c) for c in vectors], *[s.alias(f"{n}__s") for n, s in norms.items()])
        numbers = {f"{n}__{k}": F.col(f"{n}__s.{k}") for n in norms for k in ("mu", "sigma")}
        per = per.select("utterance", *vectors, *[v.alias(k) for k, v in numbers.items()], F.lit(True).alias("here"))
        given = [T.StructField(f"_{side}_here", T.BooleanType()) for side in ("enroll", "test")]
        given += [T.StructField(n, T.DoubleType()) for n in live]
        columns = [*vectors, *numbers, "here"]
        joined = checked_sides(in_cells(trials, per, columns, blocks, _cell_scores(live, columns), given), on_missing)
        return joined.select(*trials.columns, *[F.col(n) if n in live else none.alias(n) for n in fitted])
    sides = {f"{n}__{k}": v for n, (c, b) in live.items() for k, v in _side_columns(b, F.col(c)).items()}
    per = embeddings.select("utterance", *[v.alias(k) for k, v in sides.items()])
    per = per.select("utterance", *[(V.unit(F.col(k)) if k.endswith("__u") else F.col(k)).alias(k) for k in sides])
    joined = attach_sides(trials, per, list(sides), on_missing, rows=rows, row_bytes=width)
    values = {n: _pair_score(b, lambda which, k, n=n: F.col(f"_{which}_{n}__{k}")) for n, (_, b) in live.items()}
    return joined.select(*trials.columns, *[values.get(n, none).alias(n) for n in fitted])


def score_backend(
    trials: DataFrame, embeddings: DataFrame, backend: Backend, *, blocked: str = "error", on_missing: str = "error", rows: int | None = None
) -> DataFrame:
    """Add ``score_<metric>`` of one backend from (utterance, vec)."""
    named = {f"score_{backend.metric}": ("vec", backend)}
    return score_backends(trials, embeddings, named, blocked=blocked, on_missing=on_missing, rows=rows)
