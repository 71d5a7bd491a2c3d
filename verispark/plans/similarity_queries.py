"""Queries over pairwise scores, fitted backends and score tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backends as K
from ..operators import protocol as P
from ..operators import scoring as J
from ..sources import fixtures as fx
from . import sqlbase as B
from .protocol_queries import DUR, MEDIAN, wide_by_id
from .registry import query

ENCODERS = fx.ENCODERS

# --- pairwise metrics of the first encoder, over every trial of the list -------

PAIR = """pair AS (SELECT p.trial_id, a.enc1 AS a, b.enc1 AS b FROM protocol p
  JOIN emb a ON a.utterance = p.enroll_utt JOIN emb b ON b.utterance = p.test_utt)"""
_SQ = "list_sum(list_transform(list_zip(a, b), lambda x: (x[1]-x[2])*(x[1]-x[2])))"
_L1 = "list_sum(list_transform(list_zip(a, b), lambda x: abs(x[1]-x[2])))"
_COS = "list_cosine_similarity(a, b)"


def _own(v: str) -> str:
    return f"list_transform({v}, lambda x: x - list_avg({v}))"


def _lognorm(v: str) -> str:
    return f"ln(sqrt(list_inner_product({v}, {v})) + 1e-12::DOUBLE)"


def enc1(spark, d):
    return fx.embeddings_wide(spark, d).select("utterance", "speaker", F.col("enc1").alias("embedding"))


def _pair_query(key: str, metrics: list[str], exprs: list[str], **options):
    cols = [f"score_{m}" for m in metrics]
    ctes = ["m AS (SELECT trial_id, " + ", ".join(f"{e} AS {c}" for e, c in zip(exprs, cols)) + " FROM pair)"]

    @query(key, B.sql(PAIR, *ctes, final=B.pick("m", ["trial_id"], cols)))
    def run(spark, d):
        t = fx.protocol(spark, d).select("trial_id", "enroll_utt", "test_utt")
        size = {"utterances": fx.utterance_count(spark, d), "dim": fx.ENC_DIM}
        return J.score_trials(t, enc1(spark, d), metrics, **size, **options).select("trial_id", *cols)


_pair_query("cosine", ["cosine"], [_COS])
_pair_query("dot_raw", ["dot_raw"], ["list_inner_product(a, b)"])
_pair_query("neg_l2", ["neg_l2_raw"], [f"-sqrt({_SQ})"])
_pair_query("neg_sq_l2", ["neg_sq_l2_raw"], [f"-{_SQ}"])
_pair_query("neg_l1", ["neg_l1_raw"], [f"-{_L1}"])
_pair_query("pearson_pair", ["pearson_corr"], [f"list_cosine_similarity({_own('a')}, {_own('b')})"])
_pair_query("angular", ["angular_similarity_diagnostic"], [f"1 - acos(least(greatest({_COS}, -1), 1))/pi()"])
_pair_query("rbf", ["rbf_similarity_diagnostic"], [f"exp(-0.5::DOUBLE*{_SQ})"], rbf_gamma=0.5)
_la, _lb = _lognorm("a"), _lognorm("b")
_pair_query(
    "norm_context",
    ["log_norm_enroll", "log_norm_test", "log_norm_product", "abs_log_norm_ratio", "min_log_norm", "max_log_norm"],
    [_la, _lb, f"{_la} + {_lb}", f"abs({_la} - {_lb})", f"least({_la}, {_lb})", f"greatest({_la}, {_lb})"],
)

# --- fitted backends -----------------------------------------------------------


def fit_people(spark, d):
    """(utterance, speaker) of the calibration trials."""
    return K.utterance_speakers(fx.trials(spark, d).filter("split = 'calibration'"))


def fit_frame(spark, d):
    rows = enc1(spark, d).select("utterance", "embedding").join(fit_people(spark, d), "utterance")
    return rows.select("utterance", "speaker", F.col("embedding").alias("vec"))


def all_vectors(spark, d):
    return enc1(spark, d).select("utterance", F.col("embedding").alias("vec"))


def usable(spark, d):
    t = fx.trials(spark, d).filter(F.col("split") != P.UNUSED)
    return t.select("split", "trial_id", "label", "enroll_utt", "test_utt")


FIT = """fitu AS (SELECT DISTINCT utterance, speaker FROM (
  SELECT enroll_utt AS utterance, enroll_speaker AS speaker FROM trials WHERE split = 'calibration'
  UNION ALL SELECT test_utt, test_speaker FROM trials WHERE split = 'calibration')),
fit AS (SELECT f.utterance, f.speaker, e.enc1 AS v FROM fitu f JOIN emb e USING (utterance)),
fitx AS (SELECT utterance, speaker, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM fit)"""
UPAIR = """pair AS (SELECT u.split, u.trial_id, a.utterance AS au, b.utterance AS bu, a.enc1 AS a, b.enc1 AS b FROM usable u
  JOIN emb a ON a.utterance = u.enroll_utt JOIN emb b ON b.utterance = u.test_utt)"""


@query("utterance_speakers", B.sql(FIT, final="SELECT utterance, speaker FROM fitu"))
def utterance_speakers(spark, d):
    return fit_people(spark, d).select("utterance", "speaker")


def _side(name: str) -> str:
    sums = [f"sum(('0x' || substr(sha256(speaker_id), {1 + 12 * i}, 12))::BIGINT)" for i in range(4)]
    joined = " || ':' || ".join(f"cast({s} AS VARCHAR)" for s in sums)
    return f"""{name}_b AS (SELECT substr(h, 1, 3) AS b, sha256(string_agg(h, chr(10) ORDER BY h)) AS hb
  FROM (SELECT sha256(speaker_id) AS h FROM {name}p) GROUP BY 1),
{name}_s AS (SELECT count(*) AS {name}_speaker_count, sha256({joined}) AS {name}_fingerprint,
  (SELECT sha256(string_agg(b || ':' || hb, chr(10) ORDER BY b)) FROM {name}_b) AS {name}_speaker_hash FROM {name}p)"""


@query(
    "leakage_manifest",
    B.sql(
        """fitp AS (SELECT enroll_speaker AS speaker_id FROM trials WHERE split = 'calibration'
  UNION SELECT test_speaker FROM trials WHERE split = 'calibration')""",
        """testp AS (SELECT enroll_speaker AS speaker_id FROM trials WHERE split IN ('test', 'unused_cross_split')
  UNION SELECT test_speaker FROM trials WHERE split IN ('test', 'unused_cross_split'))""",
        _side("fit"),
        _side("test"),
        "both_ AS (SELECT speaker_id FROM fitp INTERSECT SELECT speaker_id FROM testp)",
        final="""SELECT f.*, t.*, (SELECT count(*) FROM both_) AS overlap_count,
  (SELECT string_agg(speaker_id, ',' ORDER BY speaker_id) FROM (SELECT * FROM both_ ORDER BY speaker_id LIMIT 10))
    AS overlap_preview FROM fit_s f, test_s t""",
    ),
)
def leakage_manifest(spark, d):
    """Fit speakers against everything outside calibration (overlap on purpose)."""
    t = fx.trials(spark, d)
    fit = P.collect_speakers(t.filter("split = 'calibration'"))
    return K.leakage_manifest(fit, P.collect_speakers(t.filter(F.col("split").isin("test", P.UNUSED))))


@query(
    "centered_cosine",
    B.sql(
        FIT,
        UPAIR,
        "mu AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(x) AS m FROM fitx GROUP BY i))",
        """s AS (SELECT trial_id, list_cosine_similarity(list_transform(list_zip(a, m), lambda x: x[1]-x[2]),
  list_transform(list_zip(b, m), lambda x: x[1]-x[2])) AS score_centered_cosine FROM pair, mu)""",
        final=B.pick("s", ["trial_id"], ["score_centered_cosine"]),
    ),
)
def centered_cosine(spark, d):
    return _score(spark, d, "centered_cosine")


def _score(spark, d, metric: str, **options):
    tested = P.collect_speakers(fx.trials(spark, d).filter("split = 'test'"))
    fitted = K.fit_backend(metric, fit_frame(spark, d), held_out=tested, **options)
    out = K.score_backend(usable(spark, d), all_vectors(spark, d), fitted, rows=fx.utterance_count(spark, d))
    return out.select("trial_id", f"score_{metric}")


COV = """mu AS (SELECT i, avg(x) AS m FROM fitx GROUP BY i),
cx AS (SELECT f.utterance, f.i, f.x - mu.m AS x FROM fitx f JOIN mu USING (i)),
nn AS (SELECT count(*) AS n FROM fit),
cov AS (SELECT a.i, b.i AS j, sum(a.x*b.x)/any_value(n) AS c FROM cx a JOIN cx b USING (utterance), nn GROUP BY a.i, b.i)"""


@query("cov_empirical", B.sql(FIT, COV, final="SELECT i, j, round(c, 6) + 0.0::DOUBLE AS value FROM cov"))
def cov_empirical(spark, d):
    fit = fit_frame(spark, d)
    cov, _ = K.covariance(K.moments(fit, shift=K.global_mean(fit)), "empirical")
    rows = [(i + 1, j + 1, float(cov[i, j])) for i in range(len(cov)) for j in range(len(cov))]
    return spark.createDataFrame(rows, "i bigint, j bigint, value double")


@query(
    "cov_shrinkage",
    B.sql(
        FIT,
        COV,
        "fourth AS (SELECT sum(q*q) AS f FROM (SELECT sum(x*x) AS q FROM cx GROUP BY utterance))",
        """k AS (SELECT max(i)::DOUBLE AS d, sum(CASE WHEN i = j THEN c ELSE 0 END)/max(i) AS mu, sum(c*c) AS ss,
  any_value(n)::DOUBLE AS n, any_value(f) AS f FROM cov, nn, fourth)""",
        "lw AS (SELECT ((ss - d*mu*mu)/d) AS delta, (f - n*ss)/(n*n*d) AS beta FROM k)",
        final="""SELECT 'ledoit_wolf' AS method, round(least(beta, delta)/delta, 6) + 0.0::DOUBLE AS shrinkage FROM lw
  UNION ALL SELECT 'oas', round(least(1.0, (ss/(d*d) + mu*mu)/((n+1)*(ss/(d*d) - mu*mu/d))), 6) + 0.0::DOUBLE FROM k""",
    ),
)
def cov_shrinkage(spark, d):
    fit = fit_frame(spark, d)
    m = K.moments(fit, shift=K.global_mean(fit))
    rows = [(name, K.covariance(m, name)[1]) for name in ("ledoit_wolf", "oas")]
    return spark.createDataFrame(rows, "method string, shrinkage double")


RESID = """res AS (SELECT utterance, i, x - avg(x) OVER (PARTITION BY speaker, i) AS x,
  count(*) OVER (PARTITION BY speaker, i) AS n FROM fitx)"""


@query(
    "speaker_residuals",
    B.sql(FIT, RESID, final="SELECT utterance, i, round(x, 6) + 0.0::DOUBLE AS value FROM res WHERE n >= 2"),
)
def speaker_residuals(spark, d):
    res = K.speaker_residuals(fit_frame(spark, d))
    flat = res.select("utterance", F.posexplode("vec").alias("i", "value"))
    return flat.select("utterance", (F.col("i") + 1).cast("bigint").alias("i"), "value")


@query(
    "mahalanobis_diag",
    B.sql(
        FIT,
        RESID,
        UPAIR,
        """prec AS (SELECT list(p ORDER BY i) AS p FROM (SELECT i, 1/greatest(avg(x*x), 1e-5::DOUBLE) AS p
  FROM res WHERE n >= 2 GROUP BY i))""",
        """s AS (SELECT trial_id, -list_sum(list_transform(list_zip(a, b, p),
  lambda x: x[3]*(x[1]-x[2])*(x[1]-x[2]))) AS score_neg_mahalanobis FROM pair, prec)""",
        final=B.pick("s", ["trial_id"], ["score_neg_mahalanobis"]),
    ),
)
def mahalanobis_diag(spark, d):
    return _score(spark, d, "neg_mahalanobis", method="empirical", diagonal=True)


# At full dimension a whitened, WCCN or LDA cosine depends only on the inverse of the
# covariance: the rotation drops out, and the eigenvalue floor does not bind on these data.


def _shrunk(x: str) -> str:
    """CTEs up to ``shrunk``: the Ledoit-Wolf covariance of centred components ``x`` (utterance, i, x)."""
    return f"""xn AS (SELECT count(DISTINCT utterance)::DOUBLE AS n FROM {x}),
xc AS (SELECT a.i, b.i AS j, sum(a.x*b.x)/any_value(n) AS c FROM {x} a JOIN {x} b USING (utterance), xn GROUP BY a.i, b.i),
xf AS (SELECT sum(q*q) AS f FROM (SELECT sum(x*x) AS q FROM {x} GROUP BY utterance)),
xk AS (SELECT max(i)::DOUBLE AS d, sum(CASE WHEN i = j THEN c ELSE 0 END)/max(i) AS mu, sum(c*c) AS ss FROM xc),
xs AS (SELECT mu, least(greatest((f - n*ss)/(n*n*d), 0), (ss - d*mu*mu)/d) / ((ss - d*mu*mu)/d) AS rho FROM xk, xn, xf),
shrunk AS (SELECT i, j, (1 - rho)*c + CASE WHEN i = j THEN rho*mu ELSE 0 END AS c FROM xc, xs)"""


def _inverse(matrix: str, d: int = fx.ENC_DIM) -> str:
    """``prec``: the inverse p (a list of rows) of a matrix (i, j, c), by Gauss-Jordan steps."""
    return f"""prec AS (WITH RECURSIVE gj AS (
  SELECT 0 AS k, list(r ORDER BY i) AS m FROM (
    SELECT i, list_concat(list(c ORDER BY j), list_transform(range(1, {d + 1}), lambda x: CASE WHEN x = i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS r
    FROM {matrix} GROUP BY i)
  UNION ALL
  SELECT k + 1, list_transform(range(1, {d + 1}), lambda i: CASE WHEN i = k + 1
    THEN list_transform(m[k + 1], lambda x: x / m[k + 1][k + 1])
    ELSE list_transform(list_zip(m[i], m[k + 1]), lambda z: z[1] - m[i][k + 1] / m[k + 1][k + 1] * z[2]) END)
  FROM gj WHERE k < {d})
SELECT list_transform(m, lambda r: r[{d + 1}:{2 * d}]) AS p FROM gj WHERE k = {d})"""


def _form(a: str, b: str) -> str:
    return f"list_inner_product({a}, list_transform(p, lambda r: list_inner_product(r, {b})))"


_CENTRED = """mu AS (SELECT i, avg(x) AS m FROM fitx GROUP BY i),
cx AS (SELECT f.utterance, f.i, f.x - mu.m AS x FROM fitx f JOIN mu USING (i))"""
_SHIFTED = """mv AS (SELECT list(m ORDER BY i) AS mv FROM mu),
side AS (SELECT trial_id, list_transform(list_zip(a, mv), lambda x: x[1]-x[2]) AS a,
  list_transform(list_zip(b, mv), lambda x: x[1]-x[2]) AS b FROM pair, mv)"""
_PLAIN = "side AS (SELECT trial_id, a, b FROM pair)"


def _form_query(key: str, metric: str, *ctes: str, distance: bool = False):
    value = f"-{_form('d', 'd')}" if distance else f"{_form('a', 'b')} / sqrt({_form('a', 'a')} * {_form('b', 'b')})"
    both = "both_ AS (SELECT trial_id, a, b, list_transform(list_zip(a, b), lambda x: x[1]-x[2]) AS d, p FROM side, prec)"
    name = f"score_{metric}"
    sql = B.sql(FIT, UPAIR, *ctes, both, f"s AS (SELECT trial_id, {value} AS {name} FROM both_)", final=B.pick("s", ["trial_id"], [name]))

    @query(key, sql)
    def run(spark, d):
        return _score(spark, d, metric)


_TWO = "rx AS (SELECT utterance, i, x FROM res WHERE n >= 2)"
_WITHIN = "xw AS (SELECT a.i, b.i AS j, sum(a.x*b.x) AS c FROM res a JOIN res b USING (utterance) GROUP BY a.i, b.i)"
_form_query("whitened_cosine", "whitened_cosine", _CENTRED, _shrunk("cx"), _inverse("shrunk"), _SHIFTED)
_form_query("wccn_cosine", "wccn_cosine", RESID, _TWO, _shrunk("rx"), _inverse("shrunk"), _PLAIN)
_form_query("lda_cosine", "lda_cosine", _CENTRED, RESID, _WITHIN, _inverse("xw"), _SHIFTED)
_form_query("mahalanobis_full", "neg_mahalanobis", RESID, _TWO, _shrunk("rx"), _inverse("shrunk"), _PLAIN, distance=True)


COHORT_SIZE, TOP_K = 1000, 100
COHORT = f"""keyed AS (SELECT utterance, speaker, v,
  sha256('asnorm_cohort_v1' || chr(31) || speaker || chr(31) || utterance) AS cohort_key FROM fit),
firsts AS (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY cohort_key) AS r FROM keyed),
cohort AS (SELECT utterance, speaker, v, cohort_key FROM firsts WHERE r <= 1 ORDER BY cohort_key LIMIT {COHORT_SIZE})"""
STATS = f"""stats AS (SELECT utterance, avg(c) AS mu, greatest(stddev_pop(c), 1e-4::DOUBLE) AS sigma FROM (
  SELECT e.utterance, list_cosine_similarity(e.enc1, k.v) AS c,
    row_number() OVER (PARTITION BY e.utterance ORDER BY list_cosine_similarity(e.enc1, k.v) DESC) AS r
  FROM emb e, cohort k) WHERE r <= {TOP_K} GROUP BY utterance)"""


@query("asnorm_cohort", B.sql(FIT, COHORT, final="SELECT speaker, utterance, cohort_key FROM cohort"))
def asnorm_cohort(spark, d):
    return K.select_cohort(fit_frame(spark, d), max_size=COHORT_SIZE).select("speaker", "utterance", "cohort_key")


@query("asnorm_stats", B.sql(FIT, COHORT, STATS, final=B.pick("stats", ["utterance"], ["mu", "sigma"])))
def asnorm_stats(spark, d):
    tested = P.collect_speakers(fx.trials(spark, d).filter("split = 'test'"))
    fitted = K.fit_backend("asnorm_cosine", fit_frame(spark, d), held_out=tested, max_size=COHORT_SIZE, top_k=TOP_K)
    return K.asnorm_stats(all_vectors(spark, d), fitted).select("utterance", "mu", "sigma")


@query(
    "asnorm_cosine",
    B.sql(
        FIT,
        COHORT,
        STATS,
        UPAIR,
        """s AS (SELECT trial_id, 0.5::DOUBLE*((c - e.mu)/e.sigma + (c - t.mu)/t.sigma) AS score_asnorm_cosine
  FROM (SELECT trial_id, au, bu, list_cosine_similarity(a, b) AS c FROM pair) p
  JOIN stats e ON e.utterance = p.au JOIN stats t ON t.utterance = p.bu)""",
        final=B.pick("s", ["trial_id"], ["score_asnorm_cosine"]),
    ),
)
def asnorm_cosine(spark, d):
    return _score(spark, d, "asnorm_cosine", max_size=COHORT_SIZE, top_k=TOP_K)


@query("backend_artefacts")
def backend_artefacts(spark, d):
    """Fit status, shrinkage and matrix shape of every backend of one encoder."""
    fit = fit_frame(spark, d).persist()
    tested = P.collect_speakers(fx.trials(spark, d).filter("split = 'test'")).persist()
    table = K.artefact_table(spark, {"enc1": [K.fit_backend(m, fit, held_out=tested) for m in K.FITTERS]})
    tested.unpersist()
    fit.unpersist()
    return table.select(
        "extractor",
        "metric",
        "status",
        F.size(F.coalesce("matrix", F.array())).cast("bigint").alias("matrix_rows"),
        F.element_at("meta", "shrinkage").try_cast("double").alias("shrinkage"),
    )


# --- scoring and table assembly ------------------------------------------------

SCORES = [f"score_{e}" for e in ENCODERS]


@query("score_trials", B.sql(final=B.pick("scored", ["split", "trial_id", "label"], SCORES)))
def score_trials(spark, d):
    return fx.scored(spark, d).select("split", "trial_id", F.col("label").cast("int").alias("label"), *SCORES)


@query(
    "missing_embeddings",
    B.sql(
        "have AS (SELECT utterance FROM utt WHERE vec_label <> 0)",
        final="""SELECT split, count(*) AS trials, count(*) FILTER (a.utterance IS NULL) AS missing_enroll,
  count(*) FILTER (b.utterance IS NULL) AS missing_test,
  count(*) FILTER (a.utterance IS NULL OR b.utterance IS NULL) AS skipped
  FROM trials t LEFT JOIN have a ON a.utterance = t.enroll_utt LEFT JOIN have b ON b.utterance = t.test_utt GROUP BY split""",
    ),
)
def missing_embeddings(spark, d):
    """Count the trials whose vectors are absent (vectors of one label withheld)."""
    withheld = fx.table(spark, d, "embeddings").filter("label <> 0").select("vec_id")
    have = fx.utterances(spark, d).join(withheld, "vec_id", "left_semi")
    return J.missing_embeddings(fx.trials(spark, d).select("split", "enroll_utt", "test_utt"), have)


@query("wide_trials", B.sql(final=B.pick("scored", ["split", "trial_id", "label"], SCORES)))
def wide_trials(spark, d):
    """Long scores of six encoders pivoted back to one row per trial."""
    wide = J.pivot_scores(fx.scored_long(spark, d), ENCODERS)
    return wide.withColumn("label", F.col("label").cast("int"))


@query(
    "alignment_audit",
    B.sql(
        """mixed AS (SELECT split, trial_id, CASE WHEN embedding_name = 'enc2' AND score > 0.7 THEN 1 - label ELSE label END AS label,
  embedding_name FROM long WHERE NOT (embedding_name = 'enc6' AND score < 0)
  UNION ALL SELECT split, trial_id, label, embedding_name FROM long WHERE embedding_name = 'enc1' AND score > 0.8)""",
        """per AS (SELECT split, trial_id, count(*) AS rows, count(DISTINCT embedding_name) AS encoders, min(label) AS lo,
  max(label) AS hi FROM mixed GROUP BY 1, 2)""",
        final="""SELECT split, count(*) AS trials, count(*) FILTER (rows = 6 AND encoders = 6 AND lo = hi) AS aligned,
  count(*) FILTER (encoders < 6) AS short, count(*) FILTER (rows > encoders) AS duplicated,
  count(*) FILTER (lo <> hi) AS label_mismatch FROM per GROUP BY split""",
    ),
)
def alignment_audit(spark, d):
    """Gaps, duplicates and label conflicts injected by score ranges."""
    long = fx.scored_long(spark, d)
    e, s = F.col("embedding_name"), F.col("score")
    flipped = F.when((e == "enc2") & (s > 0.7), 1 - F.col("label")).otherwise(F.col("label")).cast("tinyint")
    twice = F.when((e == "enc1") & (s > 0.8), 2).otherwise(1)
    mixed = long.filter(~((e == "enc6") & (s < 0))).withColumn("_copies", F.explode(F.sequence(F.lit(1), twice)))
    return J.alignment_audit(mixed.withColumn("label", flipped), ENCODERS)


SIM_METRICS = ["cosine", "dot_raw", "neg_l2_raw"]


def _sim(e: str, m: str) -> str:
    a, b = f"a.{e}", f"b.{e}"
    return {
        "cosine": f"list_cosine_similarity({a}, {b})",
        "dot_raw": f"list_inner_product({a}, {b})",
        "neg_l2_raw": f"-list_distance({a}, {b})",
    }[m]


@query(
    "similarity_wide",
    B.sql(
        "sim AS (SELECT u.split, u.trial_id, u.label, "
        + ", ".join(f"{_sim(e, m)} AS score__{e}__{m}" for e in ENCODERS for m in SIM_METRICS)
        + ", "
        + ", ".join(f"{_sim(e, 'cosine')} AS score_{e}" for e in ENCODERS)
        + " FROM usable u JOIN emb a ON a.utterance = u.enroll_utt JOIN emb b ON b.utterance = u.test_utt)",
        final=B.pick(
            "sim",
            ["split", "trial_id", "label"],
            [f"score__{e}__{m}" for e in ENCODERS for m in SIM_METRICS] + SCORES,
        ),
    ),
)
def similarity_wide(spark, d):
    t = usable(spark, d)
    size = {"rows": fx.utterance_count(spark, d), "dim": fx.ENC_DIM}
    out = J.similarity_columns(t, fx.embeddings_wide(spark, d), ENCODERS, SIM_METRICS, **size)
    return out.withColumn("label", F.col("label").cast("int")).drop("enroll_utt", "test_utt")


@query(
    "resplit_wide",
    B.sql(
        MEDIAN,
        DUR,
        """rr AS (SELECT speaker_id, count(*) OVER () AS n,
  row_number() OVER (ORDER BY sha256('resplit_v1' || chr(0) || speaker_id), speaker_id) AS r FROM people)""",
        """m2 AS (SELECT speaker_id, CASE WHEN r <= floor(n*0.5) THEN 'calibration' ELSE 'test' END AS s FROM rr)""",
        f"""w AS (SELECT m.s AS split, f.trial_id, f.label, f.target, f.min_duration, f.qmf1, {', '.join('c.score_' + e for e in ENCODERS)}
  FROM feat f JOIN scored c USING (trial_id) JOIN m2 m ON m.speaker_id = f.enroll_speaker
  JOIN m2 t ON t.speaker_id = f.test_speaker AND t.s = m.s)""",
        final=B.pick("w", ["split", "trial_id", "label", "target"], ["min_duration", "qmf1", *SCORES]),
    ),
)
def resplit_wide(spark, d):
    """Re-split already scored trials by a new manifest; cross-split trials leave."""
    vid = F.col("vec_id")
    people = fx.table(spark, d, "embeddings").select(fx.speaker_of(vid).alias("speaker_id")).distinct()
    count = fx.speaker_count(spark, d)
    manifest = P.assign_speakers(people, seed="resplit_v1", calibration_ratio=0.5, count=count, leftover="test")
    wide = wide_by_id(spark, d, only=["trial_id", "label", "enroll_speaker", "test_speaker", "target", "min_duration", "qmf1"])
    again = P.split_protocol(wide, manifest, count).filter(F.col("split") != P.UNUSED)
    return again.select(
        "split", "trial_id", F.col("label").cast("int").alias("label"), "target", "min_duration", "qmf1", *SCORES
    )


@query(
    "metadata_join",
    B.sql(
        final="""SELECT split, trial_id, label, round(llr, 6) + 0.0::DOUBLE AS llr, enroll_speaker, test_speaker,
  language_pair, round(enroll_duration_sec, 6) + 0.0::DOUBLE AS enroll_duration_sec FROM llrs"""
    ),
)
def metadata_join(spark, d):
    """Metadata by id and utterances: at size, different trials share an id."""
    meta = ["enroll_speaker", "test_speaker", "language_pair", "enroll_duration_sec"]
    keys = ["trial_id", "enroll_utt", "test_utt"]
    trials = fx.llr_trials(spark, d, extra=("enroll_utt", "test_utt"))
    out = J.join_metadata(trials, fx.protocol(spark, d).select(*keys, *meta), meta, keys)
    return out.select("split", "trial_id", F.col("label").cast("int").alias("label"), "llr", *meta)
