"""Queries over verification metrics and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis as A
from ..operators import bootstrap as R
from ..operators import metrics as M
from ..operators import protocol as P
from ..operators import scoring as J
from ..operators import selective as D
from ..session import materialise
from ..sources import fixtures as fx
from . import sqlbase as B
from .registry import query

ENC = "embedding_name"
PER = ["split", ENC]


def _int_label(df):
    return df.withColumn("label", F.col("label").cast("int"))


@query(
    "roc_points",
    B.sql(
        B.roc("r", "llrs", ["split"], "llr"),
        "pts AS (SELECT split, score AS threshold, pmiss, pfa FROM r WHERE pfa IS NOT NULL "
        "UNION ALL SELECT DISTINCT split, 'Infinity'::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE FROM r WHERE pfa IS NOT NULL)",
        final=B.pick("pts", ["split"], ["threshold", "pmiss", "pfa"]),
    ),
)
def roc_points(spark, d):
    return M.roc_points(fx.llr_rows(spark, d), ["split"], "llr")


@query(
    "eer",
    B.sql(
        B.roc("r", "long", PER), B.eer("e", "r", PER), final=B.pick("e", PER, ["eer", "eer_threshold"])
    ),
)
def eer(spark, d):
    return M.eer(fx.scores_long(spark, d), PER)


def _block_part(key: str, columns: list[str], extra: list[str] | None = None):
    counts = extra or []

    @query(key, B.sql(B.block("b", "llrs", ["split"], "llr"), final=B.pick("b", ["split", *counts], columns)))
    def run(spark, d):
        return M.metric_block(fx.llr_rows(spark, d), ["split"], "llr").select("split", *counts, *columns)


_block_part("min_dcf", ["min_dcf_p001", "min_dcf_p01"])


def _cost_part(key: str, columns: list[str]):
    """Decision metrics need no ranking: one grouped pass."""

    @query(key, B.sql(B.block("b", "llrs", ["split"], "llr"), final=B.pick("b", ["split"], columns)))
    def run(spark, d):
        return M.decision_costs(fx.llr_rows(spark, d), ["split"]).select("split", *columns)


_cost_part("act_dcf", ["act_dcf_p001", "act_dcf_p01"])
_cost_part("cllr", ["cllr"])
_cost_part("classification", ["accuracy", "precision", "recall", "f1"])


@query("metric_block", B.sql(B.block("b", "long", PER), final=B.pick("b", [*PER, *B.COUNTS], B.DOUBLES)))
def metric_block(spark, d):
    return M.metric_block(fx.scores_long(spark, d), PER)


@query("c0_raw", B.sql(B.block("b", "long", [ENC]), final=B.pick("b", [ENC, *B.COUNTS], B.DOUBLES)))
def c0_raw(spark, d):
    """Raw scores read as LLRs, per encoder over all usable trials."""
    return M.metric_block(fx.scores_long(spark, d), [ENC])


@query(
    "label_metrics",
    B.sql(
        """q AS (SELECT d.lang, ln(1.0 + d.n_chars) AS score, l.quality AS label FROM documents d JOIN labels l USING (doc_id))""",
        B.block("b", "q", ["lang"]),
        final=B.pick("b", ["lang", *B.COUNTS], B.DOUBLES),
    ),
)
def label_metrics(spark, d):
    """The metric block on a score with natural ties: text length against quality."""
    docs = fx.table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    rows = docs.join(fx.table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    return M.metric_block(rows.withColumn("score", F.log1p("n_chars")), ["lang"])


BEST = """best AS (SELECT {k}, score AS threshold, correct FROM (SELECT *, ct + pn - cn AS correct,
  row_number() OVER (PARTITION BY {k} ORDER BY ct + pn - cn DESC, score DESC) AS rn FROM r) WHERE rn = 1)"""


@query(
    "best_threshold",
    B.sql(
        B.roc("r", "long", PER),
        BEST.format(k="split, embedding_name"),
        final="SELECT split, embedding_name, round(threshold, 6) + 0.0::DOUBLE AS threshold, correct::BIGINT AS correct FROM best",
    ),
)
def best_threshold(spark, d):
    return M.best_threshold(fx.scores_long(spark, d), PER)


THRESHOLD = """tm AS (SELECT l.embedding_name, any_value(b.threshold) AS threshold,
  count(*) FILTER (score >= threshold AND label = 1)::DOUBLE AS tp, count(*) FILTER (score >= threshold AND label = 0)::DOUBLE AS fp,
  count(*) FILTER (score < threshold AND label = 0)::DOUBLE AS tn, count(*) FILTER (score < threshold AND label = 1)::DOUBLE AS fn
  FROM ev l JOIN best b ON b.embedding_name = l.embedding_name GROUP BY 1),
tq AS (SELECT embedding_name, threshold, (tp+tn)/(tp+fp+tn+fn) AS accuracy, tp/nullif(tp+fp,0) AS precision, tp/nullif(tp+fn,0) AS recall,
  fp/nullif(fp+tn,0) AS far, fn/nullif(fn+tp,0) AS frr FROM tm),
tf AS (SELECT *, CASE WHEN precision+recall > 0 THEN 2*precision*recall/(precision+recall) END AS f1 FROM tq)"""


@query(
    "threshold_metrics",
    B.sql(
        "sel AS (SELECT * FROM long WHERE split = 'validation')",
        "ev AS (SELECT * FROM long WHERE split = 'test')",
        B.roc("r", "sel", [ENC]),
        BEST.format(k=ENC),
        THRESHOLD,
        final=B.pick("tf", [ENC], ["threshold", "accuracy", "precision", "recall", "f1", "far", "frr"]),
    ),
)
def threshold_metrics(spark, d):
    """Threshold chosen on validation, evaluated on test."""
    best = M.best_threshold(fx.scores_long(spark, d, ("validation",)), [ENC])
    return M.threshold_metrics(fx.scores_long(spark, d, ("test",)), [ENC], best)


WEIGHTS = """wts AS (SELECT embedding_name, (1/greatest(eer, 1e-4::DOUBLE)) / sum(1/greatest(eer, 1e-4::DOUBLE)) OVER () AS weight
  FROM e WHERE split = 'calibration')"""


@query(
    "eer_weights",
    B.sql(B.roc("r", "long", PER), B.eer("e", "r", PER), WEIGHTS, final=B.pick("wts", [ENC], ["weight"])),
)
def eer_weights(spark, d):
    cal = fx.scores_long(spark, d, ("calibration",))
    return M.eer_weights(cal, ["split"], ENC).select(ENC, "weight")


@query(
    "balanced_weights",
    B.sql(
        final="""SELECT trial_id, label, split,
  round(1e6::DOUBLE * 0.5::DOUBLE / count(*) OVER (PARTITION BY split, label), 6) + 0.0::DOUBLE AS weight_ppm FROM usable"""
    ),
)
def balanced_weights(spark, d):
    t = fx.trials(spark, d).filter(F.col("split") != P.UNUSED).select("trial_id", "label", "split")
    w = M.balanced_weights(t, ["split"])
    return _int_label(w).select("trial_id", "label", "split", (F.lit(1e6) * F.col("weight")).alias("weight_ppm"))


def _sliced(name: str, groups: str, keys: list[str]) -> list[str]:
    """CTEs of a sliced report over rel(keys, grouping, grp, label, llr, accepted)."""
    by = [*keys, "grouping", "grp"]
    k = ", ".join(by)
    using = " AND ".join(f"s.{c} = b.{c}" for c in by)
    cols = ", ".join(f"b.{c} AS accepted_{c}" for c in ["target_n", "nontarget_n", *B.DOUBLES])
    return [
        groups,
        "acc AS (SELECT * FROM grouped WHERE accepted)",
        B.block("b", "acc", by, "llr"),
        f"""sizes AS (SELECT {k}, count(*) AS group_n, sum(label)::BIGINT AS group_target_n,
  (count(*) - sum(label))::BIGINT AS group_nontarget_n, count(*) FILTER (accepted) AS accepted_n,
  count(*) FILTER (NOT accepted) AS rejected_n, count(*) FILTER (accepted)/count(*)::DOUBLE AS coverage
  FROM grouped GROUP BY {k})""",
        f"{name} AS (SELECT s.*, {cols} FROM sizes s LEFT JOIN b ON {using})",
    ]


SLICE_PLAIN = ["group_n", "group_target_n", "group_nontarget_n", "accepted_n", "rejected_n", "accepted_target_n", "accepted_nontarget_n"]
SLICE_DOUBLES = ["coverage", *B.accepted()]


@query(
    "metrics_by_language",
    B.sql(
        *_sliced(
            "rep",
            """grouped AS (SELECT split, 'language' AS grouping, unnest(['all', CASE WHEN target = 1 THEN 'same_language'
    ELSE 'cross_language' END]) AS grp, label, llr, true AS accepted FROM llrs)""",
            ["split"],
        ),
        final=B.pick("rep", ["split", "grouping", "grp", *SLICE_PLAIN], SLICE_DOUBLES),
    ),
)
def metrics_by_language(spark, d):
    t = fx.llr_trials(spark, d, extra=("language_condition",))
    t = t.withColumn("target", (F.col("language_condition") == "same_language").cast("int")).withColumn(
        "accepted", F.lit(True)
    )
    return A.sliced_report(t, A.condition_groups(), ["split"])


SYSTEMS = ["enc1", "enc2", "fused", "fused_reject"]
SYS_SQL = """thr AS (SELECT quantile_cont(greatest(1/(1+exp(-llr)), 1-1/(1+exp(-llr))), 0.2) AS thr FROM llrs WHERE split = 'validation'),
systems AS (SELECT l.*, x.system, x.v AS value, CASE WHEN x.system = 'fused_reject'
    THEN greatest(1/(1+exp(-llr)), 1-1/(1+exp(-llr))) >= thr ELSE true END AS accepted
  FROM (SELECT * FROM llrs WHERE split = 'test') l, thr,
  LATERAL (SELECT unnest([{'system': 'enc1', 'v': score_enc1}, {'system': 'enc2', 'v': score_enc2},
    {'system': 'fused', 'v': llr}, {'system': 'fused_reject', 'v': llr}], recursive := true)) x)"""


def four_systems(spark, d):
    """Test trials under four systems; the last abstains below a validation threshold."""
    meta = ("enroll_speaker", "language_pair", "language_condition", "enroll_duration_sec", "test_duration_sec")
    t = fx.scored(spark, d, extra=meta).withColumn("llr", fx.llr_column())
    t = materialise(t.select("split", "trial_id", "label", *meta, "score_enc1", "score_enc2", "llr"))
    val = D.confidence(t.filter("split = 'validation'").select("split", "llr"))
    # one row: the abstention threshold chosen on validation
    thr = D.confidence_thresholds(val, ["split"], {"thr": 0.8}).first()["thr"]
    test = D.confidence(t.filter("split = 'test'"))
    named = F.explode(
        F.array(
            *[
                F.struct(F.lit(n).alias("system"), F.col(c).alias("value"), ok.alias("accepted"))
                for n, c, ok in [
                    ("enc1", "score_enc1", F.lit(True)),
                    ("enc2", "score_enc2", F.lit(True)),
                    ("fused", "llr", F.lit(True)),
                    ("fused_reject", "llr", F.col("confidence") >= F.lit(thr)),
                ]
            ]
        )
    ).alias("s")
    rows = test.select("trial_id", "label", *meta, named)
    return rows.select("trial_id", "label", *meta, "s.system", F.col("s.value").alias("llr"), "s.accepted")


@query(
    "by_language_pair",
    B.sql(
        SYS_SQL,
        *_sliced(
            "rep",
            """grouped AS (SELECT system, label, value AS llr, accepted, g.grouping, g.grp FROM systems,
    LATERAL (SELECT unnest([{'grouping': 'language_condition', 'grp': language_condition},
      {'grouping': 'language_pair', 'grp': language_pair}], recursive := true)) g)""",
            ["system"],
        ),
        final=B.pick("rep", ["system", "grouping", "grp", *SLICE_PLAIN], SLICE_DOUBLES),
    ),
)
def by_language_pair(spark, d):
    return A.sliced_report(four_systems(spark, d), A.language_groups(), ["system"])


@query(
    "by_duration",
    B.sql(
        SYS_SQL,
        *_sliced(
            "rep",
            """du AS (SELECT *, least(enroll_duration_sec, test_duration_sec) AS lo,
    least(enroll_duration_sec, test_duration_sec)/greatest(enroll_duration_sec, test_duration_sec) AS ra FROM systems),
grouped AS (SELECT system, label, value AS llr, accepted, g.grouping, g.grp FROM du,
    LATERAL (SELECT unnest([{'grouping': 'min_duration_sec', 'grp': CASE WHEN lo < 3 THEN 'short_<3'
      WHEN lo < 10 THEN 'medium_3_to_<10' ELSE 'long_>=10' END}, {'grouping': 'duration_ratio', 'grp': CASE WHEN ra < 0.5 THEN
      'severe_<0.5' WHEN ra < 0.8 THEN 'moderate_0.5_to_<0.8' ELSE 'matched_>=0.8' END}], recursive := true)) g)""",
            ["system"],
        ),
        final=B.pick("rep", ["system", "grouping", "grp", *SLICE_PLAIN], SLICE_DOUBLES),
    ),
)
def by_duration(spark, d):
    return A.sliced_report(four_systems(spark, d), A.duration_groups(), ["system"])


@query(
    "duration_center",
    B.sql(
        """both_d AS (SELECT split, enroll_duration_sec AS x FROM trials UNION ALL SELECT split, test_duration_sec FROM trials)""",
        """c AS (SELECT split, 'median' AS strategy, quantile_cont(x, 0.5) AS center FROM both_d GROUP BY split
  UNION ALL SELECT split, 'mean', avg(x) FROM both_d GROUP BY split
  UNION ALL SELECT split, 'geomean', exp(avg(ln(x))) FROM both_d GROUP BY split)""",
        final=B.pick("c", ["split", "strategy"], ["center"]),
    ),
)
def duration_center(spark, d):
    t = fx.trials(spark, d).select("split", "enroll_duration_sec", "test_duration_sec")
    parts = [
        P.duration_center(t, ["split"], s).select("split", F.lit(s).alias("strategy"), "center")
        for s in ("median", "mean", "geomean")
    ]
    return P.union_all(parts)


_DELTA = ["eer_pct", "cllr", "act_dcf_p001", "act_dcf_p01"]


@query(
    "control_delta",
    B.sql(
        B.block("f", "llrs", ["split"], "llr"),
        B.block("c", "llrs", ["split"], "score_enc1"),
        "dl AS (SELECT f.split, "
        + ", ".join(f"f.{m} AS full_{m}, c.{m} AS control_{m}, c.{m} - f.{m} AS delta_{m}" for m in _DELTA)
        + " FROM f JOIN c ON c.split = f.split AND c.n = f.n)",
        final=B.pick("dl", ["split"], [f"{p}_{m}" for p in ("full", "control", "delta") for m in _DELTA]),
    ),
)
def control_delta(spark, d):
    """Single-encoder control minus the fused system on the same trials."""
    t = fx.scored(spark, d).withColumn("llr", fx.llr_column()).select("split", "label", "llr", "score_enc1")
    t = materialise(t)
    full = M.metric_block(t, ["split"], "llr")
    return A.control_delta(full, M.metric_block(t, ["split"], "score_enc1"), ["split"], _DELTA, settings=("n",))


@query(
    "ci95",
    B.sql(
        "v AS (SELECT split, embedding_name, score, CASE WHEN score < 0 THEN NULL ELSE ln(score + 1) END AS y FROM long)",
        """q AS (SELECT split, embedding_name, (quantile_cont(score, 0.975) - quantile_cont(score, 0.025))/2 AS score_ci95,
  (quantile_cont(y, 0.975) - quantile_cont(y, 0.025))/2 AS y_ci95 FROM v GROUP BY 1, 2)""",
        final=B.pick("q", PER, ["score_ci95", "y_ci95"]),
    ),
)
def ci95(spark, d):
    """Half width of the central 95% band, here by distributed exact quantiles."""
    from ..operators.ranking import quantiles

    t = materialise(fx.scored(spark, d, ids=False).select("split", "label", *[f"score_{e}" for e in fx.ENCODERS]))
    v = J.unpivot_scores(t, fx.ENCODERS, ["split", "label"]).withColumn("y", F.when(F.col("score") >= 0, F.log(F.col("score") + 1.0)))
    half = lambda c: ((F.col(f"{c}_hi") - F.col(f"{c}_lo")) / 2.0).alias(f"{c}_ci95")
    parts = [
        quantiles(v, PER, c, {f"{c}_lo": 0.025, f"{c}_hi": 0.975}).select(*PER, half(c)) for c in ("score", "y")
    ]
    return parts[0].join(parts[1], PER)


REPS = 5


@query(
    "bootstrap_fixed",
    B.sql(
        f"""rep AS (SELECT split, label, llr, r.replicate,
    ('0x' || substr(sha256(cast(r.replicate AS VARCHAR) || '|' || trial_id), 1, 8))::BIGINT % 4 AS w
  FROM llrs, (SELECT unnest(range(1, {REPS + 1})) AS replicate) r)""",
        B.block("b", "rep", ["replicate", "split"], "llr", "w"),
        final=B.pick("b", ["replicate", "split", *B.COUNTS], B.DOUBLES),
    ),
)
def bootstrap_fixed(spark, d):
    """Replicates under reproducible hash weights: the exact check of weighted metrics."""
    return R.bootstrap_fixed(fx.llr_trials(spark, d), ["split"], "llr", REPS)


@query("bootstrap_metrics")
def bootstrap_metrics(spark, d):
    """1000 exact multinomial resamples of the trials of each split."""
    return R.bootstrap_metrics(fx.llr_rows(spark, d), ["split"], "llr", description="fused llr")


def _decided(spark, d, trials=fx.llr_rows):
    t = D.confidence(trials(spark, d))
    return t.withColumn("decision", D.decide(F.col("posterior"), F.col("confidence"), F.lit(0.8)))


@query("bootstrap_decisions")
def bootstrap_decisions(spark, d):
    """1000 multinomial resamples of the six decision cells."""
    return R.bootstrap_decisions(_decided(spark, d), ["split"], description="fused decisions")


_FIXED_W = "('0x' || substr(sha256(cast(r.replicate AS VARCHAR) || '|' || {by}), 1, 8))::BIGINT % 4 AS w"


@query(
    "bootstrap_decisions_fixed",
    B.sql(
        f"""rep AS (SELECT split, label, r.replicate, CASE WHEN greatest(1/(1+exp(-llr)), 1-1/(1+exp(-llr))) < 0.8 THEN 'reject'
    WHEN 1/(1+exp(-llr)) >= 0.5 THEN 'target' ELSE 'nontarget' END AS decision, {_FIXED_W.format(by='trial_id')}
  FROM llrs, (SELECT unnest(range(1, {REPS + 1})) AS replicate) r)""",
        "copies AS (SELECT split, label, replicate, decision, unnest(range(w)) AS copy FROM rep)",
        B.decisions("dm", "copies", ["replicate", "split"]),
        final=B.pick("dm", ["replicate", "split", *B.DECISION_COUNTS], B.DECISION_DOUBLES),
    ),
)
def bootstrap_decisions_fixed(spark, d):
    """Decision metrics of replicates under reproducible hash weights."""
    out = R.bootstrap_decisions_fixed(_decided(spark, d, fx.llr_trials), ["split"], REPS)
    return out.select("replicate", "split", *B.DECISION_COUNTS, *B.DECISION_DOUBLES)


def _two_systems(spark, d):
    t = four_systems(spark, d).filter(F.col("system").isin("enc1", "fused"))
    return t.withColumn("split", F.lit("test"))


@query("paired_cluster_bootstrap")
def paired_cluster_bootstrap(spark, d):
    """Two systems on the test trials, enrollment speakers resampled together."""
    return R.paired_cluster_bootstrap(_two_systems(spark, d), ["split"], "enroll_speaker", "system", ("enc1", "fused"), samples=1000)


@query(
    "bootstrap_cluster_fixed",
    B.sql(
        SYS_SQL,
        f"""rep AS (SELECT system, label, value AS llr, r.replicate, {_FIXED_W.format(by='enroll_speaker')}
  FROM systems, (SELECT unnest(range(1, {REPS + 1})) AS replicate) r WHERE system IN ('enc1', 'fused'))""",
        "used AS (SELECT * FROM rep WHERE w > 0)",
        B.block("b", "used", ["replicate", "system"], "llr", "w"),
        final=B.pick("b", ["replicate", "system"], R.CI_METRICS),
    ),
)
def bootstrap_cluster_fixed(spark, d):
    """The passes of the paired bootstrap under reproducible cluster weights."""
    t = _two_systems(spark, d)
    weights = R.fixed_cluster_weights(t, "enroll_speaker", REPS)
    return R.cluster_replicates(t, ["system"], "enroll_speaker", weights, REPS).select(
        "replicate", "system", *[F.round(m, 6).alias(m) for m in R.CI_METRICS]
    )


RED = list(A.METRIC_FAMILIES)


def _red(e: str, m: str) -> str:
    a, b = f"a.{e}", f"b.{e}"
    own = lambda v: f"list_transform({v}, lambda x: x - list_avg({v}))"
    la, lb = (f"ln(sqrt(list_inner_product({v}, {v})) + 1e-12::DOUBLE)" for v in (a, b))
    cos, l2 = f"list_cosine_similarity({a}, {b})", f"list_sum(list_transform(list_zip({a}, {b}), lambda x: (x[1]-x[2])*(x[1]-x[2])))"
    return {
        "cosine": cos,
        "dot_raw": f"list_inner_product({a}, {b})",
        "neg_l2_raw": f"-sqrt({l2})",
        "neg_sq_l2_raw": f"-{l2}",
        "neg_l1_raw": f"-list_sum(list_transform(list_zip({a}, {b}), lambda x: abs(x[1]-x[2])))",
        "pearson_corr": f"list_cosine_similarity({own(a)}, {own(b)})",
        "angular_similarity_diagnostic": f"1 - acos(least(greatest({cos}, -1), 1))/pi()",
        "rbf_similarity_diagnostic": f"exp(-{l2})",
        "log_norm_enroll": la,
        "log_norm_test": lb,
        "log_norm_product": f"{la} + {lb}",
        "abs_log_norm_ratio": f"abs({la} - {lb})",
        "min_log_norm": f"least({la}, {lb})",
        "max_log_norm": f"greatest({la}, {lb})",
    }[m]


_RED_NAMES = sorted(RED)
_RED_PAIRS = list(dict.fromkeys([(m, "cosine") for m in _RED_NAMES] + [(a, b) for i, a in enumerate(_RED_NAMES) for b in _RED_NAMES[i + 1 :]]))


@query(
    "metric_redundancy",
    B.sql(
        "tall AS MATERIALIZED ("
        + " UNION ALL ".join(
            f"SELECT '{e}' AS encoder, u.trial_id, "
            + ", ".join(f"{_red(e, m)} AS {m}" for m in RED)
            + " FROM usable u JOIN emb a ON a.utterance = u.enroll_utt JOIN emb b ON b.utterance = u.test_utt"
            for e in fx.ENCODERS
        )
        + ")",
        "rk AS MATERIALIZED (SELECT *, "
        + ", ".join(
            f"rank() OVER (PARTITION BY encoder ORDER BY {m}) + (count(*) OVER (PARTITION BY encoder, {m}) - 1)/2.0::DOUBLE AS r_{m}"
            for m in RED
        )
        + " FROM tall)",
        "prs AS ("
        + " UNION ALL ".join(
            f"SELECT encoder, '{a}' AS metric, '{b}' AS reference_metric, corr({a}, {b}) AS pearson, "
            f"corr(r_{a}, r_{b}) AS spearman, count(*) AS finite_count, count(DISTINCT {a}) AS unique_value_count, "
            f"'{A.METRIC_FAMILIES[a][0]}' AS family, {int(A.METRIC_FAMILIES[a][1])} AS diagnostic_only FROM rk GROUP BY encoder"
            for a, b in _RED_PAIRS
        )
        + ")",
        final="""SELECT encoder, metric, reference_metric, round(pearson, 6) + 0.0::DOUBLE AS pearson,
  round(spearman, 6) + 0.0::DOUBLE AS spearman, finite_count, unique_value_count, family, diagnostic_only,
  CASE WHEN metric <> reference_metric AND abs(spearman) > 0.9999 THEN 1 ELSE 0 END AS redundant FROM prs""",
    ),
)
def metric_redundancy(spark, d):
    from ..operators.scoring import similarity_columns

    t = fx.trials(spark, d).filter(F.col("split") != P.UNUSED).select("trial_id", "enroll_utt", "test_utt")
    size = {"rows": fx.utterance_count(spark, d), "dim": fx.ENC_DIM}
    wide = similarity_columns(t, fx.embeddings_wide(spark, d), fx.ENCODERS, RED, **size)
    per = F.explode(
        F.array(
            *[
                F.struct(F.lit(e).alias("encoder"), *[F.col(f"score__{e}__{m}").alias(m) for m in RED])
                for e in fx.ENCODERS
            ]
        )
    ).alias("x")
    return A.metric_redundancy(materialise(wide.select("trial_id", per).select("trial_id", "x.*")), RED)


@query(
    "best_config",
    B.sql(
        "val AS (SELECT * FROM long WHERE split = 'validation')",
        B.block("b", "val", [ENC]),
        final=B.pick("b", [ENC, *B.COUNTS], B.DOUBLES, "ORDER BY cllr, act_dcf_p01, eer_pct LIMIT 1"),
    ),
)
def best_config(spark, d):
    val = fx.scores_long(spark, d, ("validation",))
    return A.best_config(M.metric_block(val, [ENC]))
