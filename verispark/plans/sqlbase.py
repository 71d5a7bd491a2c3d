"""Building blocks of the checking SQL (DuckDB dialect).

The SQL restates the definitions with plain window functions over whole
partitions; it shares no code with the Spark operators.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from ..operators.metrics import PRIORS
from ..sources.fixtures import ENC_DIM, ENCODERS, LLR_BIAS, LLR_SCALE, SPLIT_SEED


def speaker(v: str) -> str:
    return f"('spk' || lpad(cast({v}//10 AS VARCHAR), 6, '0'))"


def language(v: str) -> str:
    return f"(['en','de','fr','es'][cast({v}%4 AS INTEGER)+1])"


def duration(v: str) -> str:
    return f"(1.0::DOUBLE + ({v}*7919)%190 / 10.0::DOUBLE)"


def utterance(v: str) -> str:
    return f"({speaker(v)} || '/' || {language(v)} || '/' || lpad(cast({v} AS VARCHAR), 6, '0') || '.wav')"


_ENC = ", ".join(f"v[{ENC_DIM * k + 1}:{ENC_DIM * (k + 1)}] AS {e}" for k, e in enumerate(ENCODERS))
_COS = ", ".join(f"list_cosine_similarity(a.{e}, b.{e}) AS score_{e}" for e in ENCODERS)

BASE = f"""WITH
utt AS (
  SELECT e.vec_id, e.label AS vec_label, {speaker('e.vec_id')} AS speaker, {language('e.vec_id')} AS language,
    {duration('e.vec_id')} AS duration_sec, {utterance('e.vec_id')} AS utterance,
    list_transform(list_zip(e.embedding, a.embedding),
      lambda x: x[1]::DOUBLE + 0.8::DOUBLE * x[2]::DOUBLE) AS v
  FROM embeddings e JOIN embeddings a ON a.vec_id = e.vec_id//10*10),
emb AS (SELECT vec_id, utterance, speaker, {_ENC} FROM utt),
ids AS (
  SELECT l.*, s.s, (l_orderkey*13 + l_linenumber*7 + l_suppkey) % (s.s*10) AS enroll_id
  FROM lineitem l, (SELECT count(*)//10 AS s FROM embeddings) s),
list AS (
  SELECT 'dev:' || lpad(cast(l_orderkey AS VARCHAR), 12, '0') || ':' || cast(l_linenumber AS VARCHAR) || ':'
      || lpad(cast(cast(round(l_extendedprice*100) AS BIGINT) AS VARCHAR), 10, '0') AS trial_id,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, enroll_id,
    CASE WHEN l_returnflag = 'R' THEN enroll_id//10*10 + (enroll_id%10 + 1 + l_partkey%9) % 10
      ELSE ((enroll_id//10 + 1 + l_partkey%(s-1)) % s)*10 + l_suppkey%10 END AS test_id
  FROM ids),
protocol AS (
  SELECT trial_id, label, enroll_id, test_id, {utterance('enroll_id')} AS enroll_utt, {utterance('test_id')} AS test_utt,
    {speaker('enroll_id')} AS enroll_speaker, {speaker('test_id')} AS test_speaker,
    {language('enroll_id')} AS enroll_language, {language('test_id')} AS test_language,
    {language('enroll_id')} || '--' || {language('test_id')} AS language_pair,
    CASE WHEN {language('enroll_id')} = {language('test_id')} THEN 'same_language' ELSE 'cross_language' END
      AS language_condition,
    {duration('enroll_id')} AS enroll_duration_sec, {duration('test_id')} AS test_duration_sec
  FROM list),
people AS (SELECT DISTINCT speaker AS speaker_id FROM utt),
ranked AS (
  SELECT speaker_id, sha256('{SPLIT_SEED}' || chr(0) || speaker_id) AS hash_hex,
    row_number() OVER (ORDER BY sha256('{SPLIT_SEED}' || chr(0) || speaker_id), speaker_id) AS hash_rank,
    count(*) OVER () AS n FROM people),
manifest AS (
  SELECT speaker_id, '{SPLIT_SEED}' AS split_seed, hash_hex, hash_rank,
    CASE WHEN hash_rank <= floor(n*0.6) THEN 'calibration'
      WHEN hash_rank <= floor(n*0.6) + floor(n*0.2) THEN 'validation' ELSE 'test' END AS speaker_split
  FROM ranked),
trials AS (
  SELECT p.*, CASE WHEN e.speaker_split = t.speaker_split THEN e.speaker_split ELSE 'unused_cross_split' END AS split,
    CASE WHEN p.language_condition = 'same_language' THEN 1 ELSE 0 END AS target
  FROM protocol p JOIN manifest e ON e.speaker_id = p.enroll_speaker JOIN manifest t ON t.speaker_id = p.test_speaker),
usable AS (SELECT * FROM trials WHERE split <> 'unused_cross_split'),
scored AS (
  SELECT u.*, {_COS} FROM usable u JOIN emb a ON a.utterance = u.enroll_utt JOIN emb b ON b.utterance = u.test_utt),
long AS (
  {' UNION ALL '.join(f"SELECT split, trial_id, label, target, '{e}' AS embedding_name, score_{e} AS score FROM scored" for e in ENCODERS)}),
llrs AS (
  SELECT *, ({' + '.join('score_' + e for e in ENCODERS)}) / 6.0::DOUBLE * {LLR_SCALE}::DOUBLE + ({LLR_BIAS})::DOUBLE AS llr
  FROM scored)
"""


def sql(*ctes: str, final: str) -> str:
    return BASE + "".join(",\n" + c for c in ctes) + "\n" + final


def r6(expr: str, name: str | None = None) -> str:
    return f"round({expr}, 6) + 0.0::DOUBLE AS {name or expr}"


def pick(rel: str, plain: Sequence[str], doubles: Sequence[str], tail: str = "") -> str:
    return "SELECT " + ", ".join([*plain, *[r6(d) for d in doubles]]) + f" FROM {rel} {tail}"


def _dcf(pmiss: str, pfa: str, prior: float) -> str:
    return f"(({prior!r}::DOUBLE*({pmiss}) + {1.0 - prior!r}::DOUBLE*({pfa})) / {min(prior, 1 - prior)!r}::DOUBLE)"


def softplus(x: str) -> str:
    return f"(greatest({x}, 0.0) + ln(1.0 + exp(-abs({x}))))"


def roc(name: str, rel: str, keys: Sequence[str], score: str = "score", weight: str | None = None) -> str:
    """CTE of operating points per distinct score with the point before."""
    k = ", ".join(keys)
    w = weight or "1"
    return f"""{name}_c AS (
  SELECT {k}, {score} AS score, sum(CASE WHEN label = 1 THEN {w} ELSE 0 END)::DOUBLE AS t,
    sum(CASE WHEN label = 0 THEN {w} ELSE 0 END)::DOUBLE AS n FROM {rel} GROUP BY {k}, {score}),
{name}_r AS (
  SELECT *, sum(t) OVER w AS ct, sum(n) OVER w AS cn, sum(t) OVER (PARTITION BY {k}) AS pt,
    sum(n) OVER (PARTITION BY {k}) AS pn,
    lag(score) OVER (PARTITION BY {k} ORDER BY score DESC) AS prev_score
  FROM {name}_c WHERE t + n > 0
  WINDOW w AS (PARTITION BY {k} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{name} AS (
  SELECT *, CASE WHEN pt > 0 AND pn > 0 THEN (pt-ct)/pt END AS pmiss, CASE WHEN pt > 0 AND pn > 0 THEN cn/pn END AS pfa,
    CASE WHEN pt > 0 AND pn > 0 THEN (pt-(ct-t))/pt END AS prev_pmiss,
    CASE WHEN pt > 0 AND pn > 0 THEN (cn-n)/pn END AS prev_pfa FROM {name}_r)"""


def eer(name: str, roc_name: str, keys: Sequence[str], lead: bool = True) -> str:
    """CTE with eer (fraction) and eer_threshold per group."""
    k = ", ".join(keys)
    value = "prev_pfa + alpha*(pfa - prev_pfa)"
    if not lead:
        value = f"CASE WHEN prev_score IS NULL THEN (pmiss + pfa)/2 ELSE {value} END"
    return f"""{name} AS (
  SELECT {k}, {value} AS eer,
    CASE WHEN prev_score IS NULL THEN score ELSE prev_score + alpha*(score - prev_score) END AS eer_threshold
  FROM (SELECT *, CASE WHEN (prev_pfa-prev_pmiss) - (pfa-pmiss) = 0 THEN 0.0 ELSE
      least(greatest((prev_pfa-prev_pmiss) / ((prev_pfa-prev_pmiss) - (pfa-pmiss)), 0.0), 1.0) END AS alpha
    FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY score DESC) AS rn
      FROM {roc_name} WHERE pfa - pmiss >= 0) WHERE rn = 1))"""


DOUBLES = [
    "eer_pct", "eer_threshold", "cllr", *[f"act_dcf_{t}" for t in PRIORS], *[f"min_dcf_{t}" for t in PRIORS],
    "accuracy", "precision", "recall", "f1",
]
COUNTS = ["n", "target_n", "nontarget_n"]


def block(name: str, rel: str, keys: Sequence[str], score: str = "score", weight: str | None = None) -> str:
    """CTEs ending in ``name``: the full metric block per group."""
    k = ", ".join(keys)
    on = " AND ".join(f"a.{x} IS NOT DISTINCT FROM e.{x}" for x in keys)
    acts, outs = [], []
    for tag, prior in PRIORS.items():
        thr = math.log((1 - prior) / prior)
        acts.append(f"sum(CASE WHEN score < {thr!r}::DOUBLE THEN t ELSE 0 END) AS miss_{tag}")
        acts.append(f"sum(CASE WHEN score >= {thr!r}::DOUBLE THEN n ELSE 0 END) AS fa_{tag}")
        acts.append(f"least(min({_dcf('pmiss', 'pfa', prior)}), 1.0) AS mind_{tag}")
        ok = "tt > 0 AND nn > 0"
        outs.append(f"CASE WHEN {ok} THEN {_dcf(f'miss_{tag}/tt', f'fa_{tag}/nn', prior)} END AS act_dcf_{tag}")
        outs.append(f"CASE WHEN {ok} THEN mind_{tag} END AS min_dcf_{tag}")
    pr, rc = "CASE WHEN tp+fp > 0 THEN tp/(tp+fp) END", "CASE WHEN tp+fn > 0 THEN tp/(tp+fn) END"
    return f"""{roc(name + '_roc', rel, keys, score, weight)},
{eer(name + '_eer', name + '_roc', keys)},
{name}_a AS (
  SELECT {k}, sum(t) AS tt, sum(n) AS nn, sum(t*{softplus('-score')}) AS lt, sum(n*{softplus('score')}) AS ln_,
    sum(CASE WHEN score >= 0 THEN t ELSE 0 END) AS tp, sum(CASE WHEN score >= 0 THEN n ELSE 0 END) AS fp,
    sum(CASE WHEN score < 0 THEN n ELSE 0 END) AS tn, sum(CASE WHEN score < 0 THEN t ELSE 0 END) AS fn,
    {', '.join(acts)} FROM {name}_roc GROUP BY {k}),
{name}_b AS (
  SELECT {', '.join('a.' + x for x in keys)}, (tt+nn)::BIGINT AS n, tt::BIGINT AS target_n, nn::BIGINT AS nontarget_n,
    100.0*e.eer AS eer_pct, e.eer_threshold,
    CASE WHEN tt > 0 AND nn > 0 THEN 0.5*(lt/tt + ln_/nn)/ln(2.0::DOUBLE) END AS cllr, {', '.join(outs)},
    CASE WHEN tt+nn > 0 THEN (tp+tn)/(tt+nn) END AS accuracy, {pr} AS precision, {rc} AS recall
  FROM {name}_a a LEFT JOIN {name}_eer e ON {on}),
{name} AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2*precision*recall/(precision+recall) END AS f1 FROM {name}_b)"""


def accepted(prefix: str = "accepted_") -> list[str]:
    return [prefix + d for d in DOUBLES]


def quantile(expr: str, q: float) -> str:
    return f"quantile_cont({expr}, {q!r})"


def decisions(name: str, rel: str, keys: Sequence[str]) -> str:
    """CTE of decision metrics from rows with label and decision."""
    k = ", ".join(keys)
    return f"""{name} AS (
  SELECT {k}, n, target_n, nontarget_n, accepted_n, rejected_n, accepted_n/n::DOUBLE AS coverage,
    ok/n::DOUBLE AS accuracy, ok/n::DOUBLE AS effective_acc,
    CASE WHEN accepted_n > 0 THEN ok/accepted_n::DOUBLE END AS covered_acc,
    CASE WHEN nontarget_n > 0 THEN fa/nontarget_n::DOUBLE END AS far,
    CASE WHEN target_n > 0 THEN miss/target_n::DOUBLE END AS frr
  FROM (SELECT {k}, count(*) AS n, count(*) FILTER (label = 1) AS target_n, count(*) FILTER (label = 0) AS nontarget_n,
      count(*) FILTER (decision <> 'reject') AS accepted_n, count(*) FILTER (decision = 'reject') AS rejected_n,
      count(*) FILTER ((decision = 'target' AND label = 1) OR (decision = 'nontarget' AND label = 0)) AS ok,
      count(*) FILTER (decision = 'target' AND label = 0) AS fa,
      count(*) FILTER (decision <> 'target' AND label = 1) AS miss
    FROM {rel} GROUP BY {k}))"""


DECISION_DOUBLES = ["coverage", "accuracy", "effective_acc", "covered_acc", "far", "frr"]
DECISION_COUNTS = ["n", "target_n", "nontarget_n", "accepted_n", "rejected_n"]
