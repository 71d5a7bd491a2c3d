"""Multi-enrollment groups: several enrollments of one claimed speaker against one test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import array_mean, array_std, array_sum, binary_entropy, hash_key, sigmoid
from .ranking import text_rank, top_n_per_group

GROUP_KEY = ["split", "enroll_speaker", "test_utt", "test_speaker", "label"]

# Feature names per encoder (five enrollments).
FEATURES = [
    *[f"score_sorted_{i}" for i in range(1, 6)],
    "score_mean",
    "score_median",
    "score_min",
    "score_max",
    "score_std",
    "vote_frac",
    "vote_entropy",
    "post_mean",
    "post_std",
    "post_entropy_mean",
    "post_entropy_max",
]


def _grouped_trials(trials: DataFrame) -> DataFrame:
    ok = F.col("label").isNotNull() & (F.col("enroll_utt") != F.col("test_utt"))
    for c in ("trial_id", "enroll_utt", "test_utt", "enroll_speaker", "test_speaker"):
        ok = ok & F.col(c).isNotNull() & (F.trim(c) != "")
    return trials.filter(ok).select(*GROUP_KEY, "enroll_utt", "trial_id")


def too_few_enrollments(trials: DataFrame, enroll_count: int = 5) -> DataFrame:
    """Per split and label, how many groups have fewer than ``enroll_count`` trials."""
    sizes = _grouped_trials(trials).groupBy(*GROUP_KEY).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") < enroll_count)
    return sizes.groupBy("split", "label").agg(F.count(F.lit(1)).alias("too_few_enrollments"))


def enrollment_groups(trials: DataFrame, enroll_count: int = 5, seed: str = "groups_v1") -> DataFrame:
    """Groups with at least ``enroll_count`` trials and the chosen enrollments.

    Empty ids and self pairs are skipped.  Enrollments are the lowest salted
    hashes (ties by trial_id); ``source_pairs`` is the size before choosing.
    """
    used = _grouped_trials(trials)
    used = used.withColumn(
        "pick", hash_key(F.lit(seed), F.lit("enroll"), *[F.col(k) for k in GROUP_KEY], F.col("enroll_utt"))
    )
    sizes = used.groupBy(*GROUP_KEY).agg(F.count(F.lit(1)).alias("source_pairs"))
    sizes = sizes.filter(F.col("source_pairs") >= enroll_count)
    chosen = top_n_per_group(used, GROUP_KEY, [F.col("pick"), F.col("trial_id")], enroll_count, spread=["trial_id"])
    slots = F.array_sort(F.collect_list(F.struct("row_number", "enroll_utt", "trial_id")))  # enroll_count entries
    grouped = chosen.groupBy(*GROUP_KEY).agg(slots.alias("slots"))
    out = grouped.join(sizes, GROUP_KEY)
    names = F.array_join(F.transform("slots", lambda s: s["enroll_utt"]), "\x1f")
    return out.withColumn(
        "group_hash", hash_key(F.lit(seed), F.lit("group"), *[F.col(k) for k in GROUP_KEY], names)
    )


def select_groups(
    groups: DataFrame,
    *,
    per_claim_label: int = 200,
    per_nontarget_pair: int = 20,
    per_split_label: int | None = None,
) -> DataFrame:
    """Apply the caps in hash order; adds ``drop_reason`` (NULL = selected).

    Taking groups greedily in hash order while no cap is full equals filtering
    by rank first inside the narrowest key, then inside the wider ones.  A
    dropped group's reason is the first full cap it met: a cap is full once the
    hash of its last admitted group has passed.
    """
    order = [F.col("group_hash")]
    spread = ["group_hash"]
    pair_key, claim_key, wide_key = ["split", "enroll_speaker", "test_speaker"], ["split", "enroll_speaker", "label"], ["split", "label"]
    non = groups.filter(F.col("label") == 0)
    kept = top_n_per_group(non, pair_key, order, per_nontarget_pair, spread=spread).drop("row_number")
    kept = kept.unionByName(groups.filter(F.col("label") == 1))
    kept = top_n_per_group(kept, claim_key, order, per_claim_label, spread=spread).drop("row_number")
    if per_split_label is not None:
        kept = top_n_per_group(kept, wide_key, order, per_split_label, spread=spread).drop("row_number")

    def full_after(keys: list[str], cap: int, name: str) -> DataFrame:
        size = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max("group_hash").alias(name))
        return size.filter(F.col("_n") >= cap).drop("_n")

    flags = kept.select("split", "group_hash", F.lit(1).alias("_kept"))
    out = groups.join(flags, ["split", "group_hash"], "left")
    out = out.join(full_after(claim_key, per_claim_label, "_claim_full"), claim_key, "left")
    reason = F.when(F.col("_kept") == 1, F.lit(None))
    if per_split_label is not None:
        out = out.join(full_after(wide_key, per_split_label, "_wide_full"), wide_key, "left")
        reason = reason.when(F.col("group_hash") > F.col("_wide_full"), F.lit("split_label_cap"))
    reason = reason.when(F.col("group_hash") > F.col("_claim_full"), F.lit("speaker_label_cap"))
    out = out.withColumn("drop_reason", reason.otherwise(F.lit("speaker_pair_cap")))
    return out.drop("_kept", "_claim_full", "_wide_full")


def selection_summary(selected: DataFrame) -> DataFrame:
    return selected.groupBy("split", "label").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(F.col("drop_reason").isNull()).alias("selected"),
        F.count_if(F.col("drop_reason") == "speaker_label_cap").alias("speaker_label_cap"),
        F.count_if(F.col("drop_reason") == "speaker_pair_cap").alias("speaker_pair_cap"),
        F.count_if(F.col("drop_reason") == "split_label_cap").alias("split_label_cap"),
    )


def slots_of(groups: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """One row per (group, position), with ``extra`` columns of the group; a trial filling two slots fails the query."""
    rows = groups.select("group_hash", "split", "label", *extra, F.explode("slots").alias("s"))
    rows = rows.select("group_hash", "split", "label", *extra, F.col("s.row_number").alias("position"), "s.enroll_utt", "s.trial_id")
    uses = F.count(F.lit(1)).over(W.partitionBy("trial_id"))
    fail = F.raise_error(F.concat(F.lit("trial fills more than one slot: "), F.col("trial_id"))).cast("string")
    return rows.withColumn("_uses", uses).withColumn("trial_id", F.when(F.col("_uses") == 1, F.col("trial_id")).otherwise(fail)).drop("_uses")


def dictionaries(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dense 0-based ids, in name order, of the speakers and utterances in use."""
    sides = groups.select(
        F.explode(
            F.concat(
                F.array(F.struct(F.col("test_utt").alias("utterance"), F.col("test_speaker").alias("speaker"))),
                F.transform(
                    "slots",
                    lambda s: F.struct(s["enroll_utt"].alias("utterance"), F.col("enroll_speaker").alias("speaker")),
                ),
            )
        ).alias("x")
    ).select("x.*")
    both = groups.select(F.explode(F.array("enroll_speaker", "test_speaker")).alias("speaker"))
    people = text_rank(both.distinct(), [], "speaker", name="_r").select(
        (F.col("_r") - 1).alias("speaker_id"), "speaker"
    )
    utts = text_rank(sides.distinct(), [], "utterance", name="_r").select(
        (F.col("_r") - 1).alias("utterance_id"), "utterance", "speaker"
    )
    return people, utts.join(people, "speaker").select("utterance_id", "speaker_id", "utterance")


def group_scores(groups: DataFrame, scores: DataFrame, encoders: Sequence[str], enroll_count: int = 5) -> DataFrame:
    """Per group and encoder the scores of its slots; a missing score raises.

    ``scores`` is long: (trial_id, embedding_name, score).  The rows come from the
    slots, so an encoder without any score for a group raises too.
    """
    slots = slots_of(groups).withColumn("embedding_name", F.explode(F.array(*map(F.lit, encoders))))
    joined = slots.join(scores.select("trial_id", "embedding_name", "score").filter("score is not null"), ["trial_id", "embedding_name"], "left")
    joined = joined.withColumn("position", F.when(F.col("score").isNotNull(), F.col("position")))
    cells = joined.groupBy("group_hash", "split", "label", "embedding_name").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("score").isNotNull(), F.struct("position", "score")))), lambda s: s["score"]).alias("scores")
    )
    bad = F.raise_error(F.concat(F.lit("missing scores for group "), F.col("group_hash"))).cast("array<double>")
    return cells.withColumn("scores", F.when(F.size("scores") == enroll_count, F.col("scores")).otherwise(bad))


def group_features(cells: DataFrame, threshold: Column, platt_a: Column, platt_b: Column, enroll_count: int = 5):
    """Summary features of each group's scores.

    ``threshold`` is the encoder's EER threshold (votes), ``platt_a``/``platt_b``
    its logistic posterior.
    """
    s = F.sort_array("scores")
    post = F.transform("scores", lambda x: sigmoid(platt_a * x + platt_b))
    base = cells.withColumns({"_s": s, "_p": post})
    k = enroll_count
    mid = [F.get("_s", F.lit((k - 1) // 2)), F.get("_s", F.lit(k // 2))]
    votes = F.size(F.filter("scores", lambda x: x >= threshold)) / F.lit(float(k))
    ent = F.transform("_p", lambda p: binary_entropy(p))
    ids = [c for c in cells.columns if c != "scores"]
    return base.select(
        *ids,
        *[F.get("_s", F.lit(i)).alias(f"score_sorted_{i + 1}") for i in range(k)],
        array_mean(F.col("_s")).alias("score_mean"),
        ((mid[0] + mid[1]) / 2.0).alias("score_median"),
        F.get("_s", F.lit(0)).alias("score_min"),
        F.get("_s", F.lit(k - 1)).alias("score_max"),
        array_std(F.col("_s")).alias("score_std"),
        votes.alias("vote_frac"),
        binary_entropy(votes).alias("vote_entropy"),
        array_mean(F.col("_p")).alias("post_mean"),
        array_std(F.col("_p")).alias("post_std"),
        (array_sum(ent) / F.lit(float(k))).alias("post_entropy_mean"),
        F.array_max(ent).alias("post_entropy_max"),
    )


def pair_scores(cells: DataFrame, keys: Sequence[str] = ("embedding_name",)) -> DataFrame:
    """Single (score, label) rows of the calibration groups' slots."""
    return cells.filter(F.col("split") == "calibration").select(*keys, "label", F.explode("scores").alias("score"))
