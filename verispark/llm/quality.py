"""Quality rules combined by weak supervision, DataFrame functions only.

Every rule votes on a document: 1 (bad), 0 (good) or null (abstains).  Expectation
maximisation over the counts of vote patterns (at most 3 to the number of rules,
whatever the input) estimates for each rule how often it says "bad" on good and on
bad documents; the posterior probability of being bad decides.  No rule has to
pass by itself, and no label is used.

Counts of repeated windows come from one array per document: hashes of its 8-word
windows, sorted with their positions only where some hash occurs twice.

A null text has no words; it fails the base rules like any short text.  Repeated
rows are judged alike and count as often as they occur.  An empty table gives an
empty table.  Very long texts are handled whole in O(n log n).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20

# Frequent function words of four languages.
STOP_WORDS = (
    "the of and to in is that it was for on are with as be at this by from or an not have "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch "
    "le la les de des et un une du en que qui dans pour par sur pas au avec est "
    "el los las del y se por con su para es al lo como mi"
).split()


@dataclass(frozen=True)
class Rule:
    """Votes bad where the feature reaches ``bad``, good where it stays below ``good``."""

    name: str
    feature: str
    good: float
    bad: float


RULES = (
    Rule("symbols", "n_symbols / n_words", 0.05, 0.2),
    Rule("repeats", "n_repeat_words / n_words", 0.05, 0.3),
    Rule("duplicate_lines", "n_dup_lines / n_lines", 0.1, 0.4),
    Rule("upper_case", "n_upper / word_chars", 0.15, 0.4),
    Rule("exclamations", "n_exclaimed / n_words", 0.05, 0.3),
    Rule("echoes", "n_echoes / n_words", 0.1, 0.4),
    # prose has many function words, lists and shouting have few
    Rule("few_function_words", "1 - n_stop_words / n_words", 0.92, 0.96),
    Rule("few_distinct_words", "sqrt(n_words) / n_distinct_words", 0.35, 0.5),
    Rule("word_length", "abs(word_chars / n_words - 6)", 3.5, 8.0),
)

#: Where the estimation starts, and the strength (share of all documents) of that belief.
START = {"bad": 0.1, "says_bad_on_good": 0.01, "says_bad_on_bad": 0.4}
BELIEF = 0.005


def features(documents: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` and the numbers that rules look at, for every whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    first = documents.select(*keys, text.alias("_text"), F.array_remove(F.split(text, SPACE), "").alias("_words"))
    windows = F.when(
        F.size("_words") >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.greatest(F.size("_words") - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("_words", i, WINDOW))),
    )
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    without = lambda c: F.length("_text") - F.length(c)
    second = first.select(
        *keys,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        without(F.translate("_text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        without(F.regexp_replace("_text", r"\p{Lu}+", "")).cast("long").alias("n_upper"),
        without(F.replace(F.col("_text"), F.lit("!"), F.lit(""))).cast("long").alias("n_exclaimed"),
        F.size(F.filter("_words", lambda x, i: x == F.get("_words", i - 1))).cast("long").alias("n_echoes"),
        F.size(F.filter("_words", lambda x: x.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct_words"),
        lines.alias("_lines"),
        windows.alias("_windows"),
    )
    located = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    third = second.select(
        *[c for c in second.columns if c not in ("_lines", "_windows")],
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.array_sort(located)).alias("_sorted"),
    )
    same = lambda e, other: F.coalesce(e["h"] == other["h"], F.lit(False))
    again = F.filter("_sorted", lambda e, i: same(e, F.get("_sorted", i - 1)) | same(e, F.get("_sorted", i + 1)))
    fourth = third.withColumn("_again", F.array_sort(F.transform(again, lambda e: e["i"]))).drop("_sorted")
    return fourth.withColumn("n_repeat_words", F.coalesce(_covered("_again"), F.lit(0)).cast("long")).drop("_again")


def _covered(starts: str) -> Column:
    """Words in windows that begin at the given sorted positions."""
    begin = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total"))
    step = lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(WINDOW), p - a["last"])).alias("total"))
    return F.aggregate(starts, begin, step, lambda a: a["total"])


def votes(table: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds one column ``vote_<rule>`` per rule: 1 bad, 0 good, null abstains."""
    cols = {}
    for rule in rules:
        value = F.expr(f"case when n_words > 0 then {rule.feature} end")
        cols[f"vote_{rule.name}"] = F.when(value >= rule.bad, F.lit(1)).when(value <= rule.good, F.lit(0))
    return table.withColumns(cols)


@dataclass(frozen=True)
class Model:
    bad: float
    on_good: tuple[float, ...]  #: P(says bad | votes, good)
    on_bad: tuple[float, ...]

    def weights(self) -> tuple[float, list[tuple[float, float]]]:
        """Log odds of being bad: the prior's, and for each rule those of a bad and of a good vote."""
        log = math.log
        pairs = [(log(b / g), log((1 - b) / (1 - g))) for g, b in zip(self.on_good, self.on_bad)]
        return log(self.bad / (1 - self.bad)), pairs


def estimate(patterns: list[tuple[tuple, int]], n_rules: int, steps: int = 50) -> Model:
    """Expectation maximisation over (votes, number of documents)."""
    total = sum(n for _, n in patterns)
    model = Model(START["bad"], (START["says_bad_on_good"],) * n_rules, (START["says_bad_on_bad"],) * n_rules)
    if not total:
        return model
    belief = BELIEF * total
    for _ in range(steps):
        prior, pairs = model.weights()
        bad = belief * START["bad"]
        said = [[[belief * START[k], belief] for k in ("says_bad_on_good", "says_bad_on_bad")] for _ in range(n_rules)]
        for vote, n in patterns:
            odds = prior + sum(pairs[r][0] if v else pairs[r][1] for r, v in enumerate(vote) if v is not None)
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            bad += n * p
            for r, v in enumerate(vote):
                if v is not None:
                    for side, share in enumerate((1 - p, p)):
                        said[r][side][0] += n * share * v
                        said[r][side][1] += n * share
        model = Model(bad / (total + belief), *[tuple(s[side][0] / s[side][1] for s in said) for side in (0, 1)])
    return model


def log_odds(model: Model, rules: tuple[Rule, ...] = RULES) -> Column:
    prior, pairs = model.weights()
    out = F.lit(prior)
    for rule, (says_bad, says_good) in zip(rules, pairs):
        vote = F.col(f"vote_{rule.name}")
        out = out + F.when(vote == 1, says_bad).when(vote == 0, says_good).otherwise(0.0)
    return out


def judge(documents: DataFrame, rules: tuple[Rule, ...] = RULES, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys``, the features, ``base_failed``, ``p_bad`` and ``kept`` of every document.

    The table of votes is written: it is read for the counts of vote patterns and for
    the decision, and later filters must not be pushed into the array expressions.
    """
    table = written(votes(features(documents, keys), rules))
    names = [f"vote_{r.name}" for r in rules]
    patterns = [(tuple(r[n] for n in names), r["n"]) for r in table.groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).collect()]
    odds = log_odds(estimate(patterns, len(rules)), rules)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = table.withColumn("base_failed", failed).withColumn("p_bad", 1 / (1 + F.exp(-odds)))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("p_bad") < 0.5))


def keep_good(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that the rules keep, with their own columns.

    Verdicts are looked up by id and a hash of the text, so only small rows are
    written, and equal rows share a verdict.
    """
    text_hash = F.xxhash64(F.col("text").cast("string"))
    judged = judge(documents.select(F.col("doc_id").alias("_id"), text_hash.alias("_hash"), "text"), rules, ("_id", "_hash"))
    kept = judged.filter("kept").select("_id", "_hash").distinct()
    whole = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_doc"), F.col("doc_id").alias("_my_id"), text_hash.alias("_my_hash"))
    same = F.col("_my_id").eqNullSafe(F.col("_id")) & (F.col("_my_hash") == F.col("_hash"))
    return whole.join(kept, same, "left_semi").select("_doc.*")
