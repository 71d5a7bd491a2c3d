"""License scan: Aho-Corasick over words, and a shunting-yard parser for license expressions.

A text becomes its words (lower-cased A-Z; runs of digits, letters and non-ASCII
characters) with one space around each.  One Aho-Corasick automaton finds all
phrases in it, overlapping ones too: names of licenses, wordings of notices,
introducing words such as "licensed under" and identifier tags such as
"SPDX-License-Identifier".

What follows a tag and a sign of assignment on its line is read as an expression: identifiers joined by
``and``, ``or`` and ``with`` in any case, and parentheses.  A shunting-yard parser
turns operators into reverse order on a stack (``with`` binds closest, then ``and``,
then ``or``) and evaluates on the way: an operand carries the duties of its license
(``DUTIES``), ``or`` leaves the lighter duties to choose, ``and`` adds up to the heavier,
``with`` lightens copyleft by an exception.  Reading ends at the first token that
cannot follow; an expression that ends in an operator is read up to there, open
parentheses are closed at its end.  Stacks and lists only grow with the line.

Every document is read whole, in one pass without a shuffle.  Matches come from C
code; only matches and tagged lines cost Python steps.

Defined results: a null or empty text has no words and no findings; null ids and
repeated rows are scanned one by one; an empty table gives an empty one; other
columns do not matter.  ``score`` is 1 minus the product of (1 - weight) over the
distinct kinds of evidence found: 0 without any.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import text_slices

#: Phrases whose places are counted, and their labels (fixed values).
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Further phrases that name a license, and their labels.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "boost software license": "bsl",
    "artistic license": "artistic",
    "isc license": "isc",
    "bsd license": "bsd",
    "zlib license": "zlib",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "creative commons zero": "cc0",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "all rights reserved": "proprietary",
}

#: Words that introduce a license; evidence without a label.
INTRODUCTIONS = ("licensed under", "released under", "distributed under", "under the terms of")

#: Tags whose line goes on with an expression.
TAGS = ("spdx license identifier", "license expression")

#: Families of identifiers by prefix (the longest that fits): label and duties.
FAMILIES = {
    "cc0": ("cc0", 0), "unlicense": ("unlicense", 0), "0bsd": ("bsd", 0), "wtfpl": ("wtfpl", 0),
    "mit": ("mit", 1), "apache": ("apache", 1), "bsd": ("bsd", 1), "isc": ("isc", 1), "zlib": ("zlib", 1), "bsl": ("bsl", 1),
    "artistic": ("artistic", 1), "python": ("python", 1), "psf": ("python", 1), "cc-by": ("cc-by", 1),
    "mpl": ("mpl", 2), "lgpl": ("lgpl", 2), "epl": ("epl", 2), "cddl": ("cddl", 2), "eupl": ("eupl", 2),
    "gpl": ("gpl", 3), "cc-by-sa": ("cc-by-sa", 3), "gfdl": ("gfdl", 3),
    "agpl": ("agpl", 4),
    "cc-by-nc": ("cc-by-nc", 5), "cc-by-nd": ("cc-by-nd", 5), "proprietary": ("proprietary", 5),
}

#: What the numbers mean, from the lightest to the heaviest.
DUTIES = ("none", "notice", "weak copyleft", "copyleft", "network copyleft", "restricted", "unknown")
UNKNOWN = len(DUTIES) - 1
WEAK, STRONG = 2, 4

WEIGHTS = {"tag": 0.9, "base": 0.8, "notice": 0.8, "introduction": 0.4}

FINDING = "struct<kind: string, phrase: string, label: string, word: long, n_words: long>"
EXPRESSION = "struct<expression: string, word: long, labels: array<string>, duties: int>"


@dataclass(frozen=True)
class Rules:
    """Phrases (lower-case words joined by single spaces) with their labels, and weights of evidence."""

    base: dict[str, str] = field(default_factory=lambda: dict(BASE))
    notices: dict[str, str] = field(default_factory=lambda: dict(NOTICES))
    introductions: Sequence[str] = INTRODUCTIONS
    tags: Sequence[str] = TAGS

    def phrases(self) -> dict[str, tuple[str, str | None]]:
        out: dict[str, tuple[str, str | None]] = {p: ("introduction", None) for p in self.introductions}
        out |= {p: ("tag", None) for p in self.tags}
        out |= {p: ("notice", label) for p, label in self.notices.items()}
        return out | {p: ("base", label) for p, label in self.base.items()}


def automaton(rules: Rules):
    """Aho-Corasick automaton over words with one space around each; values: (kind, phrase, label, length, words)."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for phrase, (kind, label) in rules.phrases().items():
        out.add_word(f" {phrase} ", (kind, phrase, label, len(phrase) + 2, phrase.count(" ") + 1))
    out.make_automaton()
    return out


# --- expressions ---------------------------------------------------------------------------

_TOKEN = re.compile(rb"[ \t]*(?:([A-Za-z0-9][A-Za-z0-9.+:-]*)|([()]))")
_ASSIGNED = re.compile(rb"[ \t\"']*[:=][ \t\"'*]*")
_VERSION = re.compile(r"v?\d|[^a-z]|$")
_BINDS = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> tuple[str, int]:
    """Label and duties of an identifier; one of no known family is its own label, of unknown duties."""
    name = identifier.lower()
    fits = [p for p in FAMILIES if name.startswith(p) and _VERSION.match(name, len(p))]
    return FAMILIES[max(fits, key=len)] if fits else (name.rstrip("+.:-"), UNKNOWN)


@dataclass
class Parsed:
    expression: str
    labels: list[str]
    duties: int


def _apply(operator: str, values: list[int]) -> None:
    right, left = values.pop(), values.pop()
    if operator == "or":
        values.append(min(left, right))
    elif operator == "and":
        values.append(max(left, right))
    else:  # an exception to a license that asks for the same license
        values.append(WEAK if WEAK < left <= STRONG else left)


def parse(raw: bytes, at: int = 0) -> Parsed | None:
    """The license expression at a place of a text in UTF-8, up to the end of its line, or None if there is none."""
    values: list[int] = []
    operators: list[str] = []
    read: list[str] = []
    labels: dict[str, None] = {}
    operand = True  # whether an operand comes next
    while token := _TOKEN.match(raw, at):
        word, bracket = (x and x.decode() for x in token.groups())
        whole = word
        name = word.lower() if word else bracket
        if operand and name not in _BINDS and name != ")":
            if bracket:
                if operators and operators[-1] == "with":
                    break
                operators.append("(")
            else:
                word = word.rstrip(".:-") or word
                if operators and operators[-1] == "with":
                    values.append(0)  # an exception, not a license
                else:
                    label, duties = family(word)
                    labels[label] = None
                    values.append(duties)
                operand = False
        elif not operand and name in _BINDS:
            while operators and operators[-1] != "(" and _BINDS[operators[-1]] >= _BINDS[name]:
                _apply(operators.pop(), values)
            operators.append(name)
            operand = True
        elif not operand and name == ")" and "(" in operators:
            while operators[-1] != "(":
                _apply(operators.pop(), values)
            operators.pop()
        else:
            break
        read.append(word.upper() if name in _BINDS else word or bracket)
        at = token.end()
        if word != whole:
            break  # a full stop ended the sentence
    if not values:
        return None
    while operand and read:  # an operator or a bracket without its operand
        read.pop()
        operators.pop()
        operand = bool(read) and (read[-1] == "(" or read[-1].lower() in _BINDS)
    while operators:
        operator = operators.pop()
        if operator == "(":
            read.append(")")
        else:
            _apply(operator, values)
    return Parsed(" ".join(read).replace("( ", "(").replace(" )", ")"), sorted(labels), values[0])


# --- texts ---------------------------------------------------------------------------------

_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _word_ends(raw: bytes) -> np.ndarray:
    """End positions of the words of a text in UTF-8."""
    inside = np.frombuffer(raw.translate(_WORD_BYTES), np.uint8) != 32
    return np.flatnonzero(inside & ~np.append(inside[1:], False)) + 1


class Scanner:
    def __init__(self, rules: Rules):
        self.rules, self._automaton = rules, None

    def __getstate__(self):
        return {"rules": self.rules, "_automaton": None}

    @property
    def machine(self):
        if self._automaton is None:
            self._automaton = automaton(self.rules)
        return self._automaton

    def scan(self, raw: bytes) -> tuple[int, list[tuple], list[tuple]]:
        """Number of words, findings and expressions of a text in UTF-8."""
        words = raw.translate(_WORD_BYTES).split()
        # the automaton reads bytes as characters of one byte; phrases are plain ASCII
        text = (b" " + b" ".join(words) + b" ").decode("latin-1")
        findings, at, word = [], 0, 0
        for end, (kind, phrase, label, length, n_words) in self.machine.iter(text):
            start = end - length + 1
            if start < at:  # a longer phrase that ends here began before the last one
                word -= text.count(" ", start, at)
            else:
                word += text.count(" ", at, start)
            at = start
            findings.append((kind, phrase, label, word, n_words))
        expressions, ends = [], None
        for kind, _, _, first, n_words in findings:
            if kind != "tag":
                continue
            ends = _word_ends(raw) if ends is None else ends
            assigned = _ASSIGNED.match(raw, int(ends[first + n_words - 1]))
            parsed = parse(raw, assigned.end()) if assigned else None
            if parsed is not None:
                expressions.append((parsed.expression, first, parsed.labels, parsed.duties))
        return len(words), findings, expressions


SCANNED = f"n_words long, findings array<{FINDING}>, expressions array<{EXPRESSION}>, score double"

_FINDINGS = pa.list_(pa.struct([("kind", pa.string()), ("phrase", pa.string()), ("label", pa.string()), ("word", pa.int64()), ("n_words", pa.int64())]))
_EXPRESSIONS = pa.list_(pa.struct([("expression", pa.string()), ("word", pa.int64()), ("labels", pa.list_(pa.string())), ("duties", pa.int32())]))


def score_of(findings: list[tuple]) -> float:
    left = 1.0
    for kind, _ in sorted({(kind, label or phrase) for kind, phrase, label, *_ in findings}):
        left *= 1 - WEIGHTS[kind]
    return round(1 - left, 6)


def _scan_rows(batches: Iterator[pa.RecordBatch], scanner: Scanner) -> Iterator[pa.RecordBatch]:
    names = [f.name for f in _FINDINGS.value_type]
    told = [f.name for f in _EXPRESSIONS.value_type]
    for part in text_slices(batches):
        text = part.column("text").fill_null("").cast(pa.binary())
        found = [scanner.scan(x.as_py()) for x in text]
        columns = [
            part.column("row"),
            pa.array([n for n, *_ in found], pa.int64()),
            pa.array([[dict(zip(names, f)) for f in fs] for _, fs, _ in found], _FINDINGS),
            pa.array([[dict(zip(told, e)) for e in es] for *_, es in found], _EXPRESSIONS),
            pa.array([score_of(fs) for _, fs, _ in found], pa.float64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["row", "n_words", "findings", "expressions", "score"])


def scan(documents: DataFrame, rules: Rules | None = None, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keys``, n_words, findings (kind, phrase, label, first word, words), expressions and score of every row."""
    scanner = Scanner(rules or Rules())
    rows = documents.select(F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]).alias("row"), F.col("text").cast("string").alias("text"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, {SCANNED}"
    out = rows.mapInArrow(lambda it: _scan_rows(it, scanner), schema)
    return out.select(*[F.col(f"row.k{i}").alias(k) for i, k in enumerate(keys)], "n_words", "findings", "expressions", "score")


def digest(scanned: DataFrame, *keys: str) -> DataFrame:
    """Counts, places and labels of the base phrases, and all labels, of scanned documents."""
    base = F.filter("findings", lambda f: f["kind"] == "base")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    named = F.filter(F.transform("findings", lambda f: f["label"]), lambda x: x.isNotNull())
    told = F.flatten(F.transform("expressions", lambda e: e["labels"]))
    duties = F.array_max(F.transform("expressions", lambda e: e["duties"]))
    return scanned.select(
        *keys,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda f: f["word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda f: f["word"])).alias("last_word"),
        joined(F.transform(base, lambda f: f["label"])).alias("base_labels"),
        joined(F.concat(named, told)).alias("labels"),
        "score",
        F.get(F.array(*[F.lit(d) for d in DUTIES]), duties).alias("duties"),
    )
