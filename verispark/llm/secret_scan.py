"""Secret scan: candidates from every whole text, false positives removed by a random forest.

Candidates are runs of key-like characters that hold a digit or are long, and,
whatever their characters and length, the values after introducing words and the
user and password inside URLs.  A value without quotes is taken up to the next blank,
and also without closing punctuation and up to the first delimiter; candidates may
overlap.  The features of a candidate are its length and character mix, how usual its character
transitions are, how much of it dictionary words cover, its path (the source) and
the words beside it.  Transitions and dictionary are counted over all documents, in
tables of fixed size.

The forest is trained on labelled findings: candidates whose whole form is known
to be a secret or known to be harmless.  The labels come from ``labelled`` (a
parameter), the forest never sees the forms.  At most ``SAMPLE`` findings of each
label, chosen by hash, are used for the fit; everything is scored.

Defined results: null and empty texts have no findings; repeated rows repeat
theirs; null sources are a path of their own; without findings of both labels every
score is the share of secrets among the labelled (0.5 if there are none).  An empty
table gives an empty table.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import Words, array_sums, task_part, text_slices, written

CANDIDATE = re.compile(r"[A-Za-z0-9+/_\-]{8,}")
LONG = 24
BESIDE = 32
SAMPLE = 20_000
WORD_BITS = 20
#: A dictionary word makes up at least this share of all words (by its hash bucket).
DICTIONARY_SHARE = 2e-5

# Words that introduce a secret, and forms of keys of known providers.
INTRODUCING = re.compile(r"(?i)(pass(word|wd|phrase)?|token|secret|key|auth|bearer|credential|pwd|api|private|access)\W{0,4}$")
KNOWN_SECRETS = [
    re.compile(r"AKIA[0-9A-Z]{16}"),
    re.compile(r"gh[pousr]_[0-9A-Za-z]{36,}"),
    re.compile(r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    re.compile(r"AIza[0-9A-Za-z_-]{35}"),
]
#: An introducing word (perhaps inside a name that goes on for up to 128 characters) and what may stand between it and its value.
_NAME = r"(?i:pass(?:word|wd|phrase)?|token|secret|key|auth|bearer|credential|pwd|api|private|access)[\w\-]{0,128}[\"'`)\]}]{0,2}"
_SET = r"\s*(?:=>|:=|==|[=:])\s*"
INTRODUCED = re.compile(rf"{_NAME}(?:{_SET}|\s+)(?=\S)")
QUOTED = {q: re.compile(rf"{q}((?:\\.|[^{q}\\\n])+){q}") for q in "\"'`"}
NONBLANK = re.compile(r"\S+")
DELIMITER = re.compile(r"[&,;\"'`<>(){}\[\]]")
CLOSING = ".,;:)]}>\"'`"
URL_CREDENTIALS = re.compile(r"://([^\s/:@]*)(?::([^\s/]*))?@")
#: The text before a value that was set or stands in a URL: there even plain words may be secrets.
VALUED = re.compile(rf"{_NAME}{_SET}[\"'`]?$|://[^\s/:@]*:?$")
ASSIGNED = re.compile(r"(?i)\b(password|passwd|pwd|token|secret|api_?key)\s*[=:]\s*[\"']?$")
RANDOM_FORM = re.compile(r"(?=.*\d)([0-9a-f]{16,}|[0-9A-F]{16,}|(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z+/_-]{16,})")
HARMLESS = [re.compile(r"[\d\-/]+"), re.compile(r"[^\W\d_]+"), re.compile(r"[A-Za-z]+\d{1,4}"), re.compile(r"\d{4}-\d\d-\d\d.*")]


def labelled(candidate: str, before: str) -> int | None:
    """1 for a finding known to be a secret, 0 for one known to be harmless, else None."""
    if any(f.fullmatch(candidate) for f in KNOWN_SECRETS) or ASSIGNED.search(before) and RANDOM_FORM.fullmatch(candidate):
        return 1
    if VALUED.search(before):
        return None
    return 0 if any(f.fullmatch(candidate) for f in HARMLESS) else None


# --- statistics of the corpus --------------------------------------------------------------


def _statistics_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    moves, words = np.zeros(1 << 14, np.int64), np.zeros(1 << WORD_BITS, np.int64)
    for part in text_slices(batches):
        w = Words(part.column("text"))
        data = np.minimum(w.data, 127).astype(np.int64)
        moves += np.bincount(data[:-1] * 128 + data[1:], minlength=1 << 14)
        words += np.bincount((w.hash >> np.uint64(64 - WORD_BITS)).astype(np.int64), minlength=1 << WORD_BITS)
    if words.any():
        arrays = [moves, *np.split(words, 16)]
        yield pa.RecordBatch.from_arrays([pa.array(range(17), pa.int64()), pa.array([task_part()] * 17, pa.int64()), pa.array([a.tobytes() for a in arrays])], ["key", "part", "values"])


class Statistics:
    """Log probabilities of character transitions, and which hash buckets hold dictionary words."""

    def __init__(self, moves: np.ndarray, words: np.ndarray):
        table = moves.reshape(128, 128) + 0.01
        self.log_move = np.log(table / table.sum(axis=1, keepdims=True))
        self.frequent = np.packbits(words >= max(5, DICTIONARY_SHARE * words.sum()))

    def is_word(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0, bool)
        at = (Words(pa.array(words)).hash >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        return (self.frequent[at >> 3] >> (7 - (at & 7))) & 1 == 1


def statistics(documents: DataFrame) -> Statistics:
    rows = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(_statistics_rows, "key long, part long, values binary")
    sums = array_sums(rows, "i8")
    if not sums:
        return Statistics(np.zeros(1 << 14, np.int64), np.zeros(1 << WORD_BITS, np.int64))
    return Statistics(sums[0], np.concatenate([sums[k] for k in range(1, 17)]))


# --- candidates and features ---------------------------------------------------------------

FEATURES = [
    "length", "digits", "upper", "lower", "other", "hexadecimal", "distinct", "class_changes", "move_mean", "move_low",
    "word_coverage", "path", "introduced", "assigned", "quoted", "glued_before", "glued_after", "before_word", "after_word", "before_letters",
]


def find(text: str) -> Iterator[tuple[int, int]]:
    spans = {m.span() for m in CANDIDATE.finditer(text) if m.end() - m.start() >= LONG or any(c.isdigit() for c in m[0])}
    spans.update(_values(text))
    for m in URL_CREDENTIALS.finditer(text):
        spans.update(m.span(k) for k in (1, 2) if m[k])
    yield from sorted(spans)


def _values(text: str) -> Iterator[tuple[int, int]]:
    """Values after introducing words.

    The first value of a run without blanks may go to its end; later ones of the run
    end before the next introducing word, so that all together are no longer than the text.
    """
    found = list(INTRODUCED.finditer(text))
    run = 0  # end of the last run looked at
    for m, following in zip(found, [*found[1:], None]):
        a = m.end()
        if text[a] in QUOTED:
            if q := QUOTED[text[a]].match(text, a):
                yield q.span(1)
                continue
            a += 1
        if a >= run:
            whole = NONBLANK.match(text, a)
            if not whole:
                continue
            b = run = whole.end()
        else:
            b = min(run, following.start()) if following else run
        cut = DELIMITER.search(text, a, b)
        for end in {b, a + len(text[a:b].rstrip(CLOSING)), cut.start() if cut else b}:
            if end > a:
                yield a, end


def _bucket(text: str, n: int) -> int:
    import zlib

    return zlib.crc32(text.encode()) % n


def features(found: list[tuple[str, str, str, str | None]], stats: Statistics) -> np.ndarray:
    """A row for each (candidate, text before, text after, path)."""
    out = np.zeros((len(found), len(FEATURES)))
    runs = [re.findall(r"[A-Z]?[a-z]{2,}|[A-Z]{3,}", c) for c, *_ in found]
    known = stats.is_word([w for ws in runs for w in (x.lower() for x in ws)])
    at = 0
    for row, (c, before, after, path), ws in zip(out, found, runs):
        n = len(c)
        code = np.minimum(np.frombuffer(c.encode(), np.uint8), 127)
        kind = np.where((code >= 48) & (code < 58), 0, np.where((code >= 65) & (code < 91), 1, np.where((code >= 97) & (code < 123), 2, 3)))
        moves = stats.log_move[code[:-1], code[1:]] if len(code) > 1 else np.zeros(1)
        covered = sum(len(w) for w, k in zip(ws, known[at : at + len(ws)]) if k)
        at += len(ws)
        previous, following = before.split(), after.split()
        row[:11] = [
            n, *(np.bincount(kind, minlength=4) / len(code)), bool(re.fullmatch(r"[0-9a-fA-F]+", c)), len(set(c)) / n, np.count_nonzero(np.diff(kind)) / n,
            moves.mean(), np.percentile(moves, 10), covered / n,
        ]
        row[11:] = [
            -1 if path is None else _bucket(path, 64), bool(INTRODUCING.search(before)), before.rstrip("\"' ")[-1:] in ("=", ":"), before[-1:] in ("'", '"'),
            bool(before) and not before[-1:].isspace(), bool(after) and not after[:1].isspace(), _bucket(previous[-1], 32) if previous else -1,
            _bucket(following[0], 32) if following else -1, sum(map(str.isalpha, before)),
        ]
    return out


FINDINGS = "doc_id long, start long, end long, candidate string, label int, features array<double>"


def _finding_rows(batches: Iterator[pa.RecordBatch], stats: Statistics, label: Callable) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        where, found, labels = [], [], []
        for doc, text, path in zip(*(part.column(c) for c in ("doc_id", "text", "source"))):
            text = text.as_py()
            if text:
                doc, path = doc.as_py(), path.as_py()
                for a, b in find(text):
                    where.append((doc, a, b))
                    found.append((text[a:b], text[max(0, a - BESIDE) : a], text[b : b + BESIDE], path))
                    labels.append(label(text[a:b], found[-1][1]))
        values = features(found, stats)
        columns = [pa.array(c, pa.int64()) for c in (zip(*where) if where else [()] * 3)]
        table = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * len(FEATURES), pa.int32()), pa.array(values.ravel()))
        yield pa.RecordBatch.from_arrays([*columns, pa.array([f[0] for f in found], pa.string()), pa.array(labels, pa.int32()), table], [c.split()[0] for c in FINDINGS.split(", ")])


# --- forest --------------------------------------------------------------------------------


class Forest:
    """Random forest on binned features: bootstrap samples, random feature subsets, Gini splits."""

    def __init__(self, trees: int = 30, depth: int = 9, bins: int = 32, least: int = 4, seed: int = 5):
        self.n_trees, self.depth, self.bins, self.least, self.seed = trees, depth, bins, least, seed
        self.trees: list[np.ndarray] = []
        self.constant = 0.5

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        if not len(y):
            return self
        self.constant = float(y.mean())
        if not 0 < self.constant < 1:
            return self
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(cut, c, side="left") for cut, c in zip(self.cuts, x.T)], axis=1)
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        random = np.random.default_rng(self.seed)
        for _ in range(self.n_trees):
            chosen = random.integers(0, len(y), len(y))
            nodes: list[list[float]] = []
            self._grow(binned, y, weight, chosen, self.depth, random, nodes)
            self.trees.append(np.array(nodes))
        return self

    def _grow(self, x, y, w, rows, depth, random, nodes) -> int:
        """Adds a node [feature, bin, left, right, value] and returns its index."""
        me = len(nodes)
        total, good = w[rows].sum(), (w[rows] * y[rows]).sum()
        nodes.append([-1, 0, 0, 0, good / total])
        if depth == 0 or len(rows) < 2 * self.least or good <= 0 or good >= total:
            return me
        best = (1e-9, None)
        for f in random.choice(x.shape[1], max(1, int(x.shape[1] ** 0.5)), replace=False):
            n = np.bincount(x[rows, f], w[rows], self.bins)
            p = np.bincount(x[rows, f], w[rows] * y[rows], self.bins)
            count = np.cumsum(np.bincount(x[rows, f], minlength=self.bins))
            ln, lp = np.cumsum(n), np.cumsum(p)
            rn, rp = total - ln, good - lp
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = good * (1 - good / total) - np.nan_to_num(lp * (1 - lp / ln)) - np.nan_to_num(rp * (1 - rp / rn))
            gain[(count < self.least) | (len(rows) - count < self.least)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (int(f), k))
        if best[1] is None:
            return me
        f, k = best[1]
        left = x[rows, f] <= k
        nodes[me][:2] = f, k
        nodes[me][2] = self._grow(x, y, w, rows[left], depth - 1, random, nodes)
        nodes[me][3] = self._grow(x, y, w, rows[~left], depth - 1, random, nodes)
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.full(len(x), self.constant)
        binned = np.stack([np.searchsorted(cut, c, side="left") for cut, c in zip(self.cuts, x.T)], axis=1)
        total, every = np.zeros(len(x)), np.arange(len(x))
        for tree in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                feature = tree[at, 0].astype(np.int64)
                go = feature >= 0
                left = binned[every, np.maximum(feature, 0)] <= tree[at, 1]
                at = np.where(go, np.where(left, tree[at, 2], tree[at, 3]).astype(np.int64), at)
            total += tree[at, 4]
        return total / len(self.trees)


def train(findings: DataFrame, sample: int = SAMPLE) -> Forest:
    """A forest from at most ``sample`` findings of each label, chosen by hash."""
    order = F.xxhash64("candidate", "doc_id", "start")
    rows = [findings.filter(F.col("label") == k).select(order.alias("h"), "label", "features").orderBy("h", "features").limit(sample).collect() for k in (0, 1)]
    both = [r for part in rows for r in part]
    x = np.array([r.features for r in both]).reshape(len(both), len(FEATURES))
    return Forest().fit(x, np.array([r.label for r in both], np.float64))


def _score_rows(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, len(FEATURES))
        score = pa.array(forest.predict(x))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "end", "candidate", "label")), score], ["doc_id", "start", "end", "candidate", "label", "score"])


def scan(documents: DataFrame, label: Callable = labelled, threshold: float = 0.5) -> DataFrame:
    """Every candidate (doc_id, start, end in code points, candidate, label) with its score and verdict."""
    context = documents.sparkSession.sparkContext
    docs = documents.select(*[F.col(c).cast(t).alias(c) for c, t in (("doc_id", "long"), ("text", "string"), ("source", "string"))])
    stats = context.broadcast(statistics(docs))
    findings = written(docs.mapInArrow(lambda it: _finding_rows(it, stats.value, label), FINDINGS))
    forest = context.broadcast(train(findings))
    scored = findings.mapInArrow(lambda it: _score_rows(it, forest.value), "doc_id long, start long, end long, candidate string, label int, score double")
    return scored.withColumn("secret", F.col("score") >= threshold)
