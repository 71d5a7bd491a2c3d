"""LM scoring by masked pseudo-likelihood.

A small network predicts each word from the two words on either side.  A document's
score is the sum of the conditional log-probabilities of all of its words.

* Words are counted over all documents in 2^20 hash buckets.  A bucket's rank by
  count is its token; the most frequent tokens have embeddings of their own, the
  others share some by frequency.
* P(word | context) = P(class | context) * P(token | class).  Frequent tokens are
  classes by themselves, the rest are cut into classes of equal mass; the second
  factor is a share of the counts.
* Training: ``ROUNDS`` rounds over all documents.  The positions of a document fall
  into ``MASK_ONE_IN`` interleaved sets, and the rounds share the sets among them, so
  every word of every document is a target once; each task runs gradient steps in
  numpy over its own documents, starting from the common weights, and the weights
  are averaged by the number of words.  What the tasks send is added up in two
  rounds of sums; only one set of weights reaches the driver.

Defined results: null texts and texts without words have 0 words and score 0; their
mean is null.  Repeated rows are scored alike.  An empty table gives an empty table.
Other columns are ignored.  Texts are scored whole, in slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import Words, array_sums, task_part, text_slices
from .line_dedup import COUNT_BITS, word_counts

OWN_EMBEDDING, SHARED_EMBEDDING = 4000, 64
OWN_CLASS, CLASSES = 40, 64
DIMENSION, HIDDEN, WINDOW = 16, 32, 2
ROUNDS, MASK_ONE_IN, RATE, BATCH = 2, 8, 0.1, 256
PIECES = 16
OFFSETS = [k for k in range(-WINDOW, WINDOW + 1) if k]


class Vocabulary:
    """Maps word hashes to input ids, classes and log shares inside the class."""

    def __init__(self, counts: np.ndarray):
        order = np.argsort(-counts, kind="stable")
        sorted_counts = counts[order].astype(np.float64) + 1e-3  # unseen buckets are possible too
        rank = np.arange(len(counts))
        rest = np.cumsum(sorted_counts[OWN_CLASS:])
        of_rest = np.minimum((rest - sorted_counts[OWN_CLASS:]) / rest[-1] * (CLASSES - OWN_CLASS), CLASSES - OWN_CLASS - 1).astype(np.int64)
        classes = np.concatenate([np.arange(OWN_CLASS), OWN_CLASS + of_rest])
        mass = np.bincount(classes, sorted_counts, CLASSES)
        band = np.minimum(np.log2(np.maximum(rank, 1) / OWN_EMBEDDING + 1) * 6, SHARED_EMBEDDING - 1).astype(np.int64)
        ids = np.where(rank < OWN_EMBEDDING, rank, OWN_EMBEDDING + band)
        self.input = np.empty(len(counts), np.int16)
        self.cls = np.empty(len(counts), np.uint8)
        self.share = np.empty(len(counts), np.float32)
        self.input[order], self.cls[order], self.share[order] = ids, classes, np.log(sorted_counts / mass[classes])
        self.class_bias = np.log(mass / mass.sum()).astype(np.float32)

    def lookup(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (words.hash >> np.uint64(64 - COUNT_BITS)).astype(np.int64)
        return self.input[at].astype(np.int64), self.cls[at].astype(np.int64), self.share[at]


PAD = OWN_EMBEDDING + SHARED_EMBEDDING


class Network:
    """Embeddings of the words around, one hidden layer, a softmax over classes."""

    SHAPES = {"e": (PAD + 1, DIMENSION), "w": (len(OFFSETS) * DIMENSION, HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, CLASSES), "c": (CLASSES,)}

    def __init__(self, bias: np.ndarray, seed: int = 11):
        random = np.random.default_rng(seed)
        scale = {"e": 0.3, "w": (len(OFFSETS) * DIMENSION) ** -0.5, "b": 0.0, "v": 0.1, "c": 0.0}
        self.p = {k: (random.normal(size=s) * scale[k]).astype(np.float32) for k, s in self.SHAPES.items()}
        self.p["c"] = bias.copy()

    def forward(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = self.p["e"][around].reshape(len(around), -1)
        h = np.tanh(x @ self.p["w"] + self.p["b"])
        z = h @ self.p["v"] + self.p["c"]
        z -= z.max(axis=1, keepdims=True)
        return x, h, z

    def log_probability(self, around: np.ndarray, cls: np.ndarray) -> np.ndarray:
        _, _, z = self.forward(around)
        return z[np.arange(len(cls)), cls] - np.log(np.exp(z).sum(axis=1))

    def gradients(self, around: np.ndarray, cls: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log-probability."""
        x, h, z = self.forward(around)
        d = np.exp(z)
        d /= d.sum(axis=1, keepdims=True)
        d[np.arange(len(cls)), cls] -= 1
        d /= len(cls)
        dh = (d @ self.p["v"].T) * (1 - h * h)
        dx = (dh @ self.p["w"].T).reshape(-1, DIMENSION)
        return {"e": dx, "w": x.T @ dh, "b": dh.sum(axis=0), "v": h.T @ d, "c": d.sum(axis=0)}

    def step(self, around: np.ndarray, cls: np.ndarray, rate: float) -> None:
        g = self.gradients(around, cls)
        np.subtract.at(self.p["e"], around.ravel(), rate * len(cls) ** 0.5 * g.pop("e"))
        for k, v in g.items():
            self.p[k] -= rate * v

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.SHAPES]).astype(np.float64)

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for k, s in self.SHAPES.items():
            n = int(np.prod(s))
            self.p[k] = flat[at : at + n].reshape(s).astype(np.float32)
            at += n
        return self


def contexts(ids: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Input ids around the words ``at``; beyond a text stands the padding id."""
    out = np.empty((len(at), len(OFFSETS)), np.int64)
    for k, offset in enumerate(OFFSETS):
        other = at + offset
        inside = (other >= 0) & (other < len(ids))
        other = np.where(inside, other, at)
        out[:, k] = np.where(inside & (row[other] == row[at]), ids[other], PAD)
    return out


def _train_rows(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, weights: np.ndarray, turn: int, rounds: int = ROUNDS) -> Iterator[pa.RecordBatch]:
    network, seen = Network(vocabulary.class_bias).load(weights), 0
    for part in text_slices(batches, limit=1 << 20):
        words = Words(part.column("text"))
        ids, cls, _ = vocabulary.lookup(words)
        within = np.arange(len(words)) - words.first[words.row]
        # which positions are targets depends on the text and the round alone; the rounds divide all of them
        shift = words.hash[words.first[words.row]] % np.uint64(MASK_ONE_IN) if len(words) else np.zeros(0, np.uint64)
        sets = min(rounds, MASK_ONE_IN)
        at = np.flatnonzero((within + shift.astype(np.int64)) % MASK_ONE_IN % sets == turn % sets)
        np.random.default_rng(turn).shuffle(at)
        around = contexts(ids, words.row, at)
        for k in range(0, len(at), BATCH):
            network.step(around[k : k + BATCH], cls[at[k : k + BATCH]], RATE)
        seen += len(at)
    if seen:
        pieces = np.array_split(np.append(network.flat() * seen, seen), PIECES)  # summed in as many tasks
        keys, part = pa.array(range(PIECES), pa.int64()), pa.array([task_part()] * PIECES, pa.int64())
        yield pa.RecordBatch.from_arrays([keys, part, pa.array([x.tobytes() for x in pieces])], ["key", "part", "values"])


def train(texts: DataFrame, rounds: int = ROUNDS) -> tuple[Vocabulary, Network]:
    """Vocabulary and network from all texts (column text)."""
    context, schema = texts.sparkSession.sparkContext, "key long, part long, values binary"
    counts = word_counts(texts)
    vocabulary = Vocabulary(counts)
    network = Network(vocabulary.class_bias)
    shared = context.broadcast(vocabulary)
    for turn in range(rounds if counts.any() else 0):
        weights = context.broadcast(network.flat())
        total = array_sums(texts.mapInArrow(lambda it, w=weights, t=turn: _train_rows(it, shared.value, w.value, t, rounds), schema), "f8")
        total = np.concatenate([total[k] for k in range(PIECES)])
        network.load(total[:-1] / total[-1])
    return vocabulary, network


def _score_rows(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, network: Network) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches, limit=1 << 20):
        words = Words(part.column("text"))
        ids, cls, share = vocabulary.lookup(words)
        log_p = share.astype(np.float64)
        for a in range(0, len(words), 1 << 15):
            at = np.arange(a, min(a + (1 << 15), len(words)))
            log_p[at] += network.log_probability(contexts(ids, words.row, at), cls[at])
        score = np.bincount(words.row, log_p, part.num_rows) if len(words) else np.zeros(part.num_rows)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(words.first)), pa.array(score)], ["doc_id", "n_words", "log_probability"])


def score(documents: DataFrame, model: tuple[Vocabulary, Network] | None = None) -> DataFrame:
    """doc_id, n_words, log_probability and mean_log_probability of every whole text."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vocabulary, network = model or train(docs.select("text"))
    sent = documents.sparkSession.sparkContext.broadcast((vocabulary, network))
    out = docs.mapInArrow(lambda it: _score_rows(it, *sent.value), "doc_id long, n_words long, log_probability double")
    return out.withColumn("mean_log_probability", F.when(F.col("n_words") > 0, F.col("log_probability") / F.col("n_words")))
