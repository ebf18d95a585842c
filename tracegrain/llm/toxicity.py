"""Toxicity by a classifier chain (Read et al., 2009) of logistic models.

The categories are predicted one after the other.  Each category's model sees
the words of a text and the probabilities of the categories before it.  In
training those are out-of-fold: a document's probability comes from a model
fitted without the document's fold, so later models learn to rely on earlier
ones as much as these deserve on new documents.

A text's features are its distinct words (ASCII punctuation ends a word, A-Z are
lower-cased) and their first four, five and six bytes, each present or not, and
what share of the text is capitals, digits, punctuation and repeated words, in
steps.  The FEATURES that tell the categories apart best, by chi-squared over
the sample, are used.

The models are fitted on a bounded sample, the SAMPLE labelled documents whose
hashed doc_id is smallest; every document is scored whole.

Defined cases: a null or empty text has no features; a null label teaches
nothing for its category; a document labelled twice counts twice in training;
labels without a document are passed over; without labelled documents every
probability is 0 and nothing is flagged; rows that repeat are scored alike; other
columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE, FEATURES, FOLDS = 8_000, 1000, 3
PREFIXES = (4, 5, 6)
THRESHOLD = 0.5
_CLEAN = bytes.maketrans((string.ascii_uppercase + string.punctuation).encode(), (string.ascii_lowercase + " " * len(string.punctuation)).encode())


#: Shares at which a step of a text's shape begins.
STEPS = (0.02, 0.05, 0.1, 0.2, 0.4, 0.7)
_SHAPES = (b"capitals", string.ascii_uppercase.encode()), (b"digits", string.digits.encode()), (b"marks", string.punctuation.encode())


def shape(text: bytes, n_words: int, n_distinct: int) -> set[bytes]:
    """Marks of the steps that a text's shares have passed; a colon at both ends tells them from words."""
    shares = [(name, 1 - len(text.translate(None, kind)) / len(text)) for name, kind in _SHAPES]
    shares.append((b"repeats", 1 - n_distinct / n_words if n_words else 0.0))
    return {b":%s:%d:" % (name, i) for name, share in shares for i, step in enumerate(STEPS) if share >= step}


def features(text: bytes | None) -> set[bytes]:
    """A text's distinct words, their beginnings behind a mark, and its shape."""
    if not text:
        return set()
    flat = text.translate(_CLEAN).split()
    words = set(flat)
    found = words | shape(text, len(flat), len(words))
    for n in PREFIXES:
        found |= {b"%d:" % n + w[:n] for w in words if len(w) >= n}
    return found


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 2e-4, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient descent on the mean loss with an l2 penalty on the weights.

    Positives, if they are the rarer, count by the root of the odds against
    them, so that a single telling word can decide.
    """
    n, d = x.shape
    positive = float(y.sum())
    weight = np.where(y > 0, np.float32(np.sqrt(max(1.0, min(100.0, (n - positive) / max(positive, 1.0))))), np.float32(1.0))
    w, b = np.zeros(d, np.float32), 0.0
    vw, vb = w.copy(), b
    step = 4.0 / max(1.0, float(((x * x).sum(1) + 1.0) @ weight) / n)
    for i in range(rounds):
        off = (1.0 / (1.0 + np.exp(-(x @ vw + vb))) - y) * weight
        nw = vw - step * (x.T @ off / n + l2 * vw)
        nb = vb - step * float(off.mean())
        pull = i / (i + 3.0)
        vw, vb, w, b = nw + pull * (nw - w), nb + pull * (nb - b), nw, nb
    return w, b


def chances(x: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-(x @ w + b)))


@dataclass
class Chain:
    """Models in the order of the categories; model i has a weight for each feature and each of i earlier categories."""

    categories: list[str]
    vocabulary: dict[bytes, int]
    weights: list[np.ndarray] = field(default_factory=list)
    biases: list[float] = field(default_factory=list)

    def fit(self, x: np.ndarray, labels: np.ndarray, fold: np.ndarray) -> Chain:
        """labels: a row a document and a column a category, NaN for unknown; fold: 0 to FOLDS - 1."""
        for i in range(len(self.categories)):
            y, known = labels[:, i], ~np.isnan(labels[:, i])
            out = np.zeros(len(x), np.float32)
            for k in range(FOLDS):
                train, test = known & (fold != k), fold == k
                if train.any() and test.any():
                    out[test] = chances(x[test], *fit_logistic(x[train], y[train].astype(np.float32)))
            w, b = fit_logistic(x[known], y[known].astype(np.float32)) if known.any() else (np.zeros(x.shape[1], np.float32), -100.0)
            self.weights.append(w)
            self.biases.append(b)
            x = np.column_stack([x, out])
        return self

    def score(self, sets: list[set[bytes]]) -> np.ndarray:
        """A row a text and a column a category."""
        n = len(self.vocabulary)
        names = self.vocabulary.keys()
        base = np.array([w[:n] for w in self.weights]).T
        out = np.zeros((len(sets), len(self.categories)))
        for r, found in enumerate(sets):
            at = [self.vocabulary[f] for f in found & names]
            logits = base[at].sum(0) if at else np.zeros(len(self.categories))
            for i, (w, b) in enumerate(zip(self.weights, self.biases, strict=True)):
                z = float(logits[i] + w[n:] @ out[r, :i] + b)
                out[r, i] = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
        return out


def train(docs: DataFrame, labels: DataFrame, categories: list[str], sample: int = SAMPLE, n_features: int = FEATURES, id_col: str = "doc_id", text_col: str = "text") -> Chain | None:
    """A chain fitted on `sample` labelled documents at most; labels has the id and a 0/1 column for each category."""
    marks = [F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(categories)]
    chosen = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), *marks).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = common.stage(chosen, "toxicity-sample")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    width = len(categories)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[f.decode("latin-1") for f in sorted(features(text))] for text in common.values(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.string())), *batch.columns[2:]], ["doc_id", "features", *[f"c{i}" for i in range(width)]])

    schema = "doc_id long, features array<string>, " + ", ".join(f"c{i} double" for i in range(width))
    known = common.stage(rows.mapInArrow(read, schema), "toxicity-features")
    totals = known.agg(F.count("*").alias("n"), *[F.sum(f"c{i}").alias(f"p{i}") for i in range(width)]).first()
    if not totals.n:
        return None
    seen = known.select(F.explode("features").alias("f"), *[f"c{i}" for i in range(width)]).groupBy("f").agg(F.count("*").alias("df"), *[F.sum(f"c{i}").alias(f"t{i}") for i in range(width)])
    # chi-squared of a feature and a category, summed over the categories
    chi = F.lit(0.0)
    for i in range(width):
        p = float(totals[f"p{i}"] or 0) / totals.n
        if 0 < p < 1:
            expected = F.col("df") * p
            chi = chi + F.pow(F.coalesce(F.col(f"t{i}"), F.lit(0.0)) - expected, 2) / (expected * (1 - p))
    best = seen.where("df >= 3").select("f", chi.alias("chi")).orderBy(F.desc("chi"), "f").limit(n_features).collect()
    vocabulary = {r.f.encode("latin-1"): i for i, r in enumerate(best)}
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [[sent.value[f.encode("latin-1")] for f in own if f.encode("latin-1") in sent.value] for own in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.list_(pa.int32())), *batch.columns[2:]], ["doc_id", "at", *[f"c{i}" for i in range(width)]])

    data = known.mapInArrow(index, schema.replace("features array<string>", "at array<int>")).toPandas().sort_values("doc_id", kind="stable")
    x = np.zeros((len(data), len(vocabulary)), np.float32)
    for r, at in enumerate(data["at"]):
        x[r, at] = 1.0
    fold = (data["doc_id"].to_numpy(np.int64) * 2654435761 >> 16) % FOLDS
    return Chain(list(categories), vocabulary).fit(x, data[[f"c{i}" for i in range(width)]].to_numpy(float), fold)


def classify(docs: DataFrame, chain: Chain | None, categories: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the probability p_<category> of each category for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sent.value
        for batch in batches:
            out = np.zeros((batch.num_rows, len(names)))
            if found is not None:
                sets: list[set[bytes]] = []
                for i, text in enumerate(common.values(batch.column(1))):
                    sets.append(features(text) & found.vocabulary.keys())
                    if len(sets) == 1000 or i + 1 == batch.num_rows:
                        out[i + 1 - len(sets) : i + 1] = found.score(sets)
                        sets = []
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(c)) for c in out.T]], ["doc_id", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"`{n}` double" for n in names))
