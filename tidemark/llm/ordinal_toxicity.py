"""Toxicity by cumulative-link ordinal regression: P(grade >= k) = logistic(w . x - t_k), one w for all thresholds t_1 < t_2.

Labels only say toxic or not. Grades come from them: 0 is not toxic; toxic documents are 1 or, from the median density
of marker features on, 2. Markers are words and word beginnings that labelled toxic documents hold far more often than
others. x has one entry for each marker that a text holds and the logarithm of their density. The expected severity is
P(grade >= 1) + P(grade >= 2).

The model is fitted on at most ``MAX_TRAINING`` labelled documents (by a hash of the id, so classes keep their shares);
every whole text is scored. Defined results: null or empty text holds no marker; repeated rows are scored each; null labels and labels
without a document teach nothing, of several labels of a document the highest counts; without two classes of labels every
severity is 0; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import Cache

#: The largest number of labelled documents to learn from, and of markers.
MAX_TRAINING, MAX_MARKERS = 20_000, 4096
#: A marker is in so many toxic documents at least, and so many times likelier in them.
LEAST_DOCS, LEAST_LIFT = 4, 6.0
BEGINNINGS, LONGEST = (4, 5, 6), 24
STEPS, RATE, RIDGE = 400, 0.1, 1e-4
#: A document is rejected from this probability of a grade over 0 on.
REJECT = 0.5
SCORES = "doc_id long, severity double, grade int, toxic_probability double, flagged boolean"
_scores = pa.schema([("doc_id", pa.int64()), ("severity", pa.float64()), ("grade", pa.int32()), ("toxic_probability", pa.float64()), ("flagged", pa.bool_())])
_word = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """A word's own feature and those of its beginnings."""
    return [f"={word[:LONGEST]}", *(word[:n] for n in BEGINNINGS if len(word) > n)]


def words(text: bytes) -> list[str]:
    return _word.findall(text.decode().lower())


@dataclass
class Ordinal:
    markers: dict[str, int]
    weights: np.ndarray  # one for each marker, then the density's
    thresholds: np.ndarray

    def __post_init__(self):
        self.known = Cache()

    def hits(self, text: bytes) -> tuple[np.ndarray, float]:
        """The markers in a text, and the logarithm of their density: 1 + words with a marker per 1,000 words."""
        found, known, hit, n = set(), self.known, 0, 0
        counts = Counter(words(text))
        for w, k in counts.items():
            n += k
            own = known.get(w)
            if own is None:
                own = known.add(w, tuple(self.markers[f] for f in features(w) if f in self.markers))
            if own:
                found.update(own)
                hit += k
        return np.array(sorted(found), np.int64), float(np.log1p(1000 * hit / max(n, 1)))

    def exceed(self, text: bytes) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2)."""
        at, density = self.hits(text)
        return 1 / (1 + np.exp(self.thresholds - self.weights[at].sum() - self.weights[-1] * density))


def fit(rows: list[np.ndarray], density: np.ndarray, grade: np.ndarray, markers: dict[str, int]) -> Ordinal:
    """Maximum likelihood with a small ridge, by Adam over all rows at once."""
    m, n = len(markers), len(rows)
    at = np.concatenate([np.repeat(np.arange(n), [len(r) for r in rows])]).astype(np.int64)
    col = np.concatenate(rows).astype(np.int64) if n else np.zeros(0, np.int64)
    par = np.zeros(m + 3)
    par[m + 1], par[m + 2] = 1.0, 0.0  # t_1 and the logarithm of t_2 - t_1
    mean, square = np.zeros_like(par), np.zeros_like(par)
    clean, mild, severe = (grade == k for k in range(3))
    for step in range(1, STEPS + 1):
        eta = np.bincount(at, par[col], minlength=n) + par[m] * density
        gap = np.exp(par[m + 2])
        s1, s2 = (1 / (1 + np.exp(t - eta)) for t in (par[m + 1], par[m + 1] + gap))
        middle = np.maximum(s1 - s2, 1e-12)
        d_eta = np.where(clean, -s1, np.where(severe, 1 - s2, 1 - s1 - s2))
        d1 = np.where(clean, s1, np.where(mild, -s1 * (1 - s1) / middle, 0.0))
        d2 = np.where(mild, s2 * (1 - s2) / middle, np.where(severe, s2 - 1, 0.0))
        grad = np.concatenate([np.bincount(col, d_eta[at], minlength=m)[:m], [(d_eta * density).sum(), (d1 + d2).sum(), d2.sum() * gap]]) / n
        grad[: m + 1] -= RIDGE * par[: m + 1]
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        par += RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    return Ordinal(markers, par[: m + 1], par[m + 1] + np.array([0.0, np.exp(par[m + 2])]))


def training(docs: DataFrame, labels: DataFrame, size: int = MAX_TRAINING) -> DataFrame:
    """doc_id, text and label of at most ``size`` labelled documents, in which the classes keep their shares."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic") > 0).alias("label"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    return common.texts(docs).join(F.broadcast(some), "doc_id").select("doc_id", "text", "label")


def learn(docs: DataFrame, labels: DataFrame, size: int = MAX_TRAINING) -> Ordinal | None:
    sample = common.cut(training(docs, labels, size), "toxicity-sample")
    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return None
    counted = pa.schema([("feature", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            by = {True: Counter(), False: Counter()}
            for text, label in zip(common.as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                by[label].update({f for w in set(words(text)) for f in features(w)})
            keys = list(by[True].keys() | by[False].keys())
            yield common.record(counted, [keys, [by[True][k] for k in keys], [by[False][k] for k in keys]])

    sums = sample.mapInArrow(count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    lift = ((F.col("toxic") + 0.5) / (totals[True] + 1)) / ((F.col("clean") + 0.5) / (totals[False] + 1))
    chosen = sums.where((F.col("toxic") >= LEAST_DOCS) & (lift >= LEAST_LIFT)).orderBy(F.desc("toxic"), "clean", "feature").limit(MAX_MARKERS)
    markers = {r["feature"]: k for k, r in enumerate(chosen.collect())}
    shared = docs.sparkSession.sparkContext.broadcast(markers)
    held = pa.schema([("doc_id", pa.int64()), ("label", pa.bool_()), ("markers", pa.list_(pa.int32())), ("density", pa.float64())])

    def mark(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ordinal(shared.value, np.zeros(0), np.zeros(0))
        for batch in rows:
            found = [model.hits(x) for x in common.as_bytes(batch.column(1))]
            yield common.record(held, [batch.column(0), batch.column(2), [x[0].tolist() for x in found], [x[1] for x in found]])

    rows = sample.mapInArrow(mark, "doc_id long, label boolean, markers array<int>, density double").orderBy("doc_id").toArrow()
    label, density = np.array(rows["label"].to_pylist()), rows["density"].to_numpy()
    grade = np.where(label, 1 + (density >= np.median(density[label])), 0)
    return fit([np.array(x, np.int64) for x in rows["markers"].to_pylist()], density, grade, markers)


def score(docs: DataFrame, model: Ordinal | None) -> DataFrame:
    """Expected severity, likeliest grade, P(grade >= 1) and whether it reaches ``REJECT``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in rows:
            p = np.array([own.exceed(x) if own else (0.0, 0.0) for x in common.as_bytes(batch.column(1))]).reshape(-1, 2)
            each = np.stack([1 - p[:, 0], p[:, 0] - p[:, 1], p[:, 1]], 1)
            yield common.record(_scores, [batch.column(0), p.sum(1), each.argmax(1).astype(np.int32), p[:, 0], p[:, 0] >= REJECT])

    return common.texts(docs).mapInArrow(task, SCORES)


def filter_clean(docs: DataFrame, model: Ordinal | None) -> DataFrame:
    """The documents that are not flagged, with all their columns, judged where they stand: no join."""
    common.batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in rows:
            yield batch.filter(pa.array([not own or bool(own.exceed(x)[0] < REJECT) for x in common.as_bytes(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(task, docs.schema)
