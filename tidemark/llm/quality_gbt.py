"""Quality rules: gradient-boosted trees over document statistics, with monotonic constraints on chosen features.

Statistics of every whole text are counted in one pass. The trees are fitted on at most ``MAX_TRAINING`` labelled
documents (taken by a hash of the id) and flattened into numpy node arrays that all tasks score with. A document that
fails the base rules is not kept, whatever the trees say.

Defined results: null text has no words and fails the base rules; repeated rows are judged each; null labels and labels
without a document teach nothing, of several labels of a document the lowest counts; without two classes of labels only
the base rules hold; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The largest number of labelled documents to learn from.
MAX_TRAINING = 20_000
TREES, DEPTH, RATE, BINS, LEAST_WEIGHT, RIDGE = 60, 3, 0.2, 32, 5.0, 1.0
#: A document is rejected if its probability of good quality is below this.
KEEP = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
#: The features of the trees, and the direction in which each may change the score (0: free).
FEATURES = {"log_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "digit_share": -1, "mark_share": -1, "distinct_share": 1, "line_words": 0, "accent_share": 0, "longest_word": 0, "bare_share": 0}
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
COUNTS = f"doc_id long, {BASE}, features array<double>"
VERDICTS = f"doc_id long, {BASE}, base_failed boolean, kept boolean, quality_score double"
_base = [("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))]
_counts = pa.schema([*_base, ("features", pa.list_(pa.float64()))])
_verdicts = pa.schema([*_base, ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("quality_score", pa.float64())])


def _mask(test) -> np.ndarray:
    return np.array([test(b) for b in range(256)], np.int64)


_SPACE = {0x20, *range(0x09, 0x0E)}
#: Columns: code points outside white space, listed symbols, upper case, letters, digits, other marks, first bytes of accented letters.
_CLASSES = np.stack([
    _mask(lambda b: b not in _SPACE and not 0x80 <= b < 0xC0), _mask(lambda b: b in SYMBOLS), _mask(lambda b: 65 <= b < 91), _mask(lambda b: 65 <= b < 91 or 97 <= b < 123 or b >= 0xC0),
    _mask(lambda b: 48 <= b < 58), _mask(lambda b: 33 <= b < 127 and not chr(b).isalnum() and b not in b".,"), _mask(lambda b: b >= 0xC0),
], axis=1)


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that are found twice or more, each word once."""
    n = len(words)
    if n < 4:
        return 0
    number = {w: k for k, w in enumerate(set(words))}
    ids, v = np.fromiter(map(number.__getitem__, words), np.int64, n), len(number)
    keys = (ids[:-2] * v + ids[1:-1]) * v + ids[2:] if v < 2_000_000 else np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True)[1].ravel()
    order = np.argsort(keys, kind="stable")
    start = common.runs(keys[order])
    size = np.diff(np.append(start, n - 2))
    if size.max() < 2:
        return 0
    often = np.zeros(n - 2, bool)
    often[order] = np.repeat(size > 1, size)
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= often
    return int(covered.sum())


def statistics(text: bytes) -> tuple[tuple[int, ...], list[float]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; and the features."""
    words = text.split()
    n = len(words)
    chars, symbols, upper, letters, digits, marks, accents = (np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASSES).tolist()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    m, c, a = max(n, 1), max(chars, 1), max(letters, 1)
    bare = sum(map(bytes.isalpha, words)) / m
    return (n, chars, symbols, dup, repeat), [float(np.log1p(n)), chars / m, symbols / m, dup / max(len(lines), 1), repeat / m, upper / a, digits / c, marks / c, len(set(words)) / m, n / max(len(lines), 1), accents / a, float(max(map(len, words), default=0)), bare]


def count(docs: DataFrame) -> DataFrame:
    """The statistics and features of every document."""

    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = [statistics(x) for x in common.as_bytes(batch.column(1))]
            base = list(zip(*(x[0] for x in found))) if found else [[]] * 5
            yield common.record(_counts, [batch.column(0), *base, [x[1] for x in found]])

    return common.texts(docs).mapInArrow(task, COUNTS)


@dataclass
class Trees:
    """Perfect trees of ``DEPTH`` levels as arrays: node k of a tree has the children 2k + 1 and 2k + 2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The log odds of good quality, a row of x at a time for all trees."""
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, directions: list[int]) -> Trees:
    """Logistic gradient boosting over binned features. A split on a constrained feature must order its children, and
    bounds handed down keep whole subtrees in that order."""
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(rate / (1 - rate)))
    raw = np.full(n, bias)
    trees = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        feature, threshold, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(leaves)
        low, high = np.full(2 * leaves, -np.inf), np.full(2 * leaves, np.inf)
        at = np.zeros(n, np.int64)
        for k in range(inner):
            own = np.flatnonzero(at == k)
            best = (1e-6, -1, 0, 0.0, 0.0)
            gs, hs = g[own].sum(), h[own].sum()
            for j in range(d if len(own) else 0):
                gl = np.cumsum(np.bincount(binned[own, j], g[own], minlength=len(cuts[j]) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[own, j], h[own], minlength=len(cuts[j]) + 1))[:-1]
                wl, wr = (np.clip(a / (b + RIDGE), low[k], high[k]) for a, b in ((gl, hl), (gs - gl, hs - hl)))
                gain = wl * gl - wl**2 * (hl + RIDGE) / 2 + wr * (gs - gl) - wr**2 * (hs - hl + RIDGE) / 2 - gs**2 / (hs + RIDGE) / 2
                gain[(hl < LEAST_WEIGHT) | (hs - hl < LEAST_WEIGHT) | ((wr - wl) * directions[j] < 0)] = -1
                if len(gain) and gain.max() > best[0]:
                    b = int(gain.argmax())
                    best = (gain[b], j, b, wl[b], wr[b])
            _, j, b, wl, wr = best
            left, right = 2 * k + 1, 2 * k + 2
            low[left] = low[right] = low[k]
            high[left] = high[right] = high[k]
            if j >= 0:
                feature[k], threshold[k] = j, cuts[j][b]
                if directions[j]:
                    middle = (wl + wr) / 2
                    (high if directions[j] > 0 else low)[left] = middle
                    (low if directions[j] > 0 else high)[right] = middle
            at[own] = np.where(x[own, feature[k]] > threshold[k], right, left)
        for leaf in range(leaves):
            own = at == inner + leaf
            value[leaf] = RATE * np.clip(g[own].sum() / (h[own].sum() + RIDGE), low[inner + leaf], high[inner + leaf])
        raw += value[at - inner]
        trees.append((feature, threshold, value))
    return Trees(*(np.stack(z) for z in zip(*trees)), bias)


def training_ids(labels: DataFrame, column: str, size: int = MAX_TRAINING) -> DataFrame:
    """At most ``size`` labelled ids by a hash of the id, with their lowest label."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(column).cast("int").alias("label"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)


def learn(docs: DataFrame, labels: DataFrame, size: int = MAX_TRAINING) -> Trees | None:
    """Fit on the labelled sample; None without two classes."""
    rows = common.texts(docs).join(F.broadcast(training_ids(labels, "quality", size)), "doc_id")
    found = count(rows).select("doc_id", "features").join(training_ids(labels, "quality", size), "doc_id").select("doc_id", "features", "label").orderBy("doc_id").toArrow()
    y = (np.array(found["label"].to_pylist(), np.float64) > 0).astype(np.float64)
    if len(set(y.tolist())) < 2:
        return None
    x = np.array(found["features"].to_pylist(), np.float64)
    return fit(x, y, list(FEATURES.values()))


def judge(docs: DataFrame, trees: Trees | None, keep: float = KEEP) -> DataFrame:
    """The base statistics, whether the base rules failed, and the verdict for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in rows:
            found = [statistics(x) for x in common.as_bytes(batch.column(1))]
            base = np.array([x[0] for x in found], np.int64).reshape(-1, 5)
            failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEAT_PERCENT * base[:, 0])
            good = np.ones(len(found))
            if own is not None and found:
                good = 1 / (1 + np.exp(-own.score(np.array([x[1] for x in found]))))
            yield common.record(_verdicts, [batch.column(0), *base.T, failed, ~failed & (good >= keep), good])

    return common.texts(docs).mapInArrow(task, VERDICTS)


def filter_kept(docs: DataFrame, trees: Trees | None, keep: float = KEEP) -> DataFrame:
    """The documents that are kept, with all their columns, judged where they stand: no join."""
    common.batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(trees), docs.columns.index("text")

    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in rows:
            found = [statistics(x) for x in common.as_bytes(batch.column(at))]
            kept = []
            for base, _ in found:
                kept.append(base[0] >= MIN_WORDS and 100 * base[4] <= MAX_REPEAT_PERCENT * base[0])
            if own is not None and found:
                kept = np.array(kept) & (1 / (1 + np.exp(-own.score(np.array([x[1] for x in found])))) >= keep)
            yield batch.filter(pa.array(list(map(bool, kept)), pa.bool_()))

    return docs.mapInArrow(task, docs.schema)
