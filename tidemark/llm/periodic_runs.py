"""Periodic runs of words in documents, found by recompression.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), at least ``shortest`` words and
``times`` periods long, that no neighbouring word extends keeping period q.

1. A task joins the documents of a batch to one string of word numbers; a separator that occurs once parts documents.
2. Harmonic grid: a run of period q covers grid points g, g + q and g + 2q, multiples of q, and the words there agree. For
   each q all grid points at which a few such words agree are candidates: about n log n looks at words for n words.
   Candidates that follow each other on the grid are one chain, of which the first point is tried.
3. Recompression of the documents that have candidates: block compression (a repeated symbol becomes one symbol with an
   exponent) and pair compression (symbols are dealt to two sides by a hash; a left one before a right one becomes one
   symbol) take turns, until each document is one symbol. Equal stretches are parsed alike but at their ends, so the longest
   common extension of two places follows from one climb through the rounds and one descent: no suffix array.
4. Extensions of g and g + q to the right and to the left give the whole stretch; the chain goes on behind it. Of equal
   stretches the one with the smallest period is the run.

A document is searched in one task, without a shuffle; memory follows the bytes of a batch or of the longest document.

Defined results: null text and text without words have no runs and an empty collapsed text; repeated rows are searched each,
also those with a null id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Which original word each word of a document of n words becomes, or None for no change.
Rearrange = Callable[[int | None, int], np.ndarray | None]
SPANS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_spans = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_run)), ("collapsed", pa.string())])


# -- recompression ----------------------------------------------------------------------------------------------


@dataclass
class Round:
    """Symbols of a round, the phrase of each, and where each phrase starts (one more: the end)."""

    symbols: np.ndarray
    up: np.ndarray
    down: np.ndarray
    blocks: bool

    def mirrored(self) -> Round:
        return Round(self.symbols[::-1], len(self.down) - 2 - self.up[::-1], len(self.symbols) - self.down[::-1], self.blocks)


def _round(symbols: np.ndarray, first: np.ndarray, blocks: bool) -> Round:
    return Round(symbols, (np.cumsum(first) - 1).astype(np.int32), np.append(np.flatnonzero(first), len(symbols)).astype(np.int32), blocks)


def _renamed(symbols: np.ndarray, at: np.ndarray, rules: np.ndarray, names: int) -> int:
    """Give the phrases at ``at`` a symbol for each different rule, from ``names`` on; the number of names after that."""
    known, which = np.unique(rules, return_inverse=True)
    symbols[at] = names + which
    return names + len(known)


def recompress(symbols: np.ndarray) -> list[Round]:
    """Rounds from the string up to one symbol for each stretch between separators, which are negative and differ."""
    symbols, names, rounds = symbols.astype(np.int64), int(symbols.max(initial=0)) + 1, []
    while True:
        same = np.append(False, symbols[1:] == symbols[:-1])
        if same.any():
            now = _round(symbols, ~same, True)
            lengths = np.diff(now.down).astype(np.int64)
            rounds.append(now)
            symbols = symbols[now.down[:-1]]
            at = np.flatnonzero(lengths > 1)
            names = _renamed(symbols, at, symbols[at] * (int(lengths.max()) + 1) + lengths[at], names)
        inner = symbols >= 0
        if not (inner[1:] & inner[:-1]).any():
            return [*rounds, Round(symbols, np.arange(len(symbols)), np.arange(len(symbols) + 1), False)]
        side = ((symbols * 0x9E3779B1 + len(rounds) * 0x85EBCA6B) >> 15) & 1
        pairs = [inner[:-1] & inner[1:] & (side[:-1] == left) & (side[1:] != left) for left in (0, 1)]
        pair = max(pairs, key=np.count_nonzero)
        if pair.any():
            now = _round(symbols, np.append(True, ~pair), False)
            rounds.append(now)
            at = np.flatnonzero(pair)
            rules = symbols[at] * names + symbols[at + 1]
            symbols = symbols[now.down[:-1]]
            names = _renamed(symbols, now.up[at], rules, names)
        else:  # the hash put all neighbours on one side: try the next one
            rounds.append(Round(symbols, np.arange(len(symbols)), np.arange(len(symbols) + 1), False))


def extension(rounds: list[Round], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common extension to the right of the places a and b (a <> b, pairwise), exactly."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    x, y, top = a.copy(), b.copy(), np.full(len(a), -1)
    going = np.arange(len(a))
    for k, r in enumerate(rounds[:-1]):  # climb while the symbols above agree
        if not len(going):
            break
        at, bt = x[going], y[going]
        whole = (r.down[r.up[at]] == at) & (r.down[r.up[bt]] == bt)
        left, right = r.down[r.up[at] + 1] - at, r.down[r.up[bt] + 1] - bt
        alike = r.symbols[at] == r.symbols[bt]
        step = np.where(~whole & alike, np.minimum(left, right), 0)
        x[going], y[going] = at + step, bt + step
        on = whole | (alike & (left == right))
        up_a, up_b = r.up[np.where(on, at + step, 0)], r.up[np.where(on, bt + step, 0)]
        on &= rounds[k + 1].symbols[up_a] == rounds[k + 1].symbols[up_b]
        top[going[~on]] = k
        x[going[on]], y[going[on]] = up_a[on], up_b[on]
        going = going[on]
    top[going] = len(rounds) - 1
    for k in range(len(rounds) - 1, -1, -1):  # descend behind all symbols that agree
        here, r = np.flatnonzero(top >= k), rounds[k]
        if k + 1 < len(rounds):
            below = here[top[here] > k]
            x[below], y[below] = r.down[x[below]], r.down[y[below]]
        while len(here):
            here = here[r.symbols[x[here]] == r.symbols[y[here]]]
            at, bt = x[here], y[here]
            step = np.minimum(r.down[r.up[at] + 1] - at, r.down[r.up[bt] + 1] - bt) if r.blocks else 1
            x[here], y[here] = at + step, bt + step
    return x - a


# -- candidates and runs ----------------------------------------------------------------------------------------


def chains(string: np.ndarray, ends: np.ndarray, longest: np.ndarray, shortest: int, times: int) -> np.ndarray:
    """Rows (q, first, last) of grid points, in units of q, at which a run of period q may pass.

    ``ends`` and ``longest``: where documents end in ``string`` and their words, the longest document first."""
    found = []
    for q in range(1, int(longest.max(initial=0)) // times + 1):
        fit = np.searchsorted(-longest, -max(shortest, times * q), side="right")
        if not fit:
            break
        end = ends[fit - 1]
        grid = string[0:end:q]
        same = grid[1:] == grid[:-1]
        at = np.flatnonzero(same[1:] & same[:-1])
        for j in {1, q // 2, q - 1, max(q, shortest - 2 * q)} - {0}:
            if not len(at):
                break
            at = at[at * q + j + q < end]
            at = at[string[at * q + j] == string[at * q + j + q]]
        if len(at):
            owner = np.searchsorted(ends, at * q, side="right")
            first = np.append(True, (np.diff(at) != 1) | (np.diff(owner) != 0))
            found.append(np.stack([np.full(first.sum(), q), at[first], at[np.append(first[1:], True)]], 1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def runs(documents: list[np.ndarray], shortest: int = 24, times: int = 3) -> list[np.ndarray]:
    """Rows (start, length, period) of every run of each document of word numbers, by start and period. ``times`` >= 3."""
    sizes = np.array([len(x) for x in documents], np.int64)
    order = np.argsort(-sizes, kind="stable")
    none = np.zeros((0, 3), np.int64)
    out = [none] * len(documents)
    order = order[sizes[order] >= shortest]
    if not len(order):
        return out

    def joined(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The string of these documents with a separator around each, and where each starts."""
        starts = np.cumsum(sizes[which] + 1) - sizes[which]
        string = np.empty(int(starts[-1] + sizes[which[-1]]) + 1, np.int64)
        string[np.append(starts - 1, len(string) - 1)] = -1 - np.arange(len(which) + 1)
        for s, d in zip(starts.tolist(), which.tolist()):
            string[s : s + len(documents[d])] = documents[d]
        return string, starts

    string, starts = joined(order)
    tries = chains(string, starts + sizes[order], sizes[order], shortest, times)
    if not len(tries):
        return out
    owner = np.searchsorted(starts, tries[:, 0] * tries[:, 1], side="right") - 1
    has, owner = np.unique(owner, return_inverse=True)
    chosen = order[has]
    string, now = joined(chosen)
    shift = now - starts[has]
    rounds = recompress(string)
    back, found = [r.mirrored() for r in rounds], []
    while len(tries):
        q, at = tries[:, 0], tries[:, 0] * tries[:, 1] + shift[owner]
        first = at - extension(back, len(string) - at, len(string) - at - q)
        end = at + q + extension(rounds, at, at + q)
        whole = end - first >= np.maximum(shortest, times * q)
        found.append(np.stack([owner, first - now[owner], end - first, q], 1)[whole])
        tries = np.stack([q, np.maximum(tries[:, 1] + 1, -(-(end - shift[owner] - q) // q)), tries[:, 2]], 1)
        left = tries[:, 1] <= tries[:, 2]
        tries, owner = tries[left], owner[left]
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    rows = rows[np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(1))] if len(rows) else rows
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    cut = np.searchsorted(rows[:, 0], np.arange(len(chosen) + 1))
    for k, d in enumerate(chosen.tolist()):
        out[d] = rows[cut[k] : cut[k + 1], 1:]
    return out


def kept(n: int, found: np.ndarray) -> np.ndarray:
    """The numbers of the words that no run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    return np.flatnonzero(np.cumsum(edge[:-1]) == 0)


# -- over documents ---------------------------------------------------------------------------------------------


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Every tenth document, by the crc32 of its decimal id, repeats a stretch of its words from some place to its end."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.append(np.arange(a), a + np.arange(n - a) % p)


def scan(docs: DataFrame, rearrange: Rearrange | None = None, shortest: int = 24, times: int = 3) -> DataFrame:
    """doc_id, n_words, runs, and collapsed: the words, joined by one space, that no run contains after its first period.

    Words are what ASCII white space parts. ``rearrange`` may change the order of a document's words before the search."""
    common.batches(docs.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            words = [x.split() for x in common.as_bytes(batch.column(1))]
            if rearrange:
                for k, (i, w) in enumerate(zip(ids, words)):
                    if (places := rearrange(i, len(w))) is not None:
                        words[k] = [w[p] for p in places.tolist()]
            number: dict[bytes, int] = {}
            for w in words:
                for x in w:
                    if x not in number:
                        number[x] = len(number)
            sizes = [len(w) for w in words]
            flat = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, sum(sizes))
            ends = np.cumsum(sizes)
            found = runs([flat[e - n : e] for e, n in zip(ends.tolist(), sizes)], shortest, times)
            short = [b" ".join([w[k] for k in kept(len(w), r).tolist()] if len(r) else w) for w, r in zip(words, found)]
            rows = np.concatenate([np.zeros((0, 3), np.int64), *found])
            fields = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], fields=list(_run))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), fields)
            yield common.record(_spans, [ids, sizes, lists, pa.array(short, pa.binary()).cast(pa.string())])

    return common.texts(docs).mapInArrow(find, SPANS)


def digests(spans: DataFrame) -> DataFrame:
    """One row for each document: its number of runs, the run with the greatest exponent, and checksums of runs and text."""
    best = F.expr("aggregate(runs, cast(null as struct<start:long,length:long,period:long>), (m, x) -> if(m is null or x.length * m.period > m.length * x.period, x, m))")
    listed = F.expr("concat_ws('', transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\n')))")
    rows = spans.withColumn("_best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), F.col("_best.length").alias("length"), F.col("_best.period").alias("period"),
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )
