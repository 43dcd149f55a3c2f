"""Spelling variants: all pairs of vocabulary words one edit apart, by dynamic programming over the sorted vocabulary.

1. Spark counts the words of all texts. The vocabulary (words of at least ``least_length`` code points and ``least_count``
   occurrences) is stored.
2. It is sorted twice, as written and backwards, and cut into shards of consecutive words. With m the shorter length of two
   words one edit apart, either they share their first m div 2 code points (found forwards) or, backwards, the other ones.
3. A word searches the stretch of a sorted list that shares as many code points as it must. Shards that the stretch touches
   are its own and, rarely, others: those it visits unless already the shard's shared prefix is more than one edit away.
4. In a shard all words scan their stretches together. A scan keeps the rows of the edit matrix (a band of three cells) of
   its place in the list; the next word starts from the row of the prefix that it shares with the last one. Where a row
   exceeds one edit, the scan skips all words that share that prefix.
5. A scan returns one row for each word: the number of its near words and the best. Forms of forms follow by doubling.

No pair is ever a row, and no list of a prefix or of a word meets in one task: a shard has a bounded number of words, and
what visits it is read batch by batch, dealt over tasks by a hash where it is much.

Defined results: null and empty texts have no words; a null id counts as 'null' only for the damage of ``damaged``, which
then leaves the word as it is; repeated rows count each; ties of the best form go to the smallest word in code-point order;
an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of a shard; visitors of a shard that one task reads, roughly; cells of the edit matrices of one block of scans.
SHARD, VISITORS, CELLS = 50_000, 200_000, 20_000_000
#: Prefix lengths whose ends are kept for skipping; a scan steps over the words of a longer prefix one by one.
SKIPS = 64
LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
NEAR = "word string, n_near long, best_n long, best string"
_near = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
ROUTES = "shard int, visitor boolean, key string, n long"
_routes = pa.schema([("shard", pa.int32()), ("visitor", pa.bool_()), ("key", pa.string()), ("n", pa.int64())])
_upper, _lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def damaged(doc_id: Column, word: Column, every: int = 199) -> Column:
    """The word without one code point where ``every`` divides the crc32 of ``<doc_id>:<word>``."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def counts(docs: DataFrame, every: int | None = None, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """word, n: the vocabulary. With ``every``, words are damaged first."""
    runs = F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0)))
    rows = common.texts(docs).select("doc_id", runs.alias("run")).select("doc_id", F.translate("run", _upper, _lower).alias("run"))
    long = rows.where(F.length("run") >= least_length)
    words = long.select(damaged(F.col("doc_id"), F.col("run"), every).alias("word")).where(F.length("word") >= least_length) if every else long.select(F.col("run").alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


# -- the scan ---------------------------------------------------------------------------------------------------


class SortedList:
    """Words in code-point order, the prefix that each shares with the one before it, and where prefixes end."""

    def __init__(self, words: list[str]):
        self.size = np.array([len(w) for w in words], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.lcp = np.zeros(len(words) + 1, np.int64)
        if len(words) > 1:
            self.lcp[1:-1] = shared(self, np.arange(len(words) - 1), self, np.arange(1, len(words)))
        self.first = np.cumsum(np.minimum(self.size, SKIPS)) - np.minimum(self.size, SKIPS)
        self.skip = np.repeat(np.arange(1, len(words) + 1), np.minimum(self.size, SKIPS))
        for k in range(1, min(int(self.lcp.max(initial=0)), SKIPS) + 1):  # where words stop sharing k code points
            heads = np.flatnonzero((self.lcp[:-1] < k) & (self.lcp[1:] >= k))
            ends = np.flatnonzero(self.lcp < k)
            self.skip[self.first[heads] + k - 1] = ends[np.searchsorted(ends, heads, side="right")]

    def behind(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first word behind that does not share ``depth`` code points, if the word at ``at`` is the first that has them."""
        return np.where(depth <= SKIPS, self.skip[np.minimum(self.first[at] + depth - 1, max(len(self.skip) - 1, 0))], at + 1)

    def point(self, at: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Code point k of the words, 0 where they have none."""
        inside = (k >= 0) & (k < self.size[at])
        return np.where(inside, self.points[np.where(inside, self.start[at] + k, 0)], 0) if len(self.points) else np.zeros(len(at), np.uint32)


def shared(a: SortedList, i: np.ndarray, b: SortedList, j: np.ndarray, ends: bool = False) -> np.ndarray:
    """Length of the common prefix (of the common suffix, if ``ends``) of the words i of a and j of b."""
    out, going = np.zeros(len(i), np.int64), np.arange(len(i))
    while len(going):
        k, m, n = out[going], a.size[i[going]], b.size[j[going]]
        x, y = (a.point(i[going], m - 1 - k), b.point(j[going], n - 1 - k)) if ends else (a.point(i[going], k), b.point(j[going], k))
        going = going[(x == y) & (k < np.minimum(m, n))]
        out[going] += 1
    return out


def scan(listed: SortedList, asked: SortedList, low: np.ndarray, high: np.ndarray, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (asked, listed) of words one edit apart, the second in the stretch from ``low`` to ``high`` of the first.

    Forwards those that share their first m div 2 code points, backwards those that do not, reading from the other end."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    order = np.argsort(asked.size, kind="stable")
    order = order[high[order] > low[order]]
    height = asked.size[order] + 3  # rising, so that the last word of a block says how high its matrices are
    at = 0
    while at < len(order):
        end = at + max(1, int(np.searchsorted(height[at:] * np.arange(1, len(order) - at + 1), CELLS // 3)))
        found.append(_scan(listed, asked, order[at:end], low, high, backwards))
        at = end
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(x for x, _ in found)]), np.concatenate([none, *(y for _, y in found)])


def _scan(listed: SortedList, asked: SortedList, which: np.ndarray, low: np.ndarray, high: np.ndarray, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    height = int(asked.size[which].max()) + 2
    rows = np.full((len(which), height + 1, 3), 2, np.uint8)  # by depth: one code point less, as many, one more of the word
    rows[:, 0, 1], rows[:, 0, 2] = 0, 1
    q, at, stop = np.arange(len(which)), low[which], high[which]
    depth, found = np.zeros(len(which), np.int64), []
    while len(q):
        word, size = which[q], listed.size[at]
        # a word that is longer by two or more matters by the prefix only that the next one shares
        goal = np.where(size <= asked.size[word] + 1, size, np.minimum(listed.lcp[at + 1], asked.size[word] + 2))
        more = depth < goal
        g, k = q[more], depth[more] + 1
        c, w = listed.point(at[more], k - 1), word[more]
        above = rows[g, k - 1].astype(np.int64)
        length = asked.size[w]
        one = np.minimum(above[:, 1] + 1, above[:, 0] + (c != asked.point(w, k - 2)))
        two = np.minimum(np.minimum(above[:, 1] + (c != asked.point(w, k - 1)), above[:, 2] + 1), one + 1)
        three = np.minimum(above[:, 2] + (c != asked.point(w, k)), two + 1)
        row = np.stack([np.where(k - 1 <= length, one, 2), np.where(k <= length, two, 2), np.where(k + 1 <= length, three, 2)], 1)
        row = np.minimum(row, 2)
        rows[g, k] = row
        depth[more] = k
        dead = np.zeros(len(q), bool)
        dead[more] = row.min(1) > 1
        over = ~dead & (depth >= goal)
        ready = over & (depth == size) & (np.abs(size - asked.size[word]) <= 1)
        if ready.any():
            r = np.flatnonzero(ready)
            hit = r[rows[q[r], depth[r], asked.size[word[r]] - depth[r] + 1] == 1]
            if len(hit):
                found.append((word[hit], at[hit]))
        ahead = np.where(dead, listed.behind(at, np.maximum(depth, 1)), np.where(over, at + 1, at))
        moved = ahead != at
        at = ahead
        depth = np.where(moved, np.minimum(listed.lcp[at], depth), depth)
        left = at < stop
        q, at, stop, depth = q[left], at[left], stop[left], depth[left]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*found))
    half = np.minimum(asked.size[a], listed.size[b]) // 2
    mine = shared(asked, a, listed, b, ends=True) < half if backwards else shared(asked, a, listed, b) >= half
    return a[mine], b[mine]


# -- over shards ------------------------------------------------------------------------------------------------


def stretch(key: str, backwards: bool, least_length: int) -> str:
    """The prefix that a word shares with all words that its scan must find."""
    m = max(least_length, len(key) - 1)
    return key[: m - m // 2 if backwards else m // 2]


def within_one(prefix: str, key: str) -> bool:
    """Whether some word that starts with ``prefix`` may be one edit from ``key``."""
    k = len(commonprefix([prefix, key]))
    return k == len(prefix) or any(key.startswith(prefix[k + i :], k + j) or prefix[k + i :].startswith(key[k + j :]) for i, j in ((1, 1), (1, 0), (0, 1)))


def near(vocabulary: DataFrame, least_length: int = 6) -> DataFrame:
    """word, n_near, best_n, best of every word that has near words, from a stored vocabulary (word, n) without repeats."""
    spark = vocabulary.sparkSession
    shards = max(common.partitions(spark), 2 * vocabulary.count() // SHARD + 1)
    both = vocabulary.select(F.lit(False).alias("backwards"), F.col("word").alias("key"), "n").unionByName(vocabulary.select(F.lit(True).alias("backwards"), F.reverse("word").alias("key"), "n"))
    listed = common.cut(both.repartitionByRange(shards, "backwards", "key").select("*", F.spark_partition_id().alias("shard")), "sorted-words")
    # one row for each shard: it has tens of thousands of words
    edges = listed.groupBy("backwards", "shard").agg(F.min("key").alias("first"), F.max("key").alias("last")).orderBy("backwards", "first").collect()
    firsts, lasts = ([[getattr(e, x) for e in edges if e.backwards == side] for side in (False, True)] for x in ("first", "last"))
    prefixes = [list(map(commonprefix, zip(*x))) for x in zip(firsts, lasts)]
    before = len(firsts[0])

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for side, key, n in zip(*(batch.column(c).to_pylist() for c in ("backwards", "key", "n"))):
                start = stretch(key, side, least_length)
                own = bisect_left(lasts[side], key)
                for shard in range(bisect_left(lasts[side], start), bisect_right(firsts[side], start + chr(0x10FFFF))):
                    if shard == own or within_one(prefixes[side][shard], key):
                        for column, value in zip(out, (shard + before * side, shard != own, key, n)):
                            column.append(value)
            yield common.record(_routes, out)

    routes = common.cut(listed.select("backwards", "key", "n").mapInArrow(routed, ROUTES), "routed-words")
    crowded = routes.where("visitor").groupBy("shard").count().where(F.col("count") > VISITORS).collect()
    slots, total = [], len(edges)
    for e in sorted(crowded):  # a shard with many visitors is searched in several tasks, which all read its words
        parts = -(-e["count"] // VISITORS)
        slots.append((e["shard"], parts, total))
        total += parts - 1
    if slots:
        extra = spark.createDataFrame(slots, "shard int, parts int, next int")
        part = F.when(F.col("visitor"), F.array(F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
        routes = routes.join(F.broadcast(extra), "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.explode(part))
        routes = routes.withColumn("slot", F.when(F.col("part") == 0, F.col("shard")).otherwise(F.col("next") + F.col("part") - 1))
    else:
        routes = routes.withColumn("part", F.lit(0)).withColumn("slot", F.col("shard"))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n, at = [], [], None
        for batch in batches:
            visitor = np.asarray(batch.column("visitor").to_numpy(zero_copy_only=False), bool)
            first = int(np.searchsorted(visitor, True))
            if first:
                words += batch.column("key").slice(0, first).to_pylist()
                n += batch.column("n").slice(0, first).to_pylist()
                side, part = batch.column("shard")[0].as_py() >= before, batch.column("part")[0].as_py()
            if first < len(visitor):
                at = at or Shard(words, n, side, least_length)
                yield at.best(batch.column("key").slice(first).to_pylist())
        if words and part == 0:
            at = at or Shard(words, n, side, least_length)
            for k in range(0, len(words), SHARD):
                yield at.best(words[k : k + SHARD])

    found = routes.select("slot", "shard", "part", "visitor", "key", "n").repartitionById(max(total, 1), "slot").sortWithinPartitions("visitor", "key").mapInArrow(searched, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("word"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.word").alias("best"))


class Shard:
    """The words of a shard, and searches in it."""

    def __init__(self, words: list[str], n: list[int], backwards: bool, least_length: int):
        self.words, self.n, self.backwards, self.least_length = words, np.array(n, np.int64), backwards, least_length
        self.listed = SortedList(words)
        self.rank = np.arange(len(words))  # in the order of the words as written
        if backwards:
            self.rank[sorted(range(len(words)), key=[w[::-1] for w in words].__getitem__)] = np.arange(len(words))

    def best(self, keys: list[str]) -> pa.RecordBatch:
        """For each key with near words in the shard: how many, and the one with the largest n, the smallest of those."""
        starts = [stretch(k, self.backwards, self.least_length) for k in keys]
        low = np.array([bisect_left(self.words, s) for s in starts], np.int64)
        high = np.array([bisect_right(self.words, s + chr(0x10FFFF)) for s in starts], np.int64)
        a, b = scan(self.listed, SortedList(keys), low, high, self.backwards)
        order = np.lexsort((self.rank[b], -self.n[b], a))
        a, b = a[order], b[order]
        first = common.runs(a)
        turn = (lambda w: w[::-1]) if self.backwards else (lambda w: w)
        return common.record(_near, [[turn(keys[k]) for k in a[first].tolist()], np.diff(np.append(first, len(a))), self.n[b[first]], [turn(self.words[k]) for k in b[first].tolist()]])


def forms(vocabulary: DataFrame, ratio: int = 5, least_length: int = 6) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of a vocabulary (word, n): its form is its near word of largest n,
    if that is at least ``ratio`` times the word's; its root is the last of its form's forms, or itself."""
    vocabulary = common.cut(vocabulary, "vocabulary")
    known = vocabulary.join(near(vocabulary, least_length), "word", "left")
    is_form = F.col("best_n") >= ratio * F.col("n")
    known = common.cut(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "forms")
    roots = known.where("form is not null").select("word", F.col("form").alias("root"))
    while True:  # forms have larger n, so that there are no circles and few rounds
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = common.cut(roots.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        roots = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
