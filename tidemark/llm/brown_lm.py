"""Brown class-based n-grams: P(w | w') = P(class of w | class of w') * P(w | class of w).

Every training word gets a class by exchange. Seeds, the most frequent words and the most frequent endings of all others,
are clustered first: each moves to the class for which the likelihood of the class bigrams rises most, until none moves.
Then all other words, whose first class is that of their ending, are exchanged in passes over the whole vocabulary: Spark
counts how often each class stands before and after a word, and the word moves to the class that gives these neighbours
the largest likelihood (to the first order in its own counts, which do not count for its former class). Passes go on from
the classes that all words then have until the likelihood of the class bigrams rises by less than ``SETTLED`` a token. Only a
word that is never seen takes the class of its ending.

Class transitions are smoothed towards the classes' own frequencies, emissions by adding one, with one share in each class
for unknown words, so that the probabilities of all words sum to one. All counts cover all training documents, and every word
counts under its own class, in training as in scoring.

Words are counted per task, then summed by word. The most frequent words go to every task (at most ``HEAD`` words of
``HEAD_BYTES`` in all); texts are stored once as their numbers. Count and class of any other word reach its places through a
join on the word, as marks: a file for each task's texts, which whoever reads these texts reads beside them.

Defined results: null text is empty (its end token alone); repeated rows count each; a null id is trained on; without
training documents every count is 0; an empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import spans

#: Words whose counts every task gets, and their bytes; words and endings that are seeds; classes (64 at most).
HEAD, HEAD_BYTES, SEEDS, ENDINGS, CLASSES = 1 << 18, 8 << 20, 768, 254, 64
#: The count from which ``moved`` exchanges a word unless told otherwise, and the weight of the class frequencies in a transition.
LEAST, PRIOR = 2, 20.0
#: The rise of the log likelihood a token at which passes end.
SETTLED = 0.005
#: Entries at which a task's partial counts are sent on.
FLUSH = 400_000
#: The end token. White space splits words, so no word equals it.
END = "\n"
#: The class of a mark whose word is not known.
NONE = 255
CODED = "doc_id long, held_out boolean, part long, start long, codes binary, tail array<string>"
_coded = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("part", pa.int64()), ("start", pa.int64()), ("codes", pa.binary()), ("tail", pa.list_(pa.string()))])
_counted = pa.schema([("word", pa.string()), ("n", pa.int64())])
_pairs = pa.schema([("pair", pa.int32()), ("n", pa.int64())])
_contexts = pa.schema([("word", pa.string()), ("cls", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_classes = pa.schema([("word", pa.string()), ("n", pa.int64()), ("cls", pa.int32())])
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, value double"
_scored = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("value", pa.float64())])


def split(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts in lower case (A-Z), and where each text's words end."""
    texts = pa.array([x.lower() for x in common.as_bytes(column)], pa.binary()).cast(pa.string())
    lists = pc.ascii_split_whitespace(texts)
    words, ends = lists.flatten(), lists.offsets.to_numpy()[1:].astype(np.int64)
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # white space at either end leaves an empty word
    if not full.all():
        words, ends = words.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[ends]
    return words, ends


def word_counts(train: DataFrame) -> DataFrame:
    """word, n: all words of the training texts, and the end token once for each text."""

    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], schema=_counted)
            counts.clear()
            return out

        for batch in rows:
            found = pc.value_counts(split(batch.column(1))[0].cast(pa.binary()))
            for w, n in zip(found.field(0).to_pylist(), found.field(1).to_pylist(), strict=True):
                counts[w] = counts.get(w, 0) + n
            counts[END.encode()] = counts.get(END.encode(), 0) + len(batch)
            if len(counts) >= FLUSH:
                yield flush()
        if counts:
            yield flush()

    return common.texts_of(train).mapInArrow(task, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The head words with their counts, the seeds among them, and the seeds of endings."""

    words: list[bytes]
    counts: np.ndarray
    endings: dict[str, int]
    least: int
    seeds: int
    key: str = ""

    @property
    def units(self) -> int:
        """Unit 0 is the end token, 1 an ending that is not listed, then seed words, then endings."""
        return 2 + self.seeds + len(self.endings)

    def unit(self, word: bytes) -> int:
        """The unit of a word's ending."""
        return self.endings.get(word.decode()[-2:], 1)

    def units_of(self) -> np.ndarray:
        """The unit of each head word."""
        return np.array([2 + k if k < self.seeds else self.unit(w) for k, w in enumerate(self.words)], np.int64)


_ready: dict[str, tuple] = {}


def _tables(shared) -> tuple[Vocabulary, dict[bytes, int], np.ndarray]:
    """Built once for each Python worker: the place of each head word, and its unit."""
    vocab = shared.value
    if vocab.key not in _ready:
        _ready.clear()
        _ready[vocab.key] = (vocab, {w: k for k, w in enumerate(vocab.words)}, vocab.units_of())
    return _ready[vocab.key]


def vocabulary(counts: DataFrame, head: int = HEAD, seeds: int = SEEDS, endings: int = ENDINGS, head_bytes: int = HEAD_BYTES) -> Vocabulary:
    """The most frequent words: all with a count over a threshold that a histogram of the counts' logarithms gives."""
    words = counts.where(F.col("word") != END)
    bins = words.groupBy(F.floor(F.log2("n") * 64).alias("bin")).agg(F.count("*").alias("k"), F.min("n").alias("least"), F.sum(F.octet_length("word")).alias("bytes")).orderBy(F.desc("bin")).collect()
    least, total, size = 1 << 62, 0, 0
    for r in bins:
        total, size = total + r["k"], size + r["bytes"]
        if total > head or size > head_bytes:
            break
        least = r["least"]
    rows = words.where(F.col("n") >= least).orderBy(F.desc("n"), "word").toArrow()
    found = rows["word"].cast(pa.binary()).to_pylist()
    rest = words if not found else words.where(~F.col("word").isin([w.decode() for w in found[:seeds]]))
    often = rest.groupBy(F.substring("word", -2, 2).alias("e")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "e").limit(endings).collect()
    return Vocabulary(found, rows["n"].to_numpy().astype(np.int64), {r["e"]: 2 + seeds + k for k, r in enumerate(often)}, least, seeds, uuid.uuid4().hex)


def coded(docs: DataFrame, held_out: Column, shared) -> DataFrame:
    """Every text as numbers (32 bits): a head word's place, or -1 less the unit of another word's ending; those words beside them, and
    how many of them the task (``part``) had before."""

    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, at, _ = _tables(shared)
        part, start = TaskContext.get().partitionId(), 0
        for batch in rows:
            words, ends = split(batch.column(1))
            found = words.dictionary_encode()
            place = np.array([at[w] if w in at else -1 - vocab.unit(w) for w in found.dictionary.cast(pa.binary()).to_pylist()], "<i4")
            codes = place[found.indices.to_numpy()] if len(words) else np.zeros(0, "<i4")
            beyond = np.concatenate([[0], np.cumsum(codes < 0)])[ends]
            tail = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], beyond]), pa.int32()), words.filter(pa.array(codes < 0)))
            data = spans(codes.tobytes(), 4 * np.concatenate([[0], ends[:-1]])) if len(ends) else pa.array([], pa.binary())
            starts = start + np.concatenate([[0], beyond[:-1]]) if len(ends) else np.zeros(0)
            yield common.record(_coded, [batch.column(0), batch.column(2), np.full(len(ends), part), starts.astype(np.int64), data, tail])
            start += len(tail.flatten())

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), held_out.alias("held_out"))
    return rows.mapInArrow(task, CODED)


_marks: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}


def _marked(folder: str, part: int) -> tuple[np.ndarray, np.ndarray]:
    """Class and count of each word beyond the head in a part's texts; a worker keeps those of the part it reads."""
    if (folder, part) not in _marks:
        _marks.clear()
        where, path = common.storage(folder)
        with where.open_input_file(f"{path}/{part}") as file:
            data = file.read()
        size = len(data) // 9
        _marks[folder, part] = np.frombuffer(data, "<i8", size), np.frombuffer(data, "u1", size, 8 * size)
    counts, classes = _marks[folder, part]
    return classes, counts


@dataclass
class State:
    """The class of each head word and of each unit, and where the marks of all other words are; before the first pass nowhere."""

    head: np.ndarray
    ending: np.ndarray
    marks: str = ""


class Batch:
    """The numbers of a batch's texts one after another, and where each text's end."""

    def __init__(self, batch: pa.RecordBatch):
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        self.codes = np.frombuffer(b"".join(column("codes").to_pylist()), "<i4").astype(np.int64)
        self.ends = np.cumsum(pc.binary_length(column("codes")).to_numpy(zero_copy_only=False) // 4)
        self.tail = column("tail").flatten()
        self.part, self.start = (column(name).to_numpy(zero_copy_only=False) for name in ("part", "start"))
        self.beyond = np.diff(column("tail").offsets.to_numpy())

    def units(self, unit_of: np.ndarray) -> np.ndarray:
        """The unit of each token."""
        head = self.codes >= 0
        out = -1 - self.codes
        out[head] = unit_of[self.codes[head]]
        return out

    def marks(self, state: State) -> tuple[np.ndarray, np.ndarray]:
        """Class and count of each word beyond the head, 0 for words that are not known."""
        ending = state.ending[-1 - self.codes[self.codes < 0]]
        if not state.marks or not len(ending):
            return ending, np.zeros(len(ending), np.int64)
        at = np.repeat(self.start - np.cumsum(self.beyond) + self.beyond, self.beyond) + np.arange(len(ending))
        part, classes, counts = np.repeat(self.part, self.beyond), np.empty(len(ending), np.int64), np.empty(len(ending), np.int64)
        for p in np.unique(part).tolist():
            mine = part == p
            classes[mine], counts[mine] = (x[at[mine]] for x in _marked(state.marks, p))
        return np.where(classes == NONE, ending, classes), counts

    def kinds(self, state: State) -> np.ndarray:
        """The class of each token."""
        out, head = np.empty(len(self.codes), np.int64), self.codes >= 0
        out[head], out[~head] = state.head[self.codes[head]], self.marks(state)[0]
        return out

    def around(self, kinds: np.ndarray, end: int = 0) -> np.ndarray:
        """The kinds of all texts' tokens with that of the end token behind each text, and one before all."""
        out = np.insert(kinds, self.ends, end)
        return np.concatenate([[end], out])


def _matrix(rows: DataFrame, size: int, kinds) -> np.ndarray:
    """Counts of neighbouring kinds: those of each text's tokens and its end; the end stands before each text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            own = Batch(batch)
            seq = own.around(kinds(own))
            total += np.bincount(seq[:-1] * size + seq[1:], minlength=size * size)
        there = np.flatnonzero(total)
        yield common.record(_pairs, [there.astype(np.int32), total[there]])

    out = np.zeros(size * size)
    found = rows.select("part", "start", "codes", "tail").mapInArrow(task, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out[found["pair"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(size, size)


def exchange(bigrams: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """The class of each unit. Starts from the units by frequency in turn; each pass moves every unit to the class for
    which the likelihood, sum n log n over pairs of classes less both sums over classes, is largest, until none moves. The end
    keeps class 0."""
    m = len(bigrams)
    classes = min(classes, m)
    total = bigrams.sum(0) + bigrams.sum(1)
    order = np.argsort(-total, kind="stable")
    own = np.zeros(m, np.int64)
    movable = [u for u in order.tolist() if u and total[u]]
    for k, u in enumerate(movable):
        own[u] = 1 + k % (classes - 1) if classes > 1 else 0
    member = np.zeros((m, classes))
    member[np.arange(m), own] = 1
    n = member.T @ bigrams @ member

    def h(x):
        return x * np.log(np.maximum(x, 1e-300))

    hn = h(n)
    slack = 1e-9 + 1e-13 * float(h(total.sum()))  # a gain below the sums' rounding is none, so that the passes end
    moved = True
    while moved:
        moved = False
        to_class, from_class = bigrams @ member, bigrams.T @ member
        for u in movable:
            a, self_loop = int(own[u]), float(bigrams[u, u])
            out, into = to_class[u].copy(), from_class[u].copy()  # counts to and from classes, u included in its own
            out[a] -= self_loop
            into[a] -= self_loop
            # n without u
            n[a, :] -= out
            n[:, a] -= into
            n[a, a] -= self_loop
            hn[a, :], hn[:, a] = h(n[a, :]), h(n[:, a])
            # Wherever u goes, each class keeps its counts before and after u.
            rows, cols = n.sum(1) + into, n.sum(0) + out
            o, i = out.sum() + self_loop, into.sum() + self_loop
            after, before = np.flatnonzero(out), np.flatnonzero(into)
            gain = (h(n[:, after] + out[after]) - hn[:, after]).sum(1) + (h(n[before, :] + into[before, None]) - hn[before, :]).sum(0)
            d = np.diag(n)
            gain += h(d + out + into + self_loop) - h(d + out) - h(d + into) + h(d)
            gain -= h(rows + o) - h(rows) + h(cols + i) - h(cols)
            gain[0] = -np.inf
            b = int(gain.argmax()) if gain[a] < gain.max() - slack else a
            n[b, :] += out
            n[:, b] += into
            n[b, b] += self_loop
            hn[b, :], hn[:, b] = h(n[b, :]), h(n[:, b])
            if b != a:
                own[u], moved = b, True
                member[u, a], member[u, b] = 0, 1
                to_class[:, a] -= bigrams[:, u]
                to_class[:, b] += bigrams[:, u]
                from_class[:, a] -= bigrams[u, :]
                from_class[:, b] += bigrams[u, :]
    return own


def contexts(rows: DataFrame, shared, sent) -> DataFrame:
    """word, cls, keys, counts: for words that are no seeds, their class, and how often each class stands before (key: class) and after
    (64 + class), in the state that was ``sent``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, state = shared.value, sent.value
        names = pa.array(vocab.words, pa.binary()).cast(pa.string())
        head: list[np.ndarray] = []
        beyond: list[tuple[pa.Array, np.ndarray]] = []
        held = 0

        def found(keys: np.ndarray, words: pa.Array, classes: np.ndarray) -> pa.RecordBatch:
            keys, counts = np.unique(keys, return_counts=True)
            first = common.runs(keys >> 7)
            word = keys[first] >> 7
            return common.record(_contexts, [words.take(pa.array(word)), classes[word].astype(np.int32), spans((keys & 127).astype(np.uint8).tobytes(), first), spans(counts.astype("<u4").tobytes(), 4 * first)])

        def flush() -> Iterator[pa.RecordBatch]:
            if head:
                yield found(np.concatenate(head), names, state.head)
            if beyond:
                words = pa.concat_arrays([w for w, _ in beyond]).dictionary_encode()
                at = words.indices.to_numpy().astype(np.int64)
                sides = np.concatenate([s for _, s in beyond], 1)
                classes = np.zeros(len(words.dictionary), np.int64)
                classes[at] = sides[2]
                yield found(np.concatenate([at << 7 | sides[0], at << 7 | sides[1]]), words.dictionary, classes)
            head.clear()
            beyond.clear()

        for batch in batches:
            texts = Batch(batch)
            seq = texts.around(texts.kinds(state))
            inner = np.ones(len(seq) - 1, bool)
            inner[texts.ends + np.arange(len(texts.ends))] = False  # places of end tokens
            at = np.flatnonzero(inner)  # of the token's neighbour before it, in seq
            before, after = seq[at], 64 | seq[at + 2]
            some = texts.codes >= vocab.seeds
            if some.any():
                key = texts.codes[some] << 7
                head.append(np.concatenate([key | before[some], key | after[some]]))
            some = texts.codes < 0
            if some.any():
                beyond.append((texts.tail, np.stack([before[some], after[some], seq[at + 1][some]])))
            held += len(texts.codes)
            if held > 10 * FLUSH:
                yield from flush()
                held = 0
        yield from flush()

    return rows.select("part", "start", "codes", "tail").mapInArrow(task, "word string, cls int, keys binary, counts binary")


def moved(before: np.ndarray, after: np.ndarray, former: np.ndarray, n: np.ndarray, least: int = LEAST) -> np.ndarray:
    """The class of each word: rows of ``before`` and ``after`` count its neighbours by class, n the class bigrams.

    Adding a word to class k changes the likelihood, sum n log n over pairs less both sums over classes, to the first
    order by sum after log n[k, .] + sum before log n[., k] less its count times the logarithms of both sums. In its
    former class the word's own counts are taken out first. Class 0, the end's, takes no word; ties stay, else go to the
    first class.
    """
    count = before.sum(1)
    log = lambda x: np.log(np.maximum(x, 0.0) + 0.5)
    gain = after @ log(n).T + before @ log(n) - count[:, None] * (log(n.sum(1)) + log(n.sum(0)))[None, :]
    row, col = n[former] - after, n.T[former] - before
    stay = (after * log(row)).sum(1) + (before * log(col)).sum(1) - count * (log(row.sum(1)) + log(col.sum(1)))
    gain[:, 0] = -np.inf
    at = np.arange(len(gain))
    gain[at, former] = stay
    best = gain.argmax(1)
    return np.where((gain[at, best] > stay + 1e-9) & (count >= least), best, former)


def word_classes(found: DataFrame, n: np.ndarray) -> DataFrame:
    """word, n, cls of all words that are no seeds, from the stored or running ``contexts`` and the class bigrams: one pass."""
    classes = len(n)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[pa.Array, np.ndarray, np.ndarray] | None = None

        def out(words: pa.Array, former: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            before, after = counts[:, :classes], counts[:, 64 : 64 + classes]
            return common.record(_classes, [words, before.sum(1).astype(np.int64), moved(before, after, former, n, 1).astype(np.int32)])

        for batch in batches:
            words = batch.column(0).dictionary_encode()  # sorted, so a word's rows follow each other
            size = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False)
            keys, counts = np.frombuffer(b"".join(batch.column(2).to_pylist()), "u1"), np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u4")
            place = words.indices.to_numpy().astype(np.int64)
            table = np.bincount(np.repeat(place, size) << 7 | keys, counts, minlength=len(words.dictionary) << 7).reshape(-1, 128)
            names, former = words.dictionary, np.zeros(len(words.dictionary), np.int64)
            former[place] = batch.column(1).to_numpy()
            if last is not None:
                if last[0][0].equals(names[0]):
                    table[0] += last[2][0]
                else:
                    yield out(*last)
            last = (names[-1:], former[-1:], table[-1:].copy())
            if len(names) > 1:
                yield out(names[:-1], former[:-1], table[:-1])
        if last is not None:
            yield out(*last)

    return found.repartition(common.partitions(found.sparkSession), "word").sortWithinPartitions("word").mapInArrow(task, "word string, n long, cls int")


def mark(texts: DataFrame, known: DataFrame) -> str:
    """The folder with the class and count of each word beyond the head at all its places: one file for each part of the texts."""
    folder = common.scratch(texts.sparkSession, "marks")
    places = texts.where(F.size("tail") > 0).select("part", "start", F.posexplode("tail").alias("k", "word")).select("part", (F.col("start") + F.col("k")).alias("place"), "word")

    def write(rows: pa.Table) -> pa.Table:
        size, place = len(rows), rows["place"].to_numpy()
        counts, classes = np.zeros(size, "<i8"), np.zeros(size, "u1")
        counts[place], classes[place] = rows["n"].to_numpy(), rows["cls"].to_numpy()
        common.put(folder, str(rows["part"][0].as_py()), counts.tobytes() + classes.tobytes())
        return pa.table({"n": pa.array([size], pa.int64())})

    met = places.join(known, "word", "left").select("part", "place", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("cls", F.lit(NONE)).cast("int").alias("cls"))
    met.groupBy("part").applyInArrow(write, "n long").agg(F.sum("n")).collect()
    return folder


def likelihood(n: np.ndarray) -> float:
    """Of class bigrams, as far as it depends on the classes of words."""
    h = lambda x: float((x * np.log(np.maximum(x, 1e-300))).sum())
    return h(n) - h(n.sum(0)) - h(n.sum(1))


@dataclass
class Model:
    ending: np.ndarray  # class of each unit, for words that are not known
    transition: np.ndarray  # log10 P(class | class before)
    emission: np.ndarray  # of each class: log10 of its tokens, words and the unknown word
    train_tokens: int
    words: int
    head: np.ndarray  # class of each head word
    marks: str = ""  # where class and count of all other words are, by place


def class_model(bigrams: np.ndarray, tokens: np.ndarray, types: np.ndarray, train_tokens: int, words: int, ending: np.ndarray, head: np.ndarray) -> Model:
    """From class bigrams, and the tokens and distinct words of each class."""
    share = (tokens + 1) / (tokens.sum() + len(tokens))
    transition = (bigrams + PRIOR * share[None, :]) / (bigrams.sum(1, keepdims=True) + PRIOR)
    return Model(ending, np.log10(transition), np.log10(tokens + types + 1), train_tokens, words, head)


def train(docs: DataFrame, teach: Column, head: int = HEAD, seeds: int = SEEDS, endings: int = ENDINGS, classes: int = CLASSES) -> tuple[DataFrame, DataFrame, object, Model]:
    """The texts as numbers, the stored classes and counts of words, the shared vocabulary and the model, from the documents
    that ``teach`` is true for (or null)."""
    spark = docs.sparkSession
    common.batches(spark)
    teach = F.coalesce(teach, F.lit(True))
    counts = common.cut(word_counts(docs.where(teach)), "word-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    vocab = vocabulary(counts, head, seeds, endings)
    shared = spark.sparkContext.broadcast(vocab)
    texts = common.cut(coded(docs, ~teach, shared), "texts")
    own_texts, size = texts.where("not held_out"), vocab.units
    units = _matrix(own_texts, size, lambda batch: batch.units(_tables(shared)[2]))
    own = exchange(units, classes)
    classes = int(own.max()) + 1
    member = np.zeros((size, classes))
    member[np.arange(size), own] = 1
    bigrams, tokens = member.T @ units @ member, max(int(total["n"]), 1)
    first = [(w.decode(), int(n), int(own[2 + k])) for k, (w, n) in enumerate(zip(vocab.words[:seeds], vocab.counts[:seeds], strict=True))]
    ends = counts.where(F.col("word") == END).select("word", "n", F.lit(0).alias("cls"))
    place = {w: k for k, w in enumerate(vocab.words)}
    state, known = State(own[vocab.units_of()], own), None
    while True:
        rest = word_classes(contexts(own_texts, shared, spark.sparkContext.broadcast(state)), bigrams)
        told = common.cut(rest.unionByName(spark.createDataFrame(first, "word string, n long, cls int")).unionByName(ends), "word-classes")
        # The classes of the head go to every task, those of all other words to their places.
        rows = told.where((F.col("n") >= vocab.least) & (F.col("word") != END)).select("word", "cls").toArrow()
        of_head = np.zeros(len(place), np.int64)
        for w, c in zip(rows["word"].cast(pa.binary()).to_pylist(), rows["cls"].to_pylist(), strict=True):
            of_head[place[w]] = c
        after = State(of_head, own, mark(texts, told))
        sent = spark.sparkContext.broadcast(after)
        again = _matrix(own_texts, classes, lambda batch, sent=sent: batch.kinds(sent.value))
        rise = (likelihood(again) - likelihood(bigrams)) / tokens
        if known is None or rise > 0:
            state, known, bigrams = after, told, again
        if rise < SETTLED:
            break
    emitted, types = np.zeros(classes), np.zeros(classes)
    for r in known.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():
        emitted[r["cls"]], types[r["cls"]] = r["n"], r["k"]
    model = class_model(bigrams, emitted, types, int(total["n"]), int(total["v"]), own, state.head)
    model.marks = state.marks
    return texts, known, shared, model


def score(texts: DataFrame, known: DataFrame, shared, model: Model) -> DataFrame:
    """Token counts, base score and model score (log10 probabilities) of every text, and its perplexity.

    Both scores need log10(count + 1) of every word, the model's also its class: head words have them in the task, all others at their
    places."""
    sent = texts.sparkSession.sparkContext.broadcast((model, known.where(F.col("word") == END).select("n").collect()))
    common.batches(texts.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ends = sent.value
        state, counts, end = State(own.head, own.ending, own.marks), shared.value.counts, ends[0]["n"] if ends else 0
        for batch in batches:
            b = Batch(batch)
            if not len(b.ends):
                continue
            head, n = b.codes >= 0, np.empty(len(b.codes), np.int64)
            n[head], n[~head] = counts[b.codes[head]], b.marks(state)[1]
            n, kind = b.around(n, end)[1:], b.around(b.kinds(state))
            value = own.transition[kind[:-1], kind[1:]] - own.emission[kind[1:]]
            stops = b.ends + np.arange(1, len(b.ends) + 1)  # of each text with its end token
            starts = np.concatenate([[0], stops[:-1]])
            sums = [np.add.reduceat(x, starts) for x in ((n > 0).astype(np.int64), np.log10(n + 1.0), value)]
            yield common.record(_scored, [batch.column(0), batch.column(1), stops - starts, *sums])

    sums = texts.mapInArrow(task, SCORED).withColumn("score", F.col("logs") + F.col("value"))
    n, base = F.col("n_tokens"), math.log10(model.train_tokens + model.words + 1)
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), (F.col("logs") - n * F.lit(base)).alias("base_score"), "score", F.pow(F.lit(10.0), -F.col("score") / n).alias("perplexity"))
