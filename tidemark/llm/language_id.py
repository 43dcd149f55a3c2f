"""Language identification in two steps: the language family, then one-versus-one linear support vector machines in it.

Features are the relative frequencies of hashed letter trigrams of the whole text (lower case; everything but letters
separates words). The family is chosen by one-versus-rest machines; within it, the language that wins most duels, ties
going to the larger sum of margins. All machines are fitted by squared hinge loss on at most ``PER_LANGUAGE`` documents of
each language, taken by a hash of the id.

Defined results: null text, or text without a letter, is ``und`` with score 0; documents with a null language teach
nothing; repeated rows are predicted each; with no language learned everything is ``und``; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: The largest number of documents of one language to learn from, and hash cells of trigrams.
PER_LANGUAGE, CELLS = 1200, 4096
#: Bytes of a text that are counted at once.
BLOCK = 1 << 20
#: Languages up to which their counts are broadcast.
MAX_LANGUAGES = 10_000
STEPS, RIDGE, SCALE = 250, 1e-5, 60.0
#: Families of ISO 639-1 codes. A language that is not listed is a family of its own.
FAMILIES = {"germanic": "en de nl sv da no nb nn is fy lb af", "romance": "fr es it pt ro ca gl oc", "slavic": "ru uk be pl cs sk sl hr sr bg mk", "uralic": "fi et hu", "baltic": "lt lv", "celtic": "ga cy gd br", "turkic": "tr az kk uz", "semitic": "ar he mt", "indo-aryan": "hi ur bn mr ne pa gu"}
_family = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, family_pred string"
_predicted = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("family_pred", pa.string())])
#: ASCII bytes that are not letters become spaces, upper case lower case.
_table = bytes(b if b >= 0x80 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
_blanks = re.compile(b" +")


def family(language: str) -> str:
    return _family.get(language.lower().split("-")[0], language)


def cells(text: bytes) -> np.ndarray | None:
    """How many trigrams of bytes within words fall in each hash cell; None if the text has no letter. A long text is counted by
    blocks, so that memory follows its bytes and not the number of trigrams or languages."""
    plain = _blanks.sub(b" ", text.translate(_table)).strip()
    if not plain or plain[:1] > b"z" and not any(map(str.isalpha, text.decode())):
        return None
    plain = b" " + plain + b" "
    total = np.zeros(CELLS, np.int64)
    for at in range(0, len(plain) - 2, BLOCK):
        b = np.frombuffer(plain, np.uint8, min(BLOCK + 2, len(plain) - at), at).astype(np.uint32)
        code = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
        total += np.bincount((code[b[1:-1] != 32] * np.uint32(2654435761)) >> np.uint32(20), minlength=CELLS)
    return total


def machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias that minimise the mean squared hinge loss of y (+1, -1) plus a ridge, by accelerated gradient steps."""
    n = len(x)
    weight = np.where(y > 0, n / (2 * max((y > 0).sum(), 1)), n / (2 * max((y < 0).sum(), 1))).astype(np.float32)
    w = v = np.zeros(x.shape[1] + 1, np.float32)
    probe = np.random.default_rng(0).normal(size=x.shape[1]).astype(np.float32)
    for _ in range(12):
        probe = x.T @ (x @ (probe / np.linalg.norm(probe))) / n
    step = 1 / (2 * (float(np.linalg.norm(probe)) + 1) * float(weight.max()))
    for k in range(STEPS):
        slack = np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) * weight
        grad = np.append(x.T @ (slack * y), (slack * y).sum()) * (-2 / n)
        grad[:-1] += RIDGE * v[:-1]
        new = v - step * grad.astype(np.float32)
        v, w = new + (k / (k + 3)) * (new - w), new
    return w


@dataclass
class Languages:
    families: dict[str, list[str]]
    #: Columns: one machine for each family, then one for each pair of languages of a family.
    weights: np.ndarray
    duels: list[tuple[str, str]]

    def predict(self, text: bytes) -> tuple[str, float, str | None]:
        at = cells(text) if self.families else None
        if at is None:
            return "und", 0.0, None
        margin = (at.astype(np.float32) @ self.weights[:CELLS]) * (SCALE / max(int(at.sum()), 1)) + self.weights[CELLS]
        names, sure = list(self.families), 1.0
        k = 0
        if len(names) > 1:
            first = margin[: len(names)]
            k = int(first.argmax())
            sure = 1 / (1 + np.exp(-4 * (first[k] - np.delete(first, k).max())))
        members = self.families[names[k]]
        wins, sums = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0)
        for (a, b), m in zip(self.duels, margin[len(names) :], strict=True):
            if a in wins:
                wins[a if m >= 0 else b] += 1
                sums[a] += m
                sums[b] -= m
        best = max(members, key=lambda x: (wins[x], sums[x], x))
        worst = min((m if a == best else -m for (a, b), m in zip(self.duels, margin[len(names) :], strict=True) if best in (a, b)), default=None)
        if worst is not None:
            sure *= 1 / (1 + np.exp(-4 * worst))
        return best, float(min(max(sure, 0.0), 1.0)), names[k]


def sample(rows: DataFrame, size: int) -> DataFrame:
    """doc_id, lang of ``size`` ids of each language, those with the smallest hashes (all, if fewer).

    Ids are counted by language; only about ``size`` of each, those with a hash below a share that the count gives, are
    ranked, so no language is a large group. The texts are read after that.
    """
    each = common.cut(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    hashed = rows.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    enough = size + 8 * size**0.5 + 40  # eight deviations more than are wanted
    few = hashed.join(common.small(each, MAX_LANGUAGES), "lang").where(F.col("h") * F.col("n") < F.lit(enough) * float(1 << 40))
    by = Window.partitionBy("lang").orderBy("h", "doc_id")
    return few.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= size).select("doc_id", "lang").distinct()


def learn(docs: DataFrame, teach: Column, size: int = PER_LANGUAGE) -> Languages:
    """Fit on at most ``size`` documents of each language among those that ``teach`` is true for."""
    common.batches(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), docs["lang"].alias("lang"), teach.alias("teach")).where(F.col("teach") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    keys = sample(rows.select("doc_id", "lang"), size)
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("cells", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for doc_id, text, lang in zip(batch.column(0).to_pylist(), common.as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                if (at := cells(text)) is not None:
                    where = np.flatnonzero(at)
                    got.append((doc_id, lang, where.astype(np.int32), at[where].astype(np.int32)))
            yield common.record(schema, list(zip(*got)) if got else [[]] * 4)

    found = rows.join(F.broadcast(keys), ["doc_id", "lang"]).select("doc_id", "text", "lang").mapInArrow(task, "doc_id long, lang string, cells array<int>, counts array<int>").orderBy("doc_id", "lang").toArrow()
    langs = found["lang"].to_pylist()
    x = np.zeros((len(langs), CELLS), np.float32)
    for k, (where, count) in enumerate(zip(found["cells"], found["counts"], strict=True)):
        c = count.values.to_numpy()
        x[k, where.values.to_numpy()] = c * (SCALE / c.sum())
    names = np.array(langs, object)
    families: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        families.setdefault(family(lang), []).append(lang)
    columns, duels = [], []
    own = np.array([family(z) for z in langs], object)
    for f in families:
        columns.append(machine(x, np.where(own == f, 1, -1).astype(np.float32)) if len(families) > 1 else np.zeros(CELLS + 1, np.float32))
    for members in families.values():
        for a, b in itertools.combinations(members, 2):
            both = (names == a) | (names == b)
            columns.append(machine(x[both], np.where(names[both] == a, 1, -1).astype(np.float32)))
            duels.append((a, b))
    return Languages(families, np.stack(columns, 1) if columns else np.zeros((CELLS + 1, 0), np.float32), duels)


def predict(docs: DataFrame, model: Languages, held_out: Column) -> DataFrame:
    """The language of every document; the text is all that a prediction sees."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in rows:
            found = [own.predict(x) for x in common.as_bytes(batch.column(1))]
            yield common.record(_predicted, [batch.column(0), batch.column(2), *(list(zip(*found)) if found else [[]] * 3)])

    common.batches(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(task, PREDICTED)
