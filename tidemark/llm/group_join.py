"""Exact n-gram Jaccard join by a grouped prefix join, and the components that its links form.

1. Each document is the set of its word n-grams (64-bit hashes). Equal sets are one class with copies.
2. A set's n-grams are ordered by a count sketch of the corpus, the rarest first (ties by hash, so all tasks agree). Two
   sets of the wanted similarity share an n-gram of their prefixes, and their sizes differ by no more than the threshold.
3. Classes with the same prefix and size are one group. By prefix n-gram, groups meet in order of size; a gap in the
   sizes wider than the threshold parts them into stretches. In a stretch of at most ``SHORT`` groups each pair is a
   candidate if its sizes and its parity marks allow the similarity; the groups of a longer one are all joined to its
   smallest: one edge for each row, never all pairs. The components of these edges hold every pair that passes the filters.
4. Groups expand to their classes. The sets of a component (or, if it is large, of blocks of it by size) meet in one tile,
   where overlaps are counted and pairs verified exactly. A tile returns one row for each class: its links and its root.
5. Components over tiles give the component of each class, and so of each document.

Defined results: null text and text without words have size 0 and no links; repeated rows are copies; rows of one id with
different texts are documents of their own, which link by their texts only; a null id takes part but never names a
component (a component of null ids only has a null id); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .components import components

#: Counters of the sketch (2 to the power), rows it is summed in.
SKETCH, CHUNKS = 22, 64
#: N-grams and classes of a block; a pair of blocks makes a tile.
BLOCK_GRAMS, BLOCK_CLASSES = 1_000_000, 1000
#: Rows up to which a list of classes is broadcast (24 bytes each); beyond, it is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Classes of a cluster from which its rows are found by a list of such clusters instead of a shuffle.
HOT = 200
#: Groups of a stretch up to which its pairs are filtered one by one, a fixed multiple of its rows.
SHORT = 16
SETS = "doc_id long, text_key long, size int, digest binary, prefix binary, mark binary"
_sets = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("size", pa.int32()), ("digest", pa.binary()), ("prefix", pa.binary()), ("mark", pa.binary())])
_mix = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x7FB5D329728EA185)]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


_hashes = _Hashes()


def grams(text: bytes, n: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word n-grams; of fewer words, the whole sequence is one."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    k = min(n, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64) * _mix[1]
    for j in range(k):
        out = (out ^ h[j : len(h) - k + 1 + j]) * _mix[0]
        out ^= out >> np.uint64(29)
    out *= _mix[3]
    out ^= out >> np.uint64(32)
    return np.unique(out)


def prefix_length(size: int, percent: int) -> int:
    """size - ceil(size * percent / 100) + 1."""
    return size - -(-size * percent // 100) + 1


def parity_mark(g: np.ndarray) -> bytes:
    """One bit for each cell of a table about as large as the set: whether an odd number of its n-grams fall there."""
    cells = 64
    while cells < len(g):
        cells *= 2
    return np.packbits((np.bincount((g & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1).astype(np.uint8)).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """At least so many n-grams are in one of the sets only: marks of a symmetric difference are the xor of both marks."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):  # half a table is the xor of its halves
        if len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        else:
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def sketch(docs: DataFrame, n: int) -> np.ndarray:
    """How many documents hold n-grams of each counter, as eighths of a power of two (one byte). Its size is fixed."""
    schema = pa.schema([("chunk", pa.int32()), ("counts", pa.binary())])
    width = (1 << SKETCH) // CHUNKS

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH, np.uint32)
        pending, held = [], 0
        for batch in rows:
            for text in common.as_bytes(batch.column(1)):
                pending.append((grams(text, n) >> np.uint64(64 - SKETCH)).astype(np.int64))
                held += len(pending[-1])
                if held > 1_000_000:
                    total += np.bincount(np.concatenate(pending), minlength=len(total)).astype(np.uint32)
                    pending, held = [], 0
        if pending:
            total += np.bincount(np.concatenate(pending), minlength=len(total)).astype(np.uint32)
        pack = zstandard.ZstdCompressor(level=1).compress
        for k in range(CHUNKS):
            part = total[k * width : (k + 1) * width]
            if part.any():
                yield common.record(schema, [[k], [pack(part.tobytes())]])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, unpack = np.zeros(width, np.uint64), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for data in batch.column(1).to_pylist():
                total += np.frombuffer(unpack(data), np.uint32)
        yield common.record(schema, [[key[0].as_py()], [np.minimum(8 * np.log2(total + 1.0), 255).astype(np.uint8).tobytes()]])

    out = np.zeros((CHUNKS, width), np.uint8)
    for r in common.texts(docs).mapInArrow(count, "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect():
        out[r["chunk"]] = np.frombuffer(r["counts"], np.uint8)
    return out.ravel()


def sets(docs: DataFrame, counters: np.ndarray, n: int, percent: int) -> DataFrame:
    """Size, digest and prefix of each document's set."""
    shared = docs.sparkSession.sparkContext.broadcast(counters)

    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = shared.value
        for batch in rows:
            size, digest, prefix, mark = [], [], [], []
            for text in common.as_bytes(batch.column(1)):
                g = grams(text, n)
                size.append(len(g))
                digest.append(xxhash.xxh3_128_digest(g.tobytes()))
                mark.append(parity_mark(g))
                p = prefix_length(len(g), percent) if len(g) else 0
                order = rare[(g >> np.uint64(64 - SKETCH)).astype(np.int64)]
                if p and p < len(g):
                    # g is sorted, so a stable sort by the counter orders ties by hash.
                    g = g[np.argsort(order, kind="stable")[:p]]
                prefix.append(g[:p].tobytes())
            yield common.record(_sets, [batch.column(0), batch.column(2), size, digest, prefix, mark])

    return common.texts(docs).withColumn("text_key", F.xxhash64("text")).mapInArrow(task, SETS)


def classes_of(found: DataFrame) -> DataFrame:
    """A row for each distinct set: its node, copies, the row that stands for it (its least id), its group, its prefix.

    Nodes number the rows, so no two classes share one; store the result before it is used twice.
    """
    rows = found.where("size > 0").groupBy("size", "digest").agg(F.count("*").alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("row"), F.first("prefix").alias("prefix"), F.first("mark").alias("mark"))
    return rows.select(F.monotonically_increasing_id().alias("node"), "size", "digest", "copies", F.col("row.doc_id").alias("doc_id"), F.col("row.text_key").alias("text_key"), F.xxhash64("prefix", "size").alias("group"), "prefix", "mark")


def candidates(classes: DataFrame, percent: int) -> DataFrame:
    """a, b: edges whose components hold all pairs of groups that share a prefix n-gram and have sizes close enough."""
    schema = pa.schema([("gram", pa.int64()), ("group", pa.int64()), ("size", pa.int32())])

    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            each = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
            times = [len(x) for x in each]
            yield common.record(schema, [np.concatenate(each) if each else [], np.repeat(batch.column(0).to_numpy(), times), np.repeat(batch.column(1).to_numpy(), times)])

    # A group of several classes has no mark of its own, so none of its pairs is ruled out by marks.
    groups = classes.groupBy("group", "size").agg(F.first("prefix").alias("prefix"), F.when(F.count("*") == 1, F.first("mark")).alias("mark"))
    rows = groups.mapInArrow(task, "gram long, group long, size int")
    by = Window.partitionBy("gram").orderBy("size", "group")
    before = F.lag("size").over(by)
    # A group that is too large for the one before starts a stretch; all later groups are too large for that one as well.
    starts = rows.withColumn("first", F.when(before.isNull() | (before * 100 < F.col("size") * percent), F.col("group")))
    stretch = starts.withColumn("b", F.last("first", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    counted = common.cut(stretch.withColumn("n", F.count("*").over(Window.partitionBy("gram", "b"))).where("n > 1").select("gram", "group", "b", "n"), "stretches")
    long = counted.where(F.col("n") > SHORT).where(F.col("group") != F.col("b")).select(F.col("group").alias("a"), "b").distinct()
    each = counted.where(F.col("n") <= SHORT).groupBy("gram", "b").agg(F.collect_list("group").alias("gs")).select("gs")
    pair = F.explode(F.flatten(F.transform("gs", lambda x: F.transform(F.filter("gs", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b"))))))
    pairs = each.select(pair.alias("p")).select("p.a", "p.b").distinct()
    marks = groups.select("group", "size", "mark")
    met = pairs.join(marks.select(F.col("group").alias("a"), F.col("size").alias("sa"), F.col("mark").alias("ma")), "a").join(marks.select(F.col("group").alias("b"), F.col("size").alias("sb"), F.col("mark").alias("mb")), "b").select("a", "b", "sa", "sb", "ma", "mb")
    edges = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for sa, sb, ma, mb in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                fits = 100 * min(sa, sb) >= percent * max(sa, sb)
                keep.append(fits and (ma is None or mb is None or (100 + percent) * apart(ma, mb) <= (100 - percent) * (sa + sb)))
            yield common.record(edges, [batch.column(0), batch.column(1)]).filter(pa.array(keep, pa.bool_()))

    return long.unionByName(met.mapInArrow(near, "a long, b long"))


def tiles(classes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """tile, side and class: small components share tiles by hash; a large one is cut into blocks by bands of size.

    Sizes a band apart are a threshold apart, so only blocks of one band or of neighbouring bands make tiles.
    """
    slim = classes.select("node", "group", "size", "copies", "doc_id", "text_key")
    placed = slim.join(labels.select(F.col("node").alias("group"), "label"), "group", "left").withColumn("cluster", F.coalesce("label", "group")).drop("label", "group")
    placed = common.cut(placed, "placed")
    weight = common.cut(placed.groupBy("cluster").agg(F.sum("size").alias("grams"), F.count("*").alias("n")).where("n > 1"), "weights")
    # The rows of a large cluster stay where they are: such clusters are at most a HOT-th of the classes.
    hot = common.small(weight.where(F.col("n") > HOT), BROADCAST_ROWS)
    others = placed.join(hot.select("cluster"), "cluster", "left_anti").join(weight.where(F.col("n") <= HOT), "cluster")
    several = common.cut(placed.join(hot, "cluster").unionByName(others), "clusters")
    small = (F.col("grams") <= BLOCK_GRAMS) & (F.col("n") <= BLOCK_CLASSES)
    total = several.where(small).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("g"), F.count("*").alias("n")).first()
    shelves = 1 + max(total["g"] // BLOCK_GRAMS, total["n"] // (4 * BLOCK_CLASSES))
    keep = ["node", "size", "copies", "doc_id", "text_key"]
    one = several.where(small).select(*keep, F.concat(F.lit("s"), F.pmod(F.xxhash64("cluster"), F.lit(shelves))).alias("tile"), F.lit(0).alias("side"))
    band = F.floor(F.log(F.col("size").cast("double")) / F.lit(float(np.log(100 / percent)))).cast("int")
    large = several.where(~small).withColumn("band", band)
    blocks = large.groupBy("cluster", "band").agg(F.greatest(F.ceil(F.sum("size") / BLOCK_GRAMS), F.ceil(F.count("*") / BLOCK_CLASSES)).cast("int").alias("k"))
    counts = blocks.groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("band", "k"))).alias("ks"))
    cells = large.join(counts, "cluster").withColumn("own", F.pmod(F.xxhash64("node"), F.col("ks")[F.col("band")]).cast("int"))

    def upto(count):
        return F.when(count > 0, F.sequence(F.lit(0), count - 1))

    def name(*parts):
        return F.concat_ws("_", F.lit("l"), F.col("cluster"), *parts)

    here, following, previous = (F.try_element_at("ks", F.col("band") + d) for d in (0, 1, -1))
    out = [
        cells.withColumn("j", F.explode(upto(here))).select(*keep, name(F.col("band"), F.least("own", "j"), F.col("band"), F.greatest("own", "j")).alias("tile"), F.when(F.col("own") > F.col("j"), 1).otherwise(0).alias("side"), (F.col("own") == F.col("j")).alias("same")),
        cells.withColumn("j", F.explode(upto(following))).select(*keep, name(F.col("band"), F.col("own"), F.col("band") + 1, F.col("j")).alias("tile"), F.lit(0).alias("side"), F.lit(False).alias("same")),
        cells.withColumn("j", F.explode(upto(previous))).select(*keep, name(F.col("band") - 1, F.col("j"), F.col("band"), F.col("own")).alias("tile"), F.lit(1).alias("side"), F.lit(False).alias("same")),
    ]
    return one.withColumn("same", F.lit(True)).unionByName(out[0]).unionByName(out[1]).unionByName(out[2])


_linked = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])


def verify(sizes: np.ndarray, members: list[np.ndarray], side: np.ndarray | None, copies: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For each set: the place of its component's first set, and the copies of all sets linked with it.

    ``side`` restricts pairs to sets of different sides. Overlaps are counted over n-grams that two sets hold at least,
    by bit rows where the sets are alike, else by walking the lists of sets that hold a set's n-grams.
    """
    m = len(members)
    flat = np.concatenate(members)
    owner = np.repeat(np.arange(m), [len(x) for x in members])
    order = np.argsort(flat, kind="stable")
    ordered, owner = flat[order], owner[order]
    start = common.runs(ordered)
    length = np.diff(np.append(start, len(ordered)))
    shared = length > 1
    which = np.repeat(np.cumsum(shared) - 1, length)
    keep = np.repeat(shared, length)
    owner, which = owner[keep], which[keep]
    length = length[shared]
    begin = np.concatenate([[0], np.cumsum(length)])
    by_set = np.argsort(owner, kind="stable")
    grams_of, first = which[by_set], np.searchsorted(owner[by_set], np.arange(m + 1))
    words = -(-len(length) // 64)
    root, links = np.arange(m), np.zeros(m, np.int64)
    bits = None
    if m * m * words < 2 * int((length.astype(np.int64) ** 2).sum()):
        raw = np.zeros((m, words * 64), bool) if m * words < 1 << 22 else None
        if raw is not None:
            raw[owner, which] = True
            bits = np.packbits(raw, axis=1).view(np.uint64)
            del raw
    for j in range(m):
        own = grams_of[first[j] : first[j + 1]]
        if not len(own) or not j:
            continue
        if bits is not None:
            overlap = np.bitwise_count(bits[:j] & bits[j]).sum(1, dtype=np.int64)
        else:
            n = length[own]
            at = np.repeat(begin[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
            near = owner[at]
            overlap = np.bincount(near[near < j], minlength=j)[:j]
        hit = (100 + percent) * overlap >= percent * (sizes[:j] + sizes[j])
        if side is not None:
            hit &= side[:j] != side[j]
        to = np.flatnonzero(hit)
        if len(to):
            links[j] += copies[to].sum()
            links[to] += copies[j]
            roots = np.unique(np.append(root[to], root[j]))
            root[np.isin(root, roots[1:])] = roots[0]
    return root, links


def linked(docs: DataFrame, placed: DataFrame, n: int, percent: int) -> DataFrame:
    """node, root, links of each class in each of its tiles, where it has links."""
    schema = pa.schema([("tile", pa.string()), ("node", pa.int64()), ("side", pa.int32()), ("same", pa.bool_()), ("copies", pa.int64()), ("grams", pa.binary())])
    placed = common.small(common.cut(placed, "tiles"), BROADCAST_ROWS)
    rows = common.texts(docs).withColumn("text_key", F.xxhash64("text")).alias("d")
    met = rows.join(placed.alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.text_key") == F.col("p.text_key"))).select("p.tile", "p.node", "p.side", "p.same", "p.copies", "d.text")

    def hashes(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            yield common.record(schema, [*batch.columns[:5], [grams(x, n).tobytes() for x in common.as_bytes(batch.column(5))]])

    def check(key: tuple, table: pa.Table) -> pa.Table:
        node = table["node"].to_numpy()
        _, once = np.unique(node, return_index=True)  # a row that is repeated comes more than once
        members = [np.frombuffer(table["grams"][int(k)].as_py(), np.uint64) for k in once]
        sizes = np.array([len(x) for x in members], np.int64)
        by = np.argsort(sizes, kind="stable")
        once, members, sizes = once[by], [members[k] for k in by], sizes[by]
        side = None if table["same"][0].as_py() else table["side"].to_numpy()[once]
        root, links = verify(sizes, members, side, table["copies"].to_numpy()[once], percent)
        node = node[once]
        some = np.flatnonzero(links > 0)
        return pa.Table.from_arrays([pa.array(node[some]), pa.array(node[root[some]]), pa.array(links[some])], schema=_linked)

    return met.mapInArrow(hashes, "tile string, node long, side int, same boolean, copies long, grams binary").groupBy("tile").applyInArrow(check, "node long, root long, links long")


def join(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, n_links (documents it is linked with, copies included)."""
    found = common.cut(sets(docs, sketch(docs, n), n, percent), "sets")
    classes = common.cut(classes_of(found), "classes")
    labels = components(candidates(classes, percent))
    each = common.cut(linked(docs, tiles(classes, labels, percent), n, percent), "links")
    label = components(each.select(F.col("node").alias("a"), F.col("root").alias("b")))
    least = label.join(classes.select("node", "doc_id"), "node").groupBy("label").agg(F.min("doc_id").alias("component"))
    linked_ones = label.join(least, "label").join(each.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").select("node", "label", "component", "links")
    known = classes.select("node", "size", "digest", "copies", F.col("doc_id").alias("own")).join(linked_ones, "node", "left")
    component = F.when(F.col("label").isNull(), F.col("own")).otherwise(F.col("component"))
    known = known.select("size", "digest", F.coalesce("label", "node").alias("component_key"), component.alias("component"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    rows = found.select("doc_id", "text_key", "size", "digest").join(known, ["size", "digest"], "left")
    empty = F.col("size") == 0
    return rows.select("doc_id", "text_key", F.col("size").cast("long").alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_key", F.xxhash64("doc_id", "text_key")).alias("component_key"), empty.alias("empty"))


def one_of_each(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """The rows of ``docs`` without those whose component has an earlier document; rows without words all stay."""
    found = common.cut(join(docs, n, percent), "components")
    rows = found.where(~F.col("empty"))
    first = rows.groupBy("component_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("row")).select("row.doc_id", "row.text_key")
    gone = rows.select("doc_id", "text_key").join(first.withColumn("stays", F.lit(True)), rows["doc_id"].eqNullSafe(first["doc_id"]) & (rows["text_key"] == first["text_key"]), "left").where("stays is null").select(rows["doc_id"], rows["text_key"]).distinct()
    gone_id, gone_key, nth = common.free(docs.columns, "gone_id", "gone_key", "nth")
    gone = common.small(common.cut(gone, "gone"), BROADCAST_ROWS).select(F.col("doc_id").alias(gone_id), F.col("text_key").alias(gone_key))
    kept = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col(gone_id)) & (F.xxhash64(docs["text"]) == F.col(gone_key)), "left_anti")
    again = rows.groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count()
    if again:  # the very same row more than once: one stays
        blank = ~F.coalesce("text", F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
        single = kept.where(~blank).withColumn(nth, F.xxhash64("text")).dropDuplicates(["doc_id", nth]).drop(nth)
        kept = single.unionByName(kept.where(blank))
    return kept
