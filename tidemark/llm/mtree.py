"""Exact top-k inner product search in M-trees, best first.

Vectors become integers, floor(256 x). With M the largest norm of a shard, a vector x gets the coordinate
sqrt(M^2 - |x|^2) and a query the coordinate 0, so the largest inner products are the smallest distances.

1. Equal vectors are one object with its k + 1 smallest ids: no other id of the group can be among the k best of a query.
2. Objects are dealt to the nearest of at most ``PIVOTS`` pivots (medoids of a bounded sample); a pivot's objects are
   shards of about ``SHARD``. Each shard is an M-tree of pages of at most ``PAGE`` entries, which hold a routing object,
   its covering radius and its distance to the parent.
3. Blocks of about ``BLOCK`` queries first search the shard that their own vectors belong to. With the scores found
   there as limits they meet the other shards of those cells only that, by the distance of their pivot and their radius, may
   hold something better; a query that is beyond its limit in a cell is left out of the block before anything is shuffled.
4. A search takes pages by the least distance that any of the block's queries may find there, and stops when no page can
   hold a better object for any query. The stored distances to the parent rule entries and queries out before distances
   are computed; those of one page and the queries that are left are one matrix product. Scores are exact integers.

Defined results: null vectors and vectors with null or non-finite components take no part; vectors of another length than
the query's are no candidates for it; of repeated rows only the query's own is left out; fewer than k candidates give
fewer rows; an empty table gives no rows. Inner products beyond 63 bits are not supported.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SHARD, PAGE, FANOUT, BLOCK = 8192, 128, 32, 256
#: Pivots of a vector length, and vectors of the sample that gives them.
PIVOTS, SAMPLE = 64, 4096
_found = pa.schema([("key", pa.binary()), ("score", pa.int64()), ("vec_id", pa.int64())])
FOUND = "key binary, score long, vec_id long"
#: The least score: no limit.
NONE = -(1 << 63)


def medoids(x: np.ndarray, k: int, rounds: int = 4) -> np.ndarray:
    """Rows of x near the means of about k groups of about equal extent."""
    at = np.linspace(0, len(x) - 1, k).astype(np.int64)
    centres = x[at].astype(np.float64)
    for _ in range(rounds):
        near = (x @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    closest = (x @ centres.T - (centres**2).sum(1) / 2 - (x.astype(np.float64) ** 2).sum(1)[:, None] / 2).argmax(0)
    return np.unique(closest)


class Tree:
    """Pages as slices of entry arrays: object, radius, distance to the parent, child page (-1: the object itself)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, ends: np.ndarray | None = None):
        """Object k has the ids up to ends[k]; without ``ends``, one each."""
        self.ids, self.ends = ids, np.arange(1, len(x) + 1) if ends is None else ends
        self.x, self.norm = x, (x.astype(np.float64) ** 2).sum(1)
        self.bound = float(self.norm.max()) if len(x) else 0.0
        self.extra = np.sqrt(np.maximum(self.bound - self.norm, 0))
        self.start, self.end = [], []
        entries: list[tuple] = []
        self._pages(np.arange(len(x)), -1, entries)
        self.obj, self.radius, self.parent, self.child = (np.array(c) for c in zip(*entries)) if entries else (np.zeros(0),) * 4

    def between(self, a: int, to: np.ndarray) -> np.ndarray:
        """Distances of object a to others; in the metric space every object has the squared norm ``bound``."""
        ip = self.x[to].astype(np.float64) @ self.x[a].astype(np.float64) + self.extra[to] * self.extra[a]
        return np.sqrt(np.maximum(2 * (self.bound - ip), 0))

    def _pages(self, members: np.ndarray, parent: int, entries: list[tuple]) -> int:
        """Add the page of these objects below the routing object ``parent``; its number."""
        page = len(self.start)
        self.start.append(0)
        self.end.append(0)
        away = self.between(parent, members) if parent >= 0 else np.zeros(len(members))
        if len(members) <= PAGE:
            own = list(zip(members.tolist(), [0.0] * len(members), away.tolist(), [-1] * len(members)))
        else:
            k = min(FANOUT, -(-len(members) // (PAGE // 2)))
            lifted = np.column_stack([self.x[members].astype(np.float64), self.extra[members]])
            routes = members[medoids(lifted, k)]
            near = np.stack([self.between(int(r), members) for r in routes], 1)
            which = near.argmin(1)
            if np.bincount(which).max() > len(members) * 0.9:  # no distance tells them apart: cut into pages
                which = np.arange(len(members)) * k // len(members)
                routes = np.array([members[which == r][0] for r in range(k)])
            own = []
            for r, route in enumerate(routes.tolist()):
                part = members[which == r]
                if len(part):
                    child = self._pages(part, route, entries)
                    at = float(self.between(parent, np.array([route]))[0]) if parent >= 0 else 0.0
                    own.append((route, float(self.between(route, part).max()), at, child))
        self.start[page] = len(entries)
        entries += own
        self.end[page] = len(entries)
        return page

    def __getstate__(self) -> dict:
        """Vectors travel in the smallest integers that hold them."""
        low, high = (int(self.x.min()), int(self.x.max())) if self.x.size else (0, 0)
        small = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
        return self.__dict__ | {"x": self.x.astype(small)}

    def search(self, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """For each query the number of its best ids with scores of ``floor`` or more (k at most, ties to smaller ids),
        their scores and ids, and how many distances were computed in all."""
        n = len(q)
        # Products below 2^52 are exact in 64-bit floats, which multiply fast; others are computed in integers.
        exact = n and len(self.x) and max(self.bound, float((q.astype(np.float64) ** 2).sum(1).max())) < 2.0**52
        kind = np.float64 if exact else np.int64
        x, q = self.x.astype(kind), q.astype(kind)
        square = (q.astype(np.float64) ** 2).sum(1) + self.bound
        slack, computed = 1e-6 * (1 + np.sqrt(square)), 0
        scores, ids, filled = np.full((n, k), NONE), np.zeros((n, k), np.int64), np.zeros(n, np.int64)
        floor = floor.copy()

        def limits(at: np.ndarray) -> np.ndarray:
            return np.where(floor[at] > NONE, np.sqrt(np.maximum(square[at] - 2.0 * floor[at], 0)) + slack[at], np.inf)

        limit = limits(np.arange(n))
        queue: list[tuple[float, int, np.ndarray, np.ndarray, np.ndarray | None]] = [(0.0, 0, np.arange(n), np.zeros(n), None)] if len(self.obj) else []
        while queue:
            _, page, active, low, to_parent = heapq.heappop(queue)
            some = low <= limit[active]
            active = active[some]
            if not len(active):
                continue
            at = np.arange(self.start[page], self.end[page])
            if to_parent is not None:
                # |d(query, parent) - d(entry, parent)| - radius is the least distance by the stored ones.
                can = np.abs(to_parent[some][None, :] - self.parent[at][:, None]) - self.radius[at][:, None] <= limit[active][None, :]
                at, active = at[can.any(1)], active[can.any(0)]
                if not len(at) or not len(active):
                    continue
            obj = self.obj[at].astype(np.int64)
            ip = x[obj] @ q[active].T
            computed += ip.size
            if self.child[at[0]] < 0:
                r, c = np.nonzero(ip >= floor[active][None, :])
                if not len(r):
                    continue
                hit, o = np.unique(active[c]), obj[r]
                times = self.ends[o] - np.where(o > 0, self.ends[o - 1], 0)
                more = np.repeat(self.ends[o] - np.cumsum(times), times) + np.arange(int(times.sum()))
                old = np.arange(k)[None, :] < filled[hit][:, None]
                who = np.concatenate([np.repeat(active[c], times), np.repeat(hit, filled[hit])])
                score = np.concatenate([np.repeat(ip[r, c].astype(np.int64), times), scores[hit][old]])
                name = np.concatenate([self.ids[more], ids[hit][old]])
                order = np.lexsort((name, -score, who))
                who, score, name = who[order], score[order], name[order]
                first = common.runs(who)
                place = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
                keep = place < k
                scores[who[keep], place[keep]], ids[who[keep], place[keep]] = score[keep], name[keep]
                filled[hit] = np.minimum(np.diff(np.append(first, len(who))), k)
                full = hit[filled[hit] == k]
                floor[full] = np.maximum(floor[full], scores[full, k - 1])
                limit[full] = limits(full)
            else:
                d = np.sqrt(np.maximum(square[active][None, :] - 2.0 * ip, 0))
                low = np.maximum(d - self.radius[at][:, None], 0)
                on = low <= limit[active][None, :]
                for h in np.flatnonzero(on.any(1)).tolist():
                    own = on[h]
                    heapq.heappush(queue, (float(low[h][own].min()), int(self.child[at[h]]), active[own], low[h][own], d[h][own]))
        return filled, scores, ids, computed


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, key (the vector's bytes), dim, v: the vectors that take part, as integers."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.col("embedding").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].alias("embedding")).where("vec_id is not null").where(fine).select("vec_id", F.transform(x, lambda c: F.floor(c * 256)).alias("v"))
    return rows.select("vec_id", F.encode(F.array_join(F.col("v").cast("array<string>"), ","), "utf-8").alias("key"), F.size("v").alias("dim"), "v")


def objects(rows: DataFrame, is_query, k: int) -> DataFrame:
    """key, dim, v, ids (the k + 1 smallest of the rows with this vector, as often as they occur), asked (one is a query).

    The smallest ids of each key are found per task first, so a vector that millions of rows share is no hot key.
    """
    by = Window.partitionBy("key").orderBy("vec_id")
    few = rows.select("key", "vec_id").withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= k + 1)
    ids = few.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    each = rows.groupBy("key").agg(F.max(is_query(F.col("vec_id"))).alias("asked"), F.first("v").alias("v"), F.first("dim").alias("dim"))
    return each.join(ids, "key")


def pivots(found: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Medoids of a bounded sample, for each vector length in it."""
    sample = found.select("dim", "key", "v").orderBy(F.xxhash64("key"), "key").limit(SAMPLE).collect()
    out = {}
    for dim in sorted({r["dim"] for r in sample}):
        x = np.array([r["v"] for r in sample if r["dim"] == dim], np.float64).reshape(-1, dim)
        out[dim] = x[medoids(x, min(n, len(x)))]
    return out


def dealt(found: DataFrame, own) -> DataFrame:
    """``found`` with its cell, the vector length and the nearest of the broadcast pivots, and the distance to that pivot."""
    schema = pa.schema([("key", pa.binary()), ("dim", pa.int32()), ("v", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("asked", pa.bool_()), ("cell", pa.string()), ("away", pa.float64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, vs = batch.column(1).to_numpy(), batch.column(2)
            cell, away = np.empty(len(batch), object), np.zeros(len(batch))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = vs.take(pa.array(at)).flatten().to_numpy().astype(np.float64).reshape(len(at), dim)
                p = own.value.get(dim)
                near = np.zeros(len(at), np.int64) if p is None or not dim else (x @ p.T - (p**2).sum(1) / 2).argmax(1)
                cell[at] = [f"{dim}_{z}" for z in near.tolist()]
                away[at] = np.sqrt(((x - centres(own.value, dim)[near]) ** 2).sum(1))
            yield common.record(schema, [*batch.columns, cell.tolist(), away])

    return found.select("key", "dim", "v", "ids", "asked").mapInArrow(task, "key binary, dim int, v array<long>, ids array<long>, asked boolean, cell string, away double")


def centres(own: dict[int, np.ndarray], dim: int) -> np.ndarray:
    """The pivots of a vector length; the origin for one that the sample lacks."""
    return own[dim] if dim in own else np.zeros((1, dim))


def reached(blocks: DataFrame, own, radius: dict[str, float]) -> DataFrame:
    """Blocks (dim, home, keys, vs, floors) by the cells where some of their queries may find what they lack, with those queries.

    q x = q c + q (x - c) <= q c + |q| r for every x of a cell around c with radius r; a query whose limit is above that needs no
    shard of the cell. There are at most ``PIVOTS`` cells of a vector length, so their radii fit every task."""
    schema = pa.schema([("dim", pa.int32()), ("home", pa.string()), ("cell", pa.string()), ("keys", pa.list_(pa.binary())), ("vs", pa.list_(pa.int64())), ("floors", pa.list_(pa.int64()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, home, keys, vs, floors in zip(*batch.columns, strict=True):
                dim, keys = dim.as_py(), keys.as_py()
                v, floor = vs.values.to_numpy().reshape(len(keys), dim), floors.values.to_numpy()
                q, c = v.astype(np.float64), centres(own.value, dim)
                names = [f"{dim}_{z}" for z in range(len(c))]
                reach = q @ c.T + np.sqrt((q**2).sum(1))[:, None] * np.array([radius.get(x, -np.inf) for x in names]) if dim else np.zeros((len(keys), 1))
                needs = reach + 1e-9 * np.abs(reach) + 1e-3 >= floor[:, None]  # a little more than rounding
                for z in np.flatnonzero(needs.any(0)).tolist():
                    if names[z] in radius:
                        some = np.flatnonzero(needs[:, z])
                        yield common.record(schema, [[dim], [home.as_py()], [names[z]], [[keys[r] for r in some.tolist()]], [v[some].ravel()], [floor[some]]])

    return blocks.select("dim", "home", "keys", "vs", "floors").mapInArrow(task, "dim int, home string, cell string, keys array<binary>, vs array<long>, floors array<long>")


def build(rows: DataFrame) -> DataFrame:
    """shard, tree: an M-tree of each shard. A shard's vectors have one length."""
    schema = pa.schema([("shard", pa.string()), ("tree", pa.binary())])

    def make(key: tuple, part: pa.Table) -> pa.Table:
        x = part["v"].combine_chunks().flatten().to_numpy().reshape(len(part), key[1].as_py())
        ids = part["ids"].combine_chunks()
        tree = Tree(ids.flatten().to_numpy(), x, np.cumsum([len(z) for z in ids]))
        return pa.table([[key[0].as_py()], [pickle.dumps(tree, 5)]], schema=schema)

    return rows.select("shard", "dim", "v", "ids").groupBy("shard", "dim").applyInArrow(make, "shard string, tree binary")


def met(trees: DataFrame, blocks: DataFrame, k: int, chunks: int = 1) -> DataFrame:
    """key, score, vec_id: what blocks (shard, keys, vs, floors) find in their shard's tree.

    Tree and blocks of a shard go to one task in one sorted stream, in which only the tree is held; ``chunks`` parts the
    blocks of a shard among as many tasks.
    """
    own = trees.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).select("shard", "chunk", "tree", *(F.lit(None).cast(t).alias(c) for c, t in (("keys", "array<binary>"), ("vs", "array<long>"), ("floors", "array<long>"))))
    asked = blocks.select("shard", F.pmod(F.xxhash64("keys"), F.lit(chunks)).cast("int").alias("chunk"), F.lit(None).cast("binary").alias("tree"), "keys", "vs", "floors")
    stream = own.unionByName(asked).repartition(common.partitions(trees.sparkSession), "shard", "chunk").sortWithinPartitions("shard", "chunk", F.col("tree").isNull())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            for data, keys, vs, floors in zip(*batch.columns[2:], strict=True):
                if data.is_valid:
                    tree = pickle.loads(data.as_py())
                    continue
                keys = keys.as_py()
                filled, scores, ids, _ = tree.search(vs.values.to_numpy().reshape(len(keys), -1), floors.values.to_numpy(), k)
                some = np.arange(k)[None, :] < filled[:, None]
                yield common.record(_found, [[keys[r] for r in np.repeat(np.arange(len(keys)), filled).tolist()], scores[some], ids[some]])

    return stream.mapInArrow(task, FOUND)


def top(vectors: DataFrame, is_query, k: int = 5, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query row."""
    spark = vectors.sparkSession
    common.batches(spark)
    rows = integers(vectors)
    found = common.cut(objects(rows, is_query, k), "objects")
    own = spark.sparkContext.broadcast(pivots(found, min(PIVOTS, -(-found.count() // shard) or 1)))
    cells = common.cut(dealt(found, own), "cells")
    # At most PIVOTS rows for each vector length of the sample: small enough to broadcast.
    count = cells.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard).cast("int").alias("parts"), F.count_if("asked").alias("n"), F.max("away").alias("radius"))
    placed = cells.join(F.broadcast(count), ["dim", "cell"]).withColumn("shard", F.concat_ws("_", "cell", F.pmod(F.xxhash64("key"), "parts")))
    trees = common.cut(build(placed), "mtree")
    # Queries of a shard in blocks; each distinct vector is searched once.
    blocks = F.greatest(F.ceil(F.col("n") / F.col("parts") / block), F.lit(1))
    asked = placed.where("asked").select("dim", "shard", F.pmod(F.xxhash64("key", F.lit(1)), blocks).alias("block"), "key", "v")

    def packed(queries: DataFrame) -> DataFrame:
        each = queries.groupBy("dim", "shard", "block").agg(F.collect_list(F.struct("key", "v", "floor")).alias("z"))
        return each.select("dim", "shard", F.col("z.key").alias("keys"), F.flatten("z.v").alias("vs"), F.col("z.floor").alias("floors"))

    at_home = common.cut(met(trees, packed(asked.withColumn("floor", F.lit(NONE).cast("long"))), k + 1), "own-shard")
    floors = at_home.groupBy("key").agg(F.when(F.count("*") > k, F.min("score")).otherwise(F.lit(NONE).cast("long")).alias("floor"))
    full = packed(asked.join(floors, "key")).withColumnRenamed("shard", "home")
    wanted = reached(full, own, {r["cell"]: r["radius"] for r in count.select("cell", "radius").collect()})
    others = wanted.join(F.broadcast(count.select("dim", "cell", "parts")), ["dim", "cell"]).withColumn("shard", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.concat_ws("_", "cell", p))))
    several = max(1, -(-4 * common.partitions(spark) // max(trees.count(), 1)))
    rest = met(trees, others.where("shard <> home"), k + 1, several)
    by = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    best = at_home.unionByName(rest).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k + 1)
    lists = best.groupBy("key").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("loss"), "vec_id"))).alias("best"))
    # A query row leaves itself out once, if it is among the k + 1.
    loss = -F.aggregate(F.transform("v", lambda c: c * c), F.lit(0).cast("long"), lambda a, c: a + c)
    own = rows.where(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "key", loss.alias("loss")).join(lists, "key")
    at = F.array_position("best", F.struct(F.col("loss"), F.col("query_id").alias("vec_id"))).cast("int")
    left = F.when(at > 0, F.concat(F.slice("best", F.lit(1), at - 1), F.slice("best", at + 1, F.lit(k + 1)))).otherwise(F.col("best"))
    return own.select("query_id", F.posexplode(F.slice(left, 1, k)).alias("place", "z")).select("query_id", (F.col("place") + 1).alias("rank"), F.col("z.vec_id").alias("vec_id"), (-F.col("z.loss")).alias("score"))
