"""Prefix scans of associative operations along the history of a key, as column expressions.

A recursion whose step is a map that composes associatively (a state machine, a filter, a running best) needs no loop over a
key's rows: the maps of all rows so far are combined by doubling. Rows are cut into chunks of ``SIZE`` places; within a chunk
each round combines a row with the one 1, 2, 4, ... rows before it (windows of one key and order, so one sort). The last row of
each chunk has the chunk's map; those are scanned in the same way, and what came before a chunk is joined back to its rows. So
one key's history is dealt over many tasks, nothing runs in Python, and the cost of a row does not grow with the history. Rows
are stored once on the way, since two readers follow: a chain of scans would else plan its input many times over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import store

#: Places of a chunk; three levels of chunks hold ``SPAN`` places, which for days are the years 1600 to 2317.
SIZE, LEVELS = 64, 3
SPAN = SIZE**LEVELS
#: (rows, earlier, later, both) -> the rows with the column ``both``: the map that does what two columns do one after the other.
#: An operation of many terms takes steps, so that no common part is written out twice.
Combine = Callable[[DataFrame, str, str, str], DataFrame]


def by(f: Callable[[Column, Column], Column]) -> Combine:
    """An operation of a single expression."""
    return lambda rows, earlier, later, both: rows.withColumn(both, f(F.col(earlier), F.col(later)))


def day(column: str = "date") -> Column:
    """The place of a date: days since 1600."""
    return F.datediff(F.col(column), F.lit("1600-01-01").cast("date"))


def prefixes(rows: DataFrame, name: str, element: Column, combine: Combine, keys: list[str], place: Column, before: str | None = None) -> DataFrame:
    """Add ``name``: the elements of the key's rows up to this one, combined in order of ``place``; and ``before``, if it is named:
    those of the rows before this one, null if there are none.

    ``place`` is an integer from 0 to SPAN - 1, another one for each row of a key. ``element`` may be a struct."""
    out = _scan(rows.withColumn("_place", place.cast("int")).withColumn("_now", element), combine, keys, LEVELS, before is not None)
    out = out.withColumn(name, F.col("_now"))
    return (out.withColumn(before, F.col("_before")) if before else out).drop("_now", "_before", "_place")


def _scan(rows: DataFrame, combine: Combine, keys: list[str], levels: int, exclusive: bool) -> DataFrame:
    """``_now`` combined over all rows up to this one, and, if ``exclusive``, ``_before``: over those before it."""
    rows = rows.withColumn("_chunk", F.floor(F.col("_place") / SIZE).cast("int"))
    w = Window.partitionBy(*keys, "_chunk").orderBy("_place")
    step = 1
    while step < SIZE:
        rows = combine(rows.withColumn("_earlier", F.lag("_now", step).over(w)), "_earlier", "_now", "_both")
        rows = rows.withColumn("_now", F.when(F.col("_earlier").isNull(), F.col("_now")).otherwise(F.col("_both"))).drop("_earlier", "_both")
        step *= 2
    rows = rows.withColumn("_before", F.lag("_now", 1).over(w)) if exclusive else rows
    if levels == 1:
        return rows.drop("_chunk")
    path = store.scratch(rows.sparkSession, "scan")
    rows.withColumn("_last", F.lead("_place").over(w).isNull()).write.parquet(path)
    rows = rows.sparkSession.read.parquet(path)
    ends = rows.where("_last").select(*keys, F.col("_chunk").alias("_place"), "_now")
    above = _scan(ends, combine, keys, levels - 1, True).where("_before is not null").select(*keys, F.col("_place").alias("_chunk"), F.col("_before").alias("_carry"))
    rows = rows.join(above, [*keys, "_chunk"], "left")
    carry = F.col("_carry")
    for part in ("_now", "_before") if exclusive else ("_now",):
        rows = combine(rows, "_carry", part, "_both")
        rows = rows.withColumn(part, F.when(carry.isNull(), F.col(part)).when(F.col(part).isNull(), carry).otherwise(F.col("_both"))).drop("_both")
    return rows.drop("_carry", "_chunk", "_last")


# -- state machines ---------------------------------------------------------------------------------------------


def packed(moves: list[Column]) -> Column:
    """A map of states 0 .. n - 1, given the state that each goes to, in one long: n times as many bits as n - 1 has, 63 at most."""
    bits = max(len(moves) - 1, 1).bit_length()
    if bits * len(moves) > 63:
        raise ValueError(f"{len(moves)} states do not fit a long")
    out = F.lit(0).cast("long")
    for s, to in enumerate(moves):
        out = out.bitwiseOR(F.shiftleft(to.cast("long"), s * bits))
    return out


def moved(state: Column, by: Column, n: int) -> Column:
    """Where the packed map ``by`` of n states sends a state."""
    bits = max(n - 1, 1).bit_length()
    return F.call_function("shiftrightunsigned", by, (state * bits).cast("int")).bitwiseAND(F.lit((1 << bits) - 1))


def states(rows: DataFrame, name: str, moves: list[Column], keys: list[str], place: Column, start: int = 0, before: str | None = None) -> DataFrame:
    """Add ``name``: the state of each key after this row, from ``start``, and ``before``, if it is named: that before this row.
    ``moves``: by state, where the row sends it."""
    n = len(moves)
    bits = max(n - 1, 1).bit_length()
    part = lambda f, s: F.shiftrightunsigned(f, s * bits).bitwiseAND(F.lit((1 << bits) - 1))
    then = lambda earlier, later: packed([moved(part(earlier, s), later, n) for s in range(n)])
    out = prefixes(rows, "_map", packed(moves), by(then), keys, place, "_map_before" if before else None)
    out = out.withColumn(before, F.coalesce(part(F.col("_map_before"), start).cast("int"), F.lit(start))).drop("_map_before") if before else out
    return out.withColumn(name, part(F.col("_map"), start).cast("int")).drop("_map")


def latest(rows: DataFrame, name: str, value: Column, keys: list[str], place: Column) -> DataFrame:
    """Add ``name``: the last non-null value of the key up to this row."""
    out = prefixes(rows, "_boxed", F.struct(value.alias("v")), by(lambda a, b: F.struct(F.coalesce(b["v"], a["v"]).alias("v"))), keys, place)
    return out.withColumn(name, F.col("_boxed.v")).drop("_boxed")
