"""Sharding: minimax contiguous partition of ordered atomic groups.

Groups (rows that must stay together) stand in a fixed order, each with a size. The shards are runs of this order. A binary
search finds the smallest capacity for which greedy filling needs no more than the given number of shards; the cuts
are then placed there, each as near to an even split as that capacity allows.

The search needs only the ends of the groups on the line of summed sizes, and only near the cuts. So the line is first reduced
to a fixed number of marks, one for the last end in every equal stretch; the driver searches over the marks, notes
the stretches in which a greedy step ends and asks Spark for finer marks there, until every step of the deciding checks
ends on a true group end. What reaches the driver is bounded by ``MARKS`` and ``FINER`` whatever the number of groups. All work on
rows and groups is done by DataFrame operations.

Defined results: a null text counts as empty and shares the group of empty texts; groups are ordered by their smallest id
(nulls first), then by their digest; repeated rows are rows like any other; an empty input gives no rows. One group that is
larger than an even share sets the capacity. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.ordering import in_ranges, numbered
from tidemark.operators.distributed import materialize

MARKS = 4096
FINER = 64


class GroupEnds:
    """Known ends of groups on the line of summed sizes; ``open`` holds the left ends of gaps with ends still unknown."""

    def __init__(self, total: int):
        self.known = [0, total] if total else [0]
        self.open: dict[int, int] = {}
        self.touched: set[int] = set()

    def refine(self, left: int, found: list[tuple[int, int, int]], block: int) -> None:
        """Put the marks of an open gap in order: each is the first and last end and the number of ends of one stretch."""
        self.open.pop(left, None)
        for first, last, count in found:
            for end in {first, last} - {self.known[-1]}:
                at = bisect_left(self.known, end)
                if self.known[at] != end:
                    self.known.insert(at, end)
            if count > 2:
                self.open[first] = block

    def _look(self, x: int) -> int:
        i = bisect_right(self.known, x) - 1
        if self.known[i] < x and self.known[i] in self.open:
            self.touched.add(self.known[i])
        return i

    def before(self, x: int) -> int:
        """Largest known end that is not beyond x."""
        return self.known[self._look(x)]

    def after(self, x: int) -> int:
        """Smallest known end that is not before x."""
        self._look(x)
        return self.known[bisect_left(self.known, x)]


def fits(ends: GroupEnds, capacity: int, shards: int, total: int) -> bool:
    """Greedy check: fill shard after shard as far as the capacity goes."""
    at = 0
    for _ in range(shards):
        at = ends.before(min(total, at + capacity))
    return at >= total


def smallest_capacity(ends: GroupEnds, shards: int, total: int, largest: int) -> int:
    low, high = max(largest, -(-total // shards)), total
    while low < high:
        middle = (low + high) // 2
        if fits(ends, middle, shards, total):
            high = middle
        else:
            low = middle + 1
    return low


def even_cuts(ends: GroupEnds, capacity: int, shards: int, total: int) -> list[int]:
    """Inner cuts for which no shard exceeds the capacity, each as near to its even place as the others allow."""
    latest = [total] * (shards + 1)
    for j in range(shards - 1, 0, -1):
        latest[j] = ends.after(max(0, latest[j + 1] - capacity))
    cuts, at = [], 0
    for j in range(1, shards):
        even = total * j // shards
        down, up = ends.before(even), ends.after(even)
        near = down if even - down <= up - even else up
        at = min(max(near, latest[j]), ends.before(min(total, at + capacity)))
        cuts.append(at)
    return cuts


def _running_totals(groups: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``end``, the sum of the sizes up to and with the group; ranges of the order are summed first."""
    ranges = groups.groupBy("range").agg(F.sum("load").alias("sum"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("range", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("range").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return groups.join(offsets, "range").withColumn("end", F.col("offset") + F.sum("load").over(inside.rowsBetween(Window.unboundedPreceding, 0)))


def find_cuts(ends: DataFrame, shards: int, total: int, largest: int) -> tuple[int, list[int]]:
    """Smallest capacity and cuts for a table of group ends (columns ``end`` and ``block``, the coarse stretch)."""
    line = GroupEnds(total)
    stretch = [F.min("end").alias("first"), F.max("end").alias("last"), F.count(F.lit(1)).alias("n")]
    for r in ends.groupBy("block").agg(*stretch).collect():
        line.refine(-1, [(r["first"], r["last"], r["n"])], r["block"])
    spark = ends.sparkSession
    while True:
        line.touched.clear()
        capacity = smallest_capacity(line, shards, total, largest)
        cuts = even_cuts(line, capacity, shards, total)
        if not line.touched:
            return capacity, cuts
        gaps = [(line.open[a], a, line.known[bisect_right(line.known, a)]) for a in sorted(line.touched)]
        asked = spark.createDataFrame(gaps, "block long, low long, high long")
        inside = ends.join(F.broadcast(asked), "block").where("end > low and end < high")
        part = F.floor((F.col("end") - F.col("low")) * FINER / (F.col("high") - F.col("low"))).alias("part")
        found: dict[int, list[tuple[int, int, int]]] = {}
        for r in inside.groupBy("low", "block", part).agg(*stretch).collect():
            found.setdefault(r["low"], []).append((r["first"], r["last"], r["n"]))
        for block, low, _ in gaps:
            line.refine(low, found.get(low, []), block)


def minimax_shards(
    rows: DataFrame, group: Column, size: Column, id_col: str, shards: int, keep: dict[str, Column] | None = None
) -> DataFrame:
    """``id_col``, ``size``, the kept columns, ``shard`` and ``slot`` (0, 1, ... inside the shard) for every row.

    Rows of one group never part. The largest shard is as small as contiguous runs of groups allow.
    """
    keep = keep or {}
    named = [c.alias(n) for n, c in keep.items()]
    units = materialize(
        rows.select(F.col(id_col).alias("id"), group.alias("group"), size.cast("long").alias("size"), *named), "shard-rows"
    )
    grouped = units.groupBy("group").agg(F.sum("size").alias("load"), F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    totals = materialize(grouped, "shard-groups")
    facts = totals.agg(F.sum("load").alias("total"), F.max("load").alias("largest"), F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows")).first()
    total, largest = facts["total"] or 0, facts["largest"] or 0
    ranged = in_ranges(totals, ["first", "group"], facts["groups"], "shard-order")
    block = F.floor((F.col("end") - 1) * F.lit(MARKS / max(1, total))).cast("long")
    ends = materialize(_running_totals(ranged, ["first", "group"]).select("group", "first", "end", block.alias("block")), "shard-ends")
    _, cuts = find_cuts(ends, shards, total, largest)
    shard = sum(((F.col("end") > cut).cast("int") for cut in cuts), F.lit(0))
    placed = units.join(ends.select("group", "first", shard.alias("shard")), "group")
    out = numbered(placed, ["shard"], ["first", "group", "id"], facts["rows"] or 0, "shard-slots", "slot")
    return out.select(F.col("id").alias(id_col), "size", *keep, "shard", "slot")
