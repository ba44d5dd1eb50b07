"""Budgets that are used up in order, first fit, without a loop over rows.

What fits depends on all that went in before. Items are classed by the power of two of what they need. At any time, with
`left` of the budget, there is a class K below which items are taken as they come (their prefix sums say when one no
longer fits), while of K itself only an item that fits what is left by then is taken, and classes above K can never fit
again. A round finds the first place in the order where this changes: an item below K that doesn't fit, which makes its
class the new K, or an item of K that fits, after which K as a whole no longer does (unless it took less than it needed).
So there are about two rounds for each power of two of the budget, whatever the number of rows.

Rows lie in blocks of the order. A round compares what is left with sums, least and most of each block and class; only in
the first few blocks where something may change are rows looked at, and one row comes to the driver: the place found.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import cut
from .ordering import with_position

#: Rows of a block; tables of a few blocks are gone through row by row in one task.
BLOCK, FEW = 50_000, 4
#: Blocks whose rows a round looks at.
LOOK = 64


class Course(NamedTuple):
    """How a budget goes: from each start (a position) on, classes below the one beside it are taken as they come; but for
    the items at the positions of `out`, and with those at `single`."""

    starts: list[tuple[int, int]]
    single: list[int]
    out: list[int]

    def takes(self) -> Column:
        below = F.lit(self.starts[0][1])
        for start, kind in self.starts[1:]:
            below = F.when(F.col("pos") >= start, kind).otherwise(below)
        return (F.col("kind") < below) & ~F.col("pos").isin(self.out) | F.col("pos").isin(self.single)


def size_class(need: Column) -> Column:
    """The number of binary digits of a need: k for 2^(k-1) to 2^k - 1, 0 for nothing."""
    return F.when(need > 0, F.length(F.bin(need))).otherwise(0).cast("int")


def _course(items: DataFrame, budget: int, size: int, on_round: Callable[[int, dict], None] | None) -> Course:
    """items: pos, block (of `size` positions), need, take (over 0), kind (the class of need), checkpointed."""
    by_kind = cut(items.groupBy("block", "kind").agg(F.sum("take").alias("take"), F.min("need").alias("least"), F.max("need").alias("most")))
    left, start, kind, turn = max(budget, 0), 0, max(budget, 0).bit_length(), 0
    course = Course([(0, kind)], [], [])
    while kind:
        block, bulk = start // size, F.col("kind") < kind
        taken = F.coalesce(F.sum(F.when(bulk, F.col("take"))), F.lit(0))
        sums = by_kind.where((F.col("block") >= block) & (F.col("kind") <= kind)).groupBy("block").agg(taken.alias("take"), F.max(F.when(bulk, F.col("most"))).alias("most"), F.min(F.when(~bulk, F.col("least"))).alias("least"))
        # what lies in the block reached, but before the place reached, was counted already
        gone = items.where((F.col("block") == block) & (F.col("pos") < start) & bulk).agg(F.coalesce(F.sum("take"), F.lit(0)).alias("gone"))
        before = F.coalesce(F.sum("take").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a block
        rooms = sums.withColumn("before", before).crossJoin(F.broadcast(gone)).withColumn("room", F.lit(left) + F.col("gone") - F.col("before"))  # one row
        may = rooms.where((F.col("most") > F.col("room") - F.col("take")) | (F.col("least") <= F.col("room"))).orderBy("block").limit(LOOK).select("block", "room")
        run = F.sum(F.when(bulk, F.col("take")).otherwise(0)).over(Window.partitionBy("block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
        rows = items.where(F.col("kind") <= kind).join(F.broadcast(may), "block").withColumn("room", F.col("room") - F.coalesce(run, F.lit(0))).where(F.col("pos") >= start)  # LOOK rows
        changes = rows.where(F.when(bulk, F.col("need") > F.col("room")).otherwise(F.col("need") <= F.col("room")))
        first = changes.agg(F.min(F.struct("pos", "kind", "need", "take", "room")).alias("f"))
        found = may.agg(F.max("block").alias("seen"), F.count(F.lit(1)).alias("blocks")).crossJoin(first).first()  # one row each
        turn += 1
        if on_round:
            on_round(turn, found.asDict(recursive=True) | {"left": left, "watched": kind})
        f = found["f"]
        if f is None and found["blocks"] < LOOK:
            break
        if f is None:  # nothing changes up to the last block looked at: go on behind it
            passed = items.where((F.col("pos") >= start) & (F.col("block") <= found["seen"]) & bulk).agg(F.coalesce(F.sum("take"), F.lit(0))).first()[0]
            left, start = left - passed, (found["seen"] + 1) * size
            continue
        start, left = f["pos"] + 1, f["room"]
        if f["kind"] < kind:
            course.out.append(f["pos"])
        else:
            course.single.append(f["pos"])
            left -= f["take"]
        # what needs as many binary digits more as left has can never fit; what needs as many may, what needs fewer does
        kind = min(kind, left.bit_length())
        course.starts.append((start, kind))
    return course


def _one_by_one(items: DataFrame, budget: int) -> DataFrame:
    """The positions that go in, for a few blocks: a bounded table in one task."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p, left, taken = p.sort_values("pos"), budget, []
        for pos, need, take in zip(p["pos"], p["need"], p["take"], strict=True):
            if need <= left:
                left -= take
                taken.append(pos)
        return pd.DataFrame({"pos": taken}, dtype="int64")

    return items.groupBy(F.lit(0).alias("all")).applyInPandas(run, "pos long")


def left_before(df: DataFrame, take: str, budget: int, order: list[str], name: str, need: str | None = None, on_round: Callable[[int, dict], None] | None = None, block: int | None = None) -> DataFrame:
    """Adds what is left of a budget before each row, if rows take their size from it in order and one that doesn't fit
    takes nothing. order tells rows apart. need: a column of what must fit, where that isn't what is taken; where an item
    needs more than it takes, a class may be watched for as many rounds more as it needs more. block: rows of a block.

    Only order, need and take are numbered and looked at; the result is joined to the rows at the end.
    """
    block = block or BLOCK
    whole = lambda c: F.greatest(F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(0)), F.lit(0))
    keys = [F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(order)]
    names = [f"__k{i}" for i in range(len(order))]
    narrow = df.select(*keys, whole(take).alias("take"), whole(need or take).alias("need"))
    d = with_position(narrow.withColumn("need", F.greatest("need", "take")), names, "pos").withColumn("block", F.floor(F.col("pos") / block))
    d = cut(d.withColumn("kind", size_class(F.col("need"))))
    items = d.where("take > 0").select("pos", "block", "need", "take", "kind")  # the others leave the budget as it is
    last = d.agg(F.max("block")).first()[0]
    if last is None or last < FEW:
        went = items.join(_one_by_one(items, budget).withColumn("__in", F.lit(True)), "pos").select("pos", "block", "take")
    else:
        went = items.where(_course(items, budget, block, on_round).takes()).select("pos", "block", "take")
    marked = d.select(*names, "pos", "block").join(went.select("pos", F.col("take").alias("__went")), "pos", "left")
    marked = cut(marked.withColumn("__went", F.coalesce("__went", F.lit(0))))
    sums = marked.groupBy("block").agg(F.sum("__went").alias("s"))
    sums = sums.select("block", (F.sum("s").over(Window.orderBy("block")) - F.col("s")).alias("before"))
    own = F.coalesce(F.sum("__went").over(Window.partitionBy("block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = marked.withColumn("__own", own).join(F.broadcast(sums), "block")  # a row a block
    out = out.select(*names, (F.lit(budget) - F.col("before") - F.col("__own")).cast("long").alias(name))
    return df.join(out, reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(n)) for c, n in zip(order, names, strict=True)])).drop(*names)
