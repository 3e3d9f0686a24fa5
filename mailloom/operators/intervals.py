"""Overlapping pairs of intervals from two tables, without a nested loop.

An interval's class is the power of four that its length does not exceed (powers of two would post it to twice as many cells). A pair meets at the class of the longer of the
two: in cells of that width either touches two at most. So every interval is posted to its own class and
to those longer classes that the other table has, and the join is by equality of (keys, class, cell). A
pair counts only at the right class and in the cell where the later of the two begins: once.

A crowded cell is split: the rows of one side are dealt to so many parts and the other side's are copied to each.
Intervals are half open; those with null keys or ends, or that are empty, overlap nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CROWDED = 4096
"""Rows of one side that meet a cell's other rows in one task."""


def _class(length: Column) -> Column:
    """The least even c with length <= 2^c, in whole numbers; 63 at most."""
    c = F.length(F.bin(length - 1)) - F.when(length == 1, 1).otherwise(0)
    return F.least(c + c % 2, F.lit(63))


def _posted(df: DataFrame, keys: list[str], side: str, start: str, end: str) -> DataFrame:
    a, b = F.col(start).cast("long"), F.col(end).cast("long")
    rows = df.withColumns({f"__{side}a": a, f"__{side}b": b}).filter(F.col(f"__{side}a") < F.col(f"__{side}b"))
    for k in keys:
        rows = rows.filter(F.col(k).isNotNull())
    return rows.withColumn(f"__{side}c", _class(F.col(f"__{side}b") - F.col(f"__{side}a")))


def _cells(rows: DataFrame, side: str, classes: list[int]) -> DataFrame:
    """A row for each cell that an interval touches at its own class and at the other side's longer ones."""
    more = F.array(*(F.lit(x) for x in classes)) if classes else F.array().cast("array<int>")
    at = rows.withColumn("__class", F.explode(F.array_union(F.array(F.col(f"__{side}c")), F.filter(more, lambda x: x > F.col(f"__{side}c")))))
    whole = lambda x: F.expr(f"shiftright({x}, __class)")  # exact, below zero as well
    low, high = whole(f"__{side}a"), whole(f"(__{side}b - 1)")
    return at.withColumn("__cell", F.explode(F.sequence(low, high)))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], start: str = "start", end: str = "end", right_start: str | None = None, right_end: str | None = None, crowded: int = CROWDED) -> DataFrame:
    """All columns of both sides for each pair that agrees in the keys and overlaps; other columns of the two sides have different names."""
    l, r = _posted(left, keys, "l", start, end), _posted(right, keys, "r", right_start or start, right_end or end)  # noqa: E741
    if clash := ({*l.columns} & {*r.columns}) - {*keys}:
        raise ValueError(f"both sides have {sorted(clash)}")
    classes = lambda rows, side: sorted(x[0] for x in rows.select(f"__{side}c").distinct().collect())  # 64 at most
    lc, rc = classes(l, "l"), classes(r, "r")
    lp, rp = _cells(l, "l", rc), _cells(r, "r", lc)
    on = [*keys, "__class", "__cell"]
    parts = lp.groupBy(*on).agg(F.count("*").alias("n")).filter(F.col("n") > crowded).select(*on, F.ceil(F.col("n") / crowded).alias("__parts"))
    of = F.coalesce("__parts", F.lit(1).cast("long"))
    lp = lp.join(parts, on, "left").withColumn("__part", F.pmod(F.xxhash64("__la", "__lb", F.monotonically_increasing_id()), of)).drop("__parts")
    rp = rp.join(parts, on, "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), of - 1))).drop("__parts")
    later = F.greatest("__la", "__ra")
    once = (F.greatest("__lc", "__rc") == F.col("__class")) & (later < F.least("__lb", "__rb")) & (F.expr("shiftright(greatest(__la, __ra), __class)") == F.col("__cell"))
    return lp.join(rp, [*on, "__part"]).filter(once).drop("__class", "__cell", "__part", *(f"__{s}{x}" for s in "lr" for x in "abc"))
