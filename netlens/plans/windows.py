"""Densest windows: for each group, the time window with most rows or most distinct keys.

A window starts at a row and holds all later rows up to ``width`` microseconds after it, the
bound included. The window with the highest count wins, the earliest start among equals.

A group is cut in time slots of one width. Windows that start in a slot end in it or the next,
so a row goes to its own slot and the one before, and a hot group is spread over its slots
instead of being one task. Within a slot no window is counted anew: a row counts for all starts
from ``width`` before it, and after the row before it that has its key, up to itself. So the count
at a start is a running sum of the beginnings and ends of these stretches: one sort and one pass.
What an alert says of its window is looked up for the best window of each group only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def densest(rows: DataFrame, group: list[str], width: int, distinct: str | None = None, last: dict[str, Column] | None = None, evidence: int = 10, at_least: int = 1) -> DataFrame:
    """One row a group with ``n``, ``start_us``, ``end_us``, the ``last`` columns of the window's last row and ``evidence``.

    ``rows`` needs ts_us, seq (unique) and uid. ``distinct``: the column whose distinct values
    count; else rows count. Groups whose whole count is below ``at_least`` are left out first:
    no window can have more than its group.
    """
    last = last or {}
    count = F.count_distinct(F.col(distinct)) if distinct else F.count("*")
    if at_least > 1:
        enough = rows.groupBy(*group).agg(count.alias("__c")).where(F.col("__c") >= at_least).select(*group)
        rows = rows.join(enough, group, "left_semi")
    ts, slot, key = F.col("ts_us"), F.col("__slot"), [*group, "__slot"]
    base = ts - F.pmod(ts, F.lit(width))
    placed = rows.select(*group, "ts_us", "seq", (F.col(distinct) if distinct else F.lit(1)).alias("__key"), F.explode(F.array(base, base - width)).alias("__slot")).repartition(*key)
    same = F.lag("ts_us").over(Window.partitionBy(*key, "__key").orderBy("ts_us", "seq")) if distinct else F.lit(None).cast("long")
    own, counts = base == slot, F.col("__key").isNotNull()
    mark = lambda at, d, seq=None: F.struct(at.alias("at"), F.lit(d).alias("d"), (F.lit(None).cast("long") if seq is None else seq.cast("long")).alias("seq"))
    marks = F.array(F.when(counts, mark(F.greatest(slot, ts - width, F.col("__same") + 1), 1)), F.when(own & counts, mark(ts + 1, -1)), F.when(own, mark(ts, 0, F.col("seq"))))
    steps = placed.withColumn("__same", same).select(*key, F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("m")).select(*key, "m.*")
    n = F.sum("d").over(Window.partitionBy(*key).orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    starts = steps.withColumn("n", n).where(F.col("seq").isNotNull() & (F.col("n") >= at_least))
    best = starts.groupBy(*group).agg(F.min(F.struct((-F.col("n")).alias("m"), "at", "seq")).alias("b")).select(*group, (-F.col("b.m")).alias("n"), F.col("b.at").alias("start_us"))
    inside = rows.join(best, group).where(F.col("ts_us").between(F.col("start_us"), F.col("start_us") + width))
    inside = inside.withColumn("__i", F.row_number().over(Window.partitionBy(*group).orderBy("ts_us", "seq")))
    tail = F.max_by(F.struct(F.col("ts_us").alias("end_us"), *[c.alias(k) for k, c in last.items()]), F.struct("ts_us", "seq"))
    told = inside.groupBy(*group).agg(F.first("n").alias("n"), F.first("start_us").alias("start_us"), tail.alias("t"), first_uids(F.col("__i"), most=evidence).alias("evidence"))
    return told.select(*group, "n", "start_us", "t.*", "evidence")


def first_uids(order: Column, uid: str = "uid", most: int = 10) -> Column:
    """The first uids of a group by a 1-based place, as an aggregate."""
    own = F.collect_list(F.when(order <= most, F.struct(order.alias("i"), F.col(uid).alias("uid"))))
    return F.transform(F.array_sort(own), lambda x: x["uid"])
