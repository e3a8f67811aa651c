"""Ordered groups as slots of time: a summary a slot, merged in order.

What a group says of its rows in order (gaps between neighbours, the first few) is a summary that
can be put together from those of consecutive stretches. So a group is cut in slots of an hour, a
task's work is a slot, and only summaries, a row a slot, are ordered within the whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SLOT = 3_600_000_000


def slotted(rows: DataFrame) -> DataFrame:
    """``rows`` (with ts_us) with ``slot``."""
    return rows.withColumn("slot", F.col("ts_us") - F.pmod("ts_us", F.lit(SLOT)))


def in_slot(key: list[str]) -> WindowSpec:
    """The rows of a group and slot in order."""
    return Window.partitionBy(*key, "slot").orderBy("ts_us", "seq")


def slot_firsts(most: int) -> Column:
    """The first rows of a slot, by their place ``i``, as an aggregate."""
    return F.collect_list(F.when(F.col("i") <= most, F.struct("ts_us", "seq", "uid")))


def rows_before(key: list[str]) -> Column:
    """How many rows (``n`` a slot) a group has before a slot."""
    return F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def merged_firsts(most: int) -> Column:
    """The uids of a group's first rows, of its slots' ``firsts``, as an aggregate: slots beyond the first rows add nothing."""
    own = F.flatten(F.collect_list(F.when(F.col("before") < most, F.col("firsts"))))
    return F.transform(F.slice(F.array_sort(own), 1, most), lambda x: x["uid"])
