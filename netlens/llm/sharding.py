"""Operator 6: rendezvous hashing of stable record keys over weighted shards.

Each key is scored against each shard and goes to the highest score, so one more shard only
takes rows into itself. Law: ``key``. The rows are written as one Parquet folder a shard.

Defined results: a null text has no bytes and crc32 0; a row with a null key is placed by its
text instead; repeated keys go to one shard, those with one text to neighbouring slots; input columns
named like an output give way; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import fewer, written

OUTPUTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def rendezvous(key: Column, shards: int, weights: list[float] | None = None) -> Column:
    """The shard with the highest ``-weight / ln(u)``; u in (0, 1) depends on key and shard only."""
    scores = []
    for s, w in enumerate(weights or [1.0] * shards):
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(s)), 11) + F.lit(0.5)) / F.lit(2.0**53)
        scores.append(F.struct((F.lit(-float(w)) / F.ln(u)).alias("score"), F.lit(-s).alias("no")))
    return -F.array_max(F.array(*scores))["no"]


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 40, weights: list[float] | None = None, rows_a_task: int = 20_000) -> DataFrame:
    """``df``, written shard by shard and read again, with size, crc32, shard and slot.

    A shard is dealt in cells of about ``rows_a_task`` rows, so that no task holds a whole
    shard; a row's slot is its place in the cell after the rows of the cells before it.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    at = F.when(F.col(f"`{key}`").isNull(), F.xxhash64(body)).otherwise(F.xxhash64(F.col(f"`{key}`")))
    rows = fewer(df, *OUTPUTS)
    cells = max(1, math.ceil(df.count() / (shards * rows_a_task)))
    keyed = rows.select("*", at.alias("__key"), F.crc32(body).alias("text_crc32"), (F.octet_length(body) + 16).cast("long").alias("size"))
    placed = keyed.select(
        "*",
        rendezvous(F.col("__key"), shards, weights).cast("int").alias("shard"),
        rendezvous(F.col("__key"), shards + 1, weights and [*weights, sum(weights) / len(weights)]).cast("int").alias("grown_shard"),
        F.pmod(F.xxhash64("__key", "text_crc32", F.lit("cell")), F.lit(cells)).cast("int").alias("__cell"),
    )
    in_cell = Window.partitionBy("shard", "__cell").orderBy(F.col(f"`{key}`").asc_nulls_first(), "text_crc32", "size")
    files = written(placed.withColumn("__place", F.row_number().over(in_cell) - 1), "shards", "shard")
    before = Window.partitionBy("shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = files.groupBy("shard", "__cell").agg(F.count("*").alias("__n"))
    starts = counts.select("shard", "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return files.join(starts, ["shard", "__cell"]).select(
        *rows.columns, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__start") + F.col("__place")).cast("long").alias("slot"), "grown_shard"
    )
