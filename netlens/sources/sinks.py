"""Writing events and alerts as JSON lines, and which old files may go."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.chains import byte_cuts, in_order
from ..schema import as_envelope, to_json


def _files(spark: SparkSession, path: str):
    """The file system of a folder, its path class and the states of its files (driver-side, a row a file)."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs_path, list(fs.listStatus(fs_path(path))) if fs.exists(fs_path(path)) else []


def write_events(events: DataFrame, path: str, max_bytes: int = 64 << 20, prefix: str | None = None) -> list[str]:
    """Events in order of ``seq`` as ``*.ndjson`` files of at most so many bytes; the names of the files.

    A file takes lines in order as long as they fit; a longer line is a file of its own. Names ascend
    with the order: the prefix (by default the time of the write, in ms) and where the file begins,
    in bytes. Files of a given ``prefix`` are replaced. All is written to a staging folder of this
    write, which readers don't see, and then moved: what a lost write left is never taken for its
    successor's, and a write with a prefix can be done again.
    """
    spark = events.sparkSession
    prefix = prefix or f"part-{time.time_ns() // 1_000_000:013d}-{uuid.uuid4().hex[:8]}"
    staging = f"{path}/_staging-{prefix}"
    lines = to_json(events).select("seq", "value").withColumn("size", F.octet_length("value") + 1)
    cut = byte_cuts(in_order(lines, "seq"), "size", max_bytes)
    placed = cut.select("value", "seq", F.col("state").alias("begin"))
    # a file is one task's; it holds the lines of one file at a time. The sorted column itself names the
    # folders, as a number: for any expression of it, or a text, the writer sorts by folder alone and drops this sort
    placed.repartition("begin").sortWithinPartitions("begin", "seq").select("value", "begin").write.mode("overwrite").partitionBy("begin").text(staging)
    fs, fs_path, old = _files(spark, path)
    for status in old:
        if status.getPath().getName().startswith(f"{prefix}-"):
            fs.delete(status.getPath(), False)
    names = []
    for folder in fs.listStatus(fs_path(staging)):
        begin = folder.getPath().getName().partition("begin=")[2]
        for status in fs.listStatus(folder.getPath()) if begin else []:
            names.append(f"{prefix}-{begin:0>18}.ndjson")
            fs.rename(status.getPath(), fs_path(f"{path}/{names[-1]}"))
    fs.delete(fs_path(staging), True)
    return sorted(names)


def drop_files(spark: SparkSession, path: str, which) -> list[str]:
    """Deletes the files of a folder whose names ``which`` says yes to; their names."""
    fs, _, states = _files(spark, path)
    gone = [s for s in states if s.isFile() and which(s.getPath().getName())]
    for status in gone:
        fs.delete(status.getPath(), False)
    return [s.getPath().getName() for s in gone]


def sweep(spark: SparkSession, path: str, prefix: str, now: float, max_age: float | None = None, max_bytes: int | None = None) -> int:
    """Deletes what ``retention_victims`` names, the newest file excepted; returns how many."""
    fs, _, states = _files(spark, path)
    own = {s.getPath().getName(): s for s in states if s.getPath().getName().startswith(prefix) and s.getPath().getName().endswith(".ndjson")}
    if not own or (max_age is None and max_bytes is None):
        return 0
    files = spark.createDataFrame([(n, s.getModificationTime() / 1000, s.getLen()) for n, s in own.items()], "name string, modified double, size long")
    victims = [r.name for r in retention_victims(files, prefix, now, max_age, max_bytes, max(own)).collect()]
    for name in victims:
        fs.delete(own[name].getPath(), False)
    return len(victims)


def write_alerts(alerts: DataFrame, path: str) -> None:
    """Alerts as tagged JSON lines in the order of their numbers; replaces what was there."""
    rows = as_envelope(alerts.withColumn("seq", F.col("no").cast("long")), "alert")
    to_json(rows.coalesce(1).sortWithinPartitions("seq")).select("value").write.mode("overwrite").text(path)


def retention_victims(files: DataFrame, prefix: str, now: float, max_age: float | None = None, max_bytes: int | None = None, current: str | None = None) -> DataFrame:
    """The files (name, modified, size) to delete: too old, then oldest by name until the rest fits.

    Only ``prefix*.ndjson`` counts, and never the current file.
    """
    own = files.where(F.col("name").startswith(prefix) & F.col("name").endswith(".ndjson"))
    old = F.lit(False) if max_age is None else F.lit(now) - F.col("modified") > max_age
    free = F.lit(True) if current is None else F.col("name") != current
    own = own.withColumn("old", old & free)
    after = Window.orderBy(F.desc("name")).rowsBetween(Window.unboundedPreceding, 0)  # one row a file
    kept = own.where("not old").withColumn("held", F.sum("size").over(after))
    over = F.lit(False) if max_bytes is None else F.col("held") > max_bytes
    return own.where("old").select("name", "modified", "size").union(kept.where(over & free).select("name", "modified", "size"))
