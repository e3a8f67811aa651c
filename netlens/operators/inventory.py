"""Devices by MAC address, and alerts at most once in a gap."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.folds import greedy_gaps
from ..schema import micros


def inventory(events: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Per MAC first_seen, last_seen and last_ip, first and last in arrival order.

    ``known``: an earlier inventory, whose devices keep their first_seen.
    """
    now = events.where(F.col("event") == "arp").groupBy("sender_mac").agg(
        F.min_by("ts", "seq").alias("first_seen"), F.max_by("ts", "seq").alias("last_seen"), F.max_by("src", "seq").alias("last_ip")
    )
    if known is None:
        return now
    old = known.select("sender_mac", F.col("first_seen").alias("f"), F.col("last_seen").alias("l"), F.col("last_ip").alias("ip"))
    return now.join(old, "sender_mac", "full_outer").select(
        "sender_mac", F.coalesce("f", "first_seen").alias("first_seen"), F.coalesce("last_seen", "l").alias("last_seen"), F.coalesce("last_ip", "ip").alias("last_ip")
    )


_DEVICES = "sender_mac string, first_seen double, last_seen double, last_ip string"


def save_inventory(devices: DataFrame, path: str) -> None:
    """Writes the devices beside ``path``, then puts them in its place, so that a lost job leaves the old ones."""
    spark = devices.sparkSession
    devices.write.mode("overwrite").json(f"{path}.tmp")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(fs_path(path), True)
    fs.rename(fs_path(f"{path}.tmp"), fs_path(path))


def load_inventory(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    """The saved devices; none if nothing was saved, none and the error if they cannot be read."""
    none = spark.createDataFrame([], _DEVICES)
    try:
        devices = spark.read.schema(_DEVICES).option("mode", "FAILFAST").json(path)
        devices.write.format("noop").mode("overwrite").save()
    except AnalysisException:  # no such folder
        return none, None
    except (PySparkException, Py4JJavaError) as e:  # a failed write comes as the latter
        return none, f"{path}: {str(e).splitlines()[0]}"
    return devices, None


def new_devices(events: DataFrame, gap: float = 60.0, known: DataFrame | None = None, last_alert: float | None = None) -> DataFrame:
    """An alert for each MAC's first claim, unless one came less than ``gap`` before; all are learned."""
    first = events.where(F.col("event") == "arp").groupBy("sender_mac").agg(F.min_by(F.struct("seq", "ts", "src", "uid"), "seq").alias("f")).select("sender_mac", "f.*")
    if known is not None:
        first = first.join(known.select("sender_mac"), "sender_mac", "left_anti")
    start = None if last_alert is None else round(last_alert * 1e6)
    kept = greedy_gaps(first.withColumn("ts_us", micros(F.col("ts"))), [], "ts_us", int(gap * 1e6), order="seq", start=start)
    text = F.concat(F.lit("first time seeing "), F.col("sender_mac"), F.lit(" claiming "), F.col("src"))
    return kept.select(
        F.lit("").alias("uid"), "ts", F.lit("new-device").alias("name"), F.lit("medium").alias("severity"), "src", F.lit(None).cast("string").alias("dst"), text.alias("message"), F.array("uid").alias("evidence"), "seq"
    )


def blind_alerts(beats: DataFrame, blind: float = 600.0, again: float = 1800.0) -> DataFrame:
    """Alerts for times without frames, from (ts, total_frames) snapshots.

    A snapshot fires when the last growth of total_frames lies ``blind`` seconds back or more,
    and no alert came in the ``again`` seconds before it.
    """
    order = Window.orderBy("ts")  # heartbeats of one sensor: one a tick
    grown = beats.withColumn("before", F.lag("total_frames").over(order)).withColumn("moved", F.when(F.col("before").isNull() | (F.col("total_frames") > F.col("before")), F.col("ts")))
    quiet = grown.withColumn("since", F.max("moved").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("ts") - F.col("since") >= blind)
    kept = greedy_gaps(quiet.withColumn("ts_us", micros(F.col("ts"))), [], "ts_us", int(again * 1e6), order="ts_us")
    seconds = (F.col("ts") - F.col("since")).cast("long")
    return kept.select(F.lit("").alias("uid"), "ts", F.lit("sensor-blind").alias("name"), F.lit("high").alias("severity"), F.lit("sensor").alias("src"), F.concat(F.lit("zero frames for "), seconds, F.lit("s")).alias("message"))
