"""A sensor's run: frames come in batches, and housekeeping follows each.

A tick does, in this order: events of the frames and of flows that end, a heartbeat, retention,
alerts, the inventory, the blind check. ``finish`` ends the open flows, looks for alerts once more,
saves the inventory and sweeps. Open flows, devices, counts and the detector's place are tables of
a state folder. A manifest row is the last step of a tick; it names the tick's micro-batch and its
event files. A restarted sensor deletes the files of a tick that has no row and repeats it with
the same numbers; a micro-batch that has a row is not taken again, its alerts come back as they were.

A stream without frames has no batches, so ``sensor_query`` takes a timer stream beside the
frames: its rows make batches, and ticks, of a silent sensor too.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import unix_seconds
from ..operators.detections import ALERT
from ..operators.flows import end_at, flow_events, frame_events, merged_flows, numbered, open_flows, routed
from ..operators.frames import layers
from ..operators.inventory import inventory, load_inventory, new_devices, save_inventory
from ..schema import as_envelope
from ..sources.capture import FRAMES
from ..sources.config import Config
from ..sources.sinks import drop_files, sweep, write_events
from .live import KEPT, LiveDetector, forget

_TOLD = """version long, batch long, frames long, bytes long, emitted long, last_frame double, blind_at double, device_at double, flows string, devices string, alerts string, files array<string>,
live struct<version:long,rows:string,fired:string,next_uid:long,batch:long,alerts:string>"""
_START = {"version": 0, "batch": None, "frames": 0, "bytes": 0, "emitted": 0, "last_frame": None, "blind_at": None, "device_at": None, "flows": None, "devices": None, "alerts": None, "files": [], "live": None}


class Sensor:
    """Frames in, event files out; ``tick`` and ``finish`` return the alerts they gave."""

    def __init__(self, spark: SparkSession, state: str, out: str, config: Config | None = None, detector: LiveDetector | None = None, max_bytes: int = 64 << 20, again: float = 1800.0):
        self.spark, self.state, self.out, self.config = spark, state.rstrip("/"), out, config or Config()
        self.max_bytes, self.again = max_bytes, again
        self.live = detector or LiveDetector(spark, f"{self.state}/live", self.config.window, self.config.gap)
        try:
            last = spark.read.schema(_TOLD).json(f"{self.state}/manifest").orderBy(F.desc("version")).first()
        except AnalysisException:  # no folder yet
            last = None
        self.told = last.asDict() if last else dict(_START)
        if last:
            self.live.go_to(*last.live)
        drop_files(spark, self.out, lambda name: self._version(name) > self.told["version"])

    def _version(self, name: str) -> int:
        """The tick that wrote a file, 0 for files of others."""
        own = name.removeprefix(f"{self.config.prefix}-") if name.startswith(f"{self.config.prefix}-") else ""
        return int(own[:8]) if own[:8].isdigit() else 0

    def _saved(self, df: DataFrame, name: str, version: int) -> tuple[DataFrame, str]:
        path = f"{self.state}/{name}-{version:08d}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path), path

    def _write(self, events: DataFrame, version: int, step: int) -> list[str]:
        return write_events(events, self.out, self.max_bytes, f"{self.config.prefix}-{version:08d}-{step}")

    def _blind(self, told: dict, now: float) -> DataFrame | None:
        quiet = now - told["last_frame"]
        if quiet < self.config.blind or (told["blind_at"] is not None and now - told["blind_at"] < self.again):
            return None
        told["blind_at"] = now
        row = [("", now, "sensor-blind", "high", "sensor", None, f"zero frames for {int(quiet)}s", [])]
        kinds = "uid string, ts double, name string, severity string, src string, dst string, message string, evidence array<string>"
        return self.spark.createDataFrame(row, kinds)

    def tick(self, frames: DataFrame, now: float, batch: int | None = None) -> DataFrame:
        """Takes the frames since the last tick (none: an empty table) and does the housekeeping of time ``now``.

        ``batch``: the number of the micro-batch; one up to the last that was taken is not taken again.
        """
        if batch is not None and self.told["batch"] is not None and batch <= self.told["batch"]:
            return self.spark.read.parquet(self.told["alerts"]).where(F.lit(batch == self.told["batch"])).orderBy("no").drop("no")
        return self._whole(frames, now, False, batch)

    def finish(self, now: float) -> DataFrame:
        """The end of input."""
        return self._whole(self.spark.createDataFrame([], FRAMES), now, True, None)

    def _whole(self, frames: DataFrame, now: float, last: bool, batch: int | None) -> DataFrame:
        before = self.live.place()
        try:
            return self._step(frames, now, last, batch)
        except BaseException:
            self.live.go_to(*before)
            raise

    def _step(self, frames: DataFrame, now: float, last: bool, batch: int | None) -> DataFrame:
        told, now = dict(self.told), float(now)
        told["version"] = version = told["version"] + 1
        told["batch"] = told["batch"] if batch is None else batch
        new = frames.withColumn("frame_no", F.col("frame_no") + F.lit(told["frames"]))
        count = new.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("wire_len").cast("long")), F.lit(0)).alias("size"), F.max(unix_seconds(F.col("ts"))).alias("at")).first()
        told |= {"frames": told["frames"] + count.n, "bytes": told["bytes"] + count.size}
        told["last_frame"] = max((t for t in (told["last_frame"], count.at) if t is not None), default=now)

        rows, _ = self._saved(routed(layers(new)), "rows", version)  # taken apart once for all that follows
        flows = open_flows(rows)
        if told["flows"]:
            flows = merged_flows(self.spark.read.parquet(told["flows"]).where("end_reason is null").select(*flows.columns), flows)
        end = F.lit("eof") if last else end_at(F.timestamp_micros(F.lit(round(now * 1e6))), self.config.idle, self.config.active)
        flows, told["flows"] = self._saved(flows.withColumn("end_reason", end), "flows", version)
        ended = flows.where("end_reason is not null")
        given, _ = self._saved(frame_events(rows).unionByName(flow_events(ended)), "given", version)
        events, _ = self._saved(numbered(given, told["emitted"]), "events", version)
        told["emitted"] += events.count()

        if not last:
            told["emitted"] += 1
            beat = [(told["emitted"], now, told["frames"], told["bytes"], flows.count() - ended.count(), told["emitted"])]
            beat = self.spark.createDataFrame(beat, "seq long, ts double, total_frames long, bytes long, active_flows long, events_emitted long")
            events = events.unionByName(as_envelope(beat, "heartbeat"))
        told["files"] = self._write(events, version, 1)
        if not last:
            self._sweep(now)

        known = load_inventory(self.spark, told["devices"])[0] if told["devices"] else None
        found = new_devices(events, known=known, last_alert=told["device_at"]).withColumn("no", F.struct(F.lit(0).alias("part"), F.col("seq")))
        self.live.push(events, commit=False)
        rules = self.live.tick(now, numbers=True, commit=False)
        rules = rules.withColumn("no", F.struct(F.lit(1).alias("part"), F.col("no").cast("long").alias("seq")))
        alerts = found.select(*ALERT, "uid", "no").unionByName(rules.select(*ALERT, "uid", "no"))

        blind = None if last else self._blind(told, now)
        if blind is not None:
            alerts = alerts.unionByName(blind.withColumn("no", F.struct(F.lit(2).alias("part"), F.lit(0).cast("long").alias("seq"))))
        told["devices"] = f"{self.state}/devices-{version:08d}"
        alerts, told["alerts"] = self._saved(alerts, "alerts", version)
        save_inventory(inventory(events, known), told["devices"])
        told["device_at"] = alerts.where("no.part = 0").agg(F.max_by("ts", "no")).first()[0] or told["device_at"]
        told["files"] = told["files"] + self._write(as_envelope(alerts.withColumn("seq", F.col("no")), "alert"), version, 2)
        if last:
            self._sweep(now)

        told["live"] = self.live.place()
        values = tuple(told[n] for n in _START)
        self.spark.createDataFrame([values], _TOLD).coalesce(1).write.mode("append").json(f"{self.state}/manifest")
        forget(self.spark, self.state, version - KEPT, (told["flows"], told["devices"], told["alerts"]))
        self.told = told
        return alerts.orderBy("no").drop("no")

    def _sweep(self, now: float) -> None:
        sweep(self.spark, self.out, self.config.prefix, now, self.config.max_age, self.config.max_bytes)


def clock(spark: SparkSession, every: int = 2) -> DataFrame:
    """A stream of the time, a row every so many seconds."""
    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().where(F.col("value") % every == 0).select(F.col("timestamp").alias("ts"))


def sensor_query(frames: DataFrame, sensor: Sensor, emit, checkpoint: str, interval: str | None = None, timer: DataFrame | None = None):
    """Runs the sensor on a stream of frames: each micro-batch is a tick at its latest time.

    ``timer``: a stream of times (``ts``), such as ``clock``; its rows tick as frames do. Call
    ``sensor.finish`` when a query over an ended input stops.
    """
    if timer is not None:
        frames = frames.unionByName(timer.select("ts"), allowMissingColumns=True)

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        now = rows.agg(F.max(unix_seconds(F.col("ts")))).first()[0]
        if now is not None:
            emit(sensor.tick(rows.where("frame_no is not null"), now, batch_id), batch_id)
        rows.unpersist()

    writer = frames.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
