"""Live detection over micro-batches.

``LiveDetector`` keeps the sliding window and the last alert times as tables in a state
folder; each tick reads them, runs all rules over the window and writes the next state, so a
lost executor or a restarted driver goes on from the last whole tick. ``live_query`` drives it
from a stream with ``foreachBatch``: a batch is one step, committed by one manifest row that
names the batch, so a batch that is given again (its commit was lost) changes nothing and
returns the alerts that it gave. ``keyed_cooldown`` is the state of one rule key as a
``transformWithStateInPandas`` operator, which scales with keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.detections import RuleEngine, timed
from ..plans.folds import cooldown

WINDOW_ROWS = 10_000
KEPT = 8  # versions of state tables, so that alerts just returned can still be read
_MANIFEST = "version long, rows string, fired string, next_uid long, batch long, alerts string"


def slid(rows: DataFrame, window: float, most: int = WINDOW_ROWS) -> DataFrame:
    """What a deque of ``rows`` (by seq) keeps that is only emptied from its front.

    After each push the front goes while it is more than ``window`` older than the row just
    pushed, or more than ``most`` rows are held. One sequence by definition; it is streamed, and
    what a task holds is the window.
    """
    width = round(window * 1e6)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            old = held.num_rows if held is not None else 0
            held = new if held is None else pa.concat_tables([held, new])
            times = held.column("ts_us").to_numpy()
            front = 0
            for i in range(old, len(times)):
                while front < i and (times[i] - times[front] > width or i - front + 1 > most):
                    front += 1
            held = held.slice(front)
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return rows.coalesce(1).sortWithinPartitions("seq").mapInArrow(kept, rows.schema)


def forget(spark: SparkSession, state: str, below: int, needed: tuple) -> None:
    """Deletes the tables of versions before ``below`` that are not among the needed paths."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(state).getFileSystem(spark._jsc.hadoopConfiguration())
    held = {str(p).rsplit("/", 1)[-1] for p in needed}
    for status in fs.listStatus(fs_path(state)):
        name = status.getPath().getName()
        version = name.rsplit("-", 1)[-1]
        if version.isdigit() and int(version) < below and name not in held:
            fs.delete(status.getPath(), True)


class LiveDetector:
    """A sliding window of events, rules at ticks, and a cooldown for each (name, src)."""

    def __init__(self, spark: SparkSession, state: str, window: float = 600.0, gap: float = 300.0, engine: RuleEngine | None = None, most: int = WINDOW_ROWS):
        self.spark, self.state, self.window, self.gap, self.most = spark, state.rstrip("/"), window, gap, most
        self.engine = engine or RuleEngine()
        self.version = 0
        self._rows: str | None = None
        self._fired: str | None = None
        self.batch: int | None = None  # the last batch that was taken, and where its alerts are
        self._alerts: str | None = None
        self._resume()

    def _resume(self) -> None:
        """Goes on from the last manifest in the state folder, if there is one."""
        try:
            told = self.spark.read.schema(_MANIFEST).json(f"{self.state}/manifest").orderBy(F.desc("version")).first()
        except AnalysisException:  # no folder yet
            told = None
        if told:
            self.go_to(*told)

    def place(self) -> tuple:
        """What a restart needs: version, tables, next alert number, last batch and its alerts."""
        return self.version, self._rows, self._fired, self.engine.next, self.batch, self._alerts

    def go_to(self, version: int, rows: str | None, fired: str | None, next_uid: int, batch: int | None = None, alerts: str | None = None) -> None:
        """Goes on from an earlier ``place``."""
        self.version, self._rows, self._fired, self.engine.next, self.batch, self._alerts = version, rows, fired, next_uid, batch, alerts

    def _told(self) -> None:
        """Writes the place as the last step of a push, tick or batch: one row, so a lost one leaves the one before."""
        self.spark.createDataFrame([self.place()], _MANIFEST).coalesce(1).write.mode("append").json(f"{self.state}/manifest")
        forget(self.spark, self.state, self.version - KEPT, (self._rows, self._fired, self._alerts))

    def _saved(self, df: DataFrame, name: str) -> str:
        path = f"{self.state}/{name}-{self.version:08d}"
        df.write.mode("overwrite").parquet(path)
        return path

    def step(self, events: DataFrame, now: float, batch: int) -> DataFrame:
        """A push and a tick as one commit. A batch up to the last one is not taken again: the last one's alerts come back, of older ones none."""
        if self.batch is not None and batch <= self.batch:
            last = self.spark.read.parquet(self._alerts)
            return last.where(F.lit(batch == self.batch)).orderBy("no").drop("no")
        before = self.place()
        try:
            self.push(events, commit=False)
            out = self.tick(now, commit=False)
            self.batch = batch
            self._told()
        except BaseException:
            self.go_to(*before)
            raise
        return out

    def push(self, events: DataFrame, commit: bool = True) -> None:
        """Adds a batch of events (alerts are not fed back). Without ``commit`` a restart forgets it."""
        rows = timed(events).where(F.col("event") != "alert")
        if self._rows:
            rows = self.spark.read.parquet(self._rows).unionByName(rows)
        self.version += 1
        self._rows = self._saved(slid(rows, self.window, self.most), "window")
        if commit:
            self._told()

    def tick(self, now: float, numbers: bool = False, commit: bool = True) -> DataFrame:
        """The alerts of the window that are not cooling down at time ``now`` (with ``no`` if numbers are asked for)."""
        if not self._rows:
            raise ValueError("push events first")
        held = self.engine.run(self.spark.read.parquet(self._rows))
        alerts = held.withColumn("ts_us", F.lit(round(now * 1e6)))
        gap = round(self.gap * 1e6)
        fresh = alerts
        if self._fired:
            fired = self.spark.read.parquet(self._fired)
            hot = fired.where(F.lit(round(now * 1e6)) - F.col("last_us") < gap)
            fresh = alerts.join(hot, ["name", "src"], "left_anti")
        self.version += 1
        self._alerts = self._saved(cooldown(fresh, gap, order="no").drop("ts_us"), "alerts")
        out = self.spark.read.parquet(self._alerts)
        held.unpersist()
        now_fired = out.select("name", "src").distinct().withColumn("last_us", F.lit(round(now * 1e6)))
        if self._fired:
            # entries go after ten gaps
            old = self.spark.read.parquet(self._fired).where(F.lit(round(now * 1e6)) - F.col("last_us") < 10 * gap)
            now_fired = old.join(now_fired, ["name", "src"], "left_anti").unionByName(now_fired.select(*old.columns))
        self._fired = self._saved(now_fired, "fired")
        if commit:
            self._told()
        return out.orderBy("no") if numbers else out.orderBy("no").drop("no")


def live_query(stream: DataFrame, detector: LiveDetector, emit, checkpoint: str, interval: str | None = None):
    """Runs the detector on a stream: each micro-batch is a step at its latest event time."""

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        now = rows.agg(F.max("ts")).first()[0]
        if now is not None:
            emit(detector.step(rows, now, batch_id), batch_id)
        rows.unpersist()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


class _Cooldown(StatefulProcessor):
    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        last = self.last.get()[0] if self.last.exists() else None
        for part in rows:
            part = part.sort_values("ts_us", kind="stable")
            keep = np.zeros(len(part), bool)
            for i, t in enumerate(part["ts_us"].tolist()):
                if last is None or t - last >= self.gap:
                    keep[i], last = True, t
            if keep.any():
                yield part[keep]
        if last is not None:
            self.last.update((last,))

    def close(self) -> None:
        pass


def keyed_cooldown(alerts: DataFrame, gap: float) -> DataFrame:
    """A stream of alerts (name, src, ts_us, ...) without those that are cooling down. Needs the RocksDB state store."""
    return alerts.groupBy("name", "src").transformWithStateInPandas(_Cooldown(round(gap * 1e6)), alerts.schema, "Append", "None")
