"""Queries over stored events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import duration_seconds, severity_rank
from ..schema import COLUMNS, of_kind


def since_from_last(last: str | None, now: float) -> float | None:
    """The bound of a relative time: ``now`` less the duration, in whole milliseconds, not below 0."""
    if last is None:
        return None
    seconds = duration_seconds(last)
    if seconds is None:
        raise ValueError(f"not a duration: {last!r}")
    return max(0, int((now - seconds) * 1000)) / 1000


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def query_flows(events: DataFrame, since: float | None = None, host: str | None = None) -> DataFrame:
    """Flow rows from ``since`` on (inclusive) that have ``host`` at either end, in append order."""
    wanted = []
    if since is not None:
        wanted.append(F.col("ts") >= since)
    if host is not None:
        wanted.append((F.col("src") == host) | (F.col("dst") == host))
    return of_kind(events, "conn").where(_all(wanted)).orderBy("seq")


def query_alerts(events: DataFrame, since: float | None = None, name: str | None = None, min_severity: str | None = None) -> DataFrame:
    """Alerts from ``since`` on, of an exact name, of at least a severity, in append order."""
    wanted = []
    if since is not None:
        wanted.append(F.col("ts") >= since)
    if name is not None:
        wanted.append(F.col("name") == name)
    if min_severity is not None:
        wanted.append(severity_rank(F.col("severity")) >= severity_rank(F.lit(min_severity)))
    return of_kind(events, "alert").where(_all(wanted)).orderBy("seq")


def newest(rows: DataFrame, most: int = 50) -> DataFrame:
    """The newest rows, equal times in append order."""
    return rows.orderBy(F.desc("ts"), "seq").limit(most)


def recent_flows(events: DataFrame, most: int = 50) -> DataFrame:
    return newest(of_kind(events, "conn"), most)


def recent_alerts(stored: DataFrame, from_file: DataFrame, most: int = 50) -> DataFrame:
    """The newest alerts of a folder and an alert file; at equal times the folder's come first."""
    own = of_kind(stored, "alert").withColumn("origin", F.lit(0)).unionByName(of_kind(from_file, "alert").withColumn("origin", F.lit(1)))
    return own.orderBy(F.desc("ts"), "origin", "seq").limit(most).drop("origin")


def latest_heartbeat(events: DataFrame) -> DataFrame:
    """The heartbeat that is last in append order, whatever its time."""
    own = F.struct(*[n for n, _, _ in COLUMNS["heartbeat"]])
    return of_kind(events, "heartbeat").agg(F.max_by(own, "seq").alias("h")).where("h is not null").select("h.*")


def count_events(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("n"))


def appended(*parts: DataFrame) -> DataFrame:
    """Streams of events one after the other; each part's ``seq`` lies after those before it."""
    out = None
    for i, part in enumerate(parts):
        own = part.withColumn("seq", F.col("seq") + F.lit(i << 48))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def import_events(events: DataFrame, path: str) -> None:
    """Stores events as a Parquet table with a folder a kind, in one commit."""
    events.write.partitionBy("event").mode("append").parquet(path)
