"""Text views of query results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.scalars import endpoint

# Headers and line formats of the views, here and in the functions below.
FLOWS = "ts            proto state  reason  src -> dst                                  a->b         b->a         dur"
ALERTS = "ts            severity  name            src -> dst            message"


@F.udf(T.StringType())
def plain_number(x: float) -> str | None:
    """A double without exponent: 1770000000.5, 1770000001."""
    return None if x is None else str(int(x)) if float(x).is_integer() else repr(float(x))


def flow_lines(flows: DataFrame) -> DataFrame:
    """A line of text a flow, below the header FLOWS."""
    columns: list[Column] = [
        plain_number("ts"), F.col("proto"), F.col("conn_state"), F.col("end_reason"), endpoint(F.col("src"), F.col("src_port")), endpoint(F.col("dst"), F.col("dst_port")),
        F.col("pkts_a_to_b"), F.col("bytes_a_to_b"), F.col("pkts_b_to_a"), F.col("bytes_b_to_a"), F.col("duration"),
    ]
    return flows.select(*[c for c in ("seq",) if c in flows.columns], F.format_string("%-12s %-6s %-6s %-7s %s -> %s  %5dp/%6dB %5dp/%6dB %.3fs", *columns).alias("line"))


def alert_lines(alerts: DataFrame) -> DataFrame:
    """A line of text an alert, below the header ALERTS."""
    line = F.format_string("%-12s %-8s %-14s %s -> %s  %s", plain_number("ts"), F.col("severity"), F.col("name"), F.col("src"), F.coalesce("dst", F.lit("-")), F.col("message"))
    return alerts.select(*[c for c in ("seq",) if c in alerts.columns], line.alias("line"))


def heartbeat_line(beat: DataFrame) -> DataFrame:
    return beat.select(F.format_string("heartbeat ts=%s frames=%d bytes=%d active_flows=%d events=%d", plain_number("ts"), F.col("total_frames"), F.col("bytes"), F.col("active_flows"), F.col("events_emitted")).alias("line"))


def table_text(lines: DataFrame, header: str, most: int | None = None) -> str:
    """Header and all lines as one text, fetched a partition at a time; with ``most`` the first ones, and how many are left out."""
    ordered = lines.orderBy(*[c for c in ("seq",) if c in lines.columns] or ["line"])
    if most is None:
        return "\n".join([header, *(r.line for r in ordered.toLocalIterator())])
    left = max(lines.count() - most, 0)
    return "\n".join([header, *(r.line for r in ordered.limit(most).collect()), *[f"... {left} more"] * (left > 0)])
