"""The event model: seven kinds of events in one sparse envelope.

Column order is that of the written records. ``REQUIRED`` lists, for each kind, what an
event must have; all else is nullable. Ports, ids, query types and status codes are 16 bits
wide, the DNS response code 8.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {
    "conn": "uid string, ts double, duration double, proto string, conn_state string, end_reason string, src string, dst string, src_port int?, dst_port int?, pkts_a_to_b long, bytes_a_to_b long, pkts_b_to_a long, bytes_b_to_a long",
    "dns": "uid string, ts double, src string, dst string, src_port int, dst_port int, txid int, is_response boolean, rcode int, query string?, qtype int?, answers array<string>",
    "ssl": "uid string, ts double, src string, dst string, src_port int, dst_port int, version string?, sni string?, truncated boolean",
    "http": "uid string, ts double, src string, dst string, src_port int, dst_port int, kind string, method string?, uri string?, host string?, user_agent string?, status int?",
    "arp": "uid string, ts double, src string, sender_mac string, target_ip string, target_mac string?, op string, is_gratuitous boolean",
    "alert": "uid string, ts double, name string, severity string, src string, dst string?, message string, evidence array<string>",
    "heartbeat": "ts double, total_frames long, bytes long, active_flows long, events_emitted long",
}
_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType(), "array<string>": T.ArrayType(T.StringType())}

#: kind -> [(column, type, required)]
COLUMNS = {k: [(n, t.rstrip("?"), not t.endswith("?")) for n, t in (f.split(" ") for f in text.split(", "))] for k, text in _KINDS.items()}
REQUIRED = {k: [n for n, _, needed in fields if needed] for k, fields in COLUMNS.items()}
U16 = ("src_port", "dst_port", "txid", "qtype", "status")
SEVERITIES = ("low", "medium", "high")


def struct_of(kind: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t], not needed) for n, t, needed in COLUMNS[kind]])


def envelope() -> T.StructType:
    """The union of all kinds' columns; every column is nullable."""
    fields: dict[str, str] = {"event": "string"}
    for columns in COLUMNS.values():
        for n, t, _ in columns:
            fields.setdefault(n, t)
    return T.StructType([T.StructField(n, _TYPES[t], True) for n, t in fields.items()])


def of_kind(events: DataFrame, kind: str) -> DataFrame:
    """The typed projection of one kind, with the order column where there is one."""
    extra = [c for c in ("seq",) if c in events.columns]
    return events.where(F.col("event") == kind).select(*extra, *[n for n, _, _ in COLUMNS[kind]])


def as_envelope(df: DataFrame, kind: str) -> DataFrame:
    """Rows of one kind as envelope rows; columns of other kinds are null."""
    have = set(df.columns)
    columns = [F.lit(kind).alias("event")]
    for f in envelope().fields[1:]:
        columns.append(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*[c for c in ("seq",) if c in have], *columns)


def micros(ts: Column) -> Column:
    """Event seconds as whole microseconds: exact, as events have millisecond times."""
    return F.round(ts * 1_000_000).cast("long")


def to_json(events: DataFrame) -> DataFrame:
    """One tagged JSON text a row, with nulls of its own kind written out."""
    out = F.lit(None).cast("string")
    for kind, fields in COLUMNS.items():
        own = F.struct("event", *[n for n, _, _ in fields if n in events.columns])
        out = F.when(F.col("event") == kind, F.to_json(own, {"ignoreNullFields": "false"})).otherwise(out)
    return events.select(*[c for c in ("seq",) if c in events.columns], out.alias("value"))
