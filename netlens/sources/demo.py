"""A small demonstration stream: a healthy client, five attacks and a heartbeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..schema import envelope

# Times, addresses, counts and names of the stream, here and in _rows.
START = 1_770_000_000.0


def demo_watchlist() -> list[str]:
    return ["nasty.example", "evilsite.example"]


def _conn(ts: float, src: str, dst: str, ports: tuple, state: str, reason: str, duration: float, counts: tuple) -> dict:
    names = ("pkts_a_to_b", "bytes_a_to_b", "pkts_b_to_a", "bytes_b_to_a")
    return dict(event="conn", ts=ts, duration=duration, proto="tcp", conn_state=state, end_reason=reason, src=src, dst=dst, src_port=ports[0], dst_port=ports[1], **dict(zip(names, counts, strict=True)))


def _dns(ts: float, src: str, txid: int, query: str, qtype: int) -> dict:
    return dict(event="dns", ts=ts, src=src, dst="198.51.100.7", src_port=5353, dst_port=53, txid=txid, is_response=False, rcode=0, query=query, qtype=qtype, answers=[])


def _rows() -> list[dict]:
    client, attacker, target = "192.0.2.10", "192.0.2.66", "198.51.100.7"
    rows = []
    for i, at in enumerate((0, 7, 18, 26, 41, 55)):  # fixed values; no two steps are alike, so the beacon rule stays silent
        rows.append(_dns(START + at, client, 0x1000 + i, "example.com.", 1))
        rows.append(_conn(START + at + 1, client, target, (49152 + i, 80), "SF", "fin", 2.0, (10, 1200, 8, 64000)))
    rows += [_conn(START + 100 + i, attacker, target, (40000 + i, 1000 + i), "S0", "rst", 0.5, (1, 60, 1, 60)) for i in range(15)]
    rows += [_conn(START + 200 + 60 * i, attacker, "198.51.100.99", (41000 + i, 443), "SF", "fin", 1.0, (4, 320, 4, 280)) for i in range(5)]
    rows += [_dns(START + 300 + i, "192.0.2.20", 0x2000 + i, "a" * 60 + ".tunnel.example.", 16) for i in range(2)]
    rows += [dict(event="arp", ts=START + 400 + i, src="10.0.0.5", sender_mac=f"aa:aa:aa:aa:aa:0{1 + i % 2}", target_ip="10.0.0.1", op="reply", is_gratuitous=False) for i in range(4)]
    rows.append(dict(event="ssl", ts=START + 500, src=attacker, dst="198.51.100.9", src_port=4444, dst_port=443, version="TLSv1.2", sni="evilsite.example", truncated=False))
    for i, r in enumerate(rows, 1):
        r["uid"] = f"{r['event']}{i}"
    rows.append(dict(event="heartbeat", ts=START + 600, total_frames=4200, bytes=2_400_000, active_flows=3, events_emitted=len(rows) + 1))
    return rows


def demo_events(spark: SparkSession) -> DataFrame:
    """The stream as events with ``seq``."""
    fields = envelope().fields
    rows = [(i, *[r.get(f.name) for f in fields]) for i, r in enumerate(_rows(), 1)]
    return spark.createDataFrame(rows, T.StructType([T.StructField("seq", T.LongType()), *fields]))


def write_demo(spark: SparkSession, path: str) -> int:
    """Writes the stream as one record file below ``path``, and the watch list beside it."""
    from .sinks import write_events

    events = demo_events(spark)
    write_events(events, path)
    text = "# watched domains\n" + "".join(f"{d}\n" for d in demo_watchlist())
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/watchlist.txt")
    out = where.getFileSystem(conf).create(where, True)
    out.write(bytearray(text.encode()))
    out.close()
    return events.count()
