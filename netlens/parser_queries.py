"""Parsers, routing, ingestion and sensor views over the driver's tables, and the same in DuckDB SQL.

Frames and payloads are real bytes made of table rows; the SQL states what they say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import payloads
from .operators import inventory as I
from .operators import store as Q
from .operators.flows import Every, events_of_frames, flows_with_ticks, heartbeats, routed
from .operators.frames import layers
from .plans.chains import shared_folder
from .queries import _X, DAY, HOUR, E, _claims, _FLOW_COLUMNS, _flow_view, _stored, adapted, frames_of_lineitem, query, table
from .schema import as_envelope
from .sources.ndjson import read_alert_file, read_events
from .sources.sinks import write_events


def _keys() -> tuple[Column, Column]:
    return F.col("o_orderkey"), F.col("o_custkey")


def _h(value: Column, digits: int) -> Column:
    return F.lpad(F.hex(value.cast("long")), digits, "0")


def _orders(spark: SparkSession, sf_dir: str, data: Column) -> DataFrame:
    """A frame an order: ``data`` is its bytes as hex."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame_no"), F.timestamp_micros(F.col("o_orderkey").cast("long")).alias("ts"), F.lit(90).alias("wire_len"), F.unhex(data).alias("data"), "o_orderkey", "o_custkey")


@query("""SELECT o_orderkey AS frame_no, CASE WHEN p = 17 AND 53 IN (s, d) THEN 'dns' WHEN p = 6 AND 80 IN (s, d) THEN 'http' WHEN p = 6 AND 443 IN (s, d) THEN 'tls' END AS route
FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 17 WHEN 1 THEN 6 ELSE 1 END AS p, CASE o_custkey % 4 WHEN 0 THEN 53 WHEN 1 THEN 80 WHEN 2 THEN 443 ELSE 1000 END AS s, CASE o_orderkey % 5 WHEN 0 THEN 53 WHEN 1 THEN 80 WHEN 2 THEN 443 ELSE 2000 END AS d FROM orders)""")
def frame_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = _keys()
    port = lambda n, other: F.when(n == 0, 53).when(n == 1, 80).when(n == 2, 443).otherwise(other)
    rows = table(spark, sf_dir, "orders").select(key.alias("frame_no"), F.when(key % 3 == 0, 17).when(key % 3 == 1, 6).otherwise(1).alias("proto_no"), port(cust % 4, 1000).alias("src_port"), port(key % 5, 2000).alias("dst_port"), F.lit("x").alias("payload"))
    return routed(rows).select("frame_no", "route")


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 5 = 0 AS cut FROM orders)
SELECT k AS frame_no, CAST(k % 4096 AS INT) AS vlan, 34525 AS ethertype, CASE WHEN cut THEN NULL WHEN c % 65536 = 0 THEN '2001:db8::1' ELSE '2001:db8::' || lower(hex(c % 65536)) || ':1' END AS src, CASE WHEN NOT cut THEN 'fe80::' || lower(hex(k % 65535 + 1)) END AS dst,
 CASE WHEN NOT cut THEN CAST(c % 1000 + 1000 AS INT) END AS src_port, CASE WHEN NOT cut THEN CAST(k % 100 + 5000 AS INT) END AS dst_port, CASE WHEN NOT cut THEN 'udp' END AS proto, CASE WHEN NOT cut THEN lpad(hex(k % 65536), 4, '0') || lpad(hex(c % 65536), 4, '0') END AS payload, CASE WHEN NOT cut THEN TRUE END AS forward FROM o""")
def tagged_ipv6_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One or two tags, IPv6, UDP; every fifth frame is cut inside its IP header."""
    key, cust = _keys()
    tag = F.when(key % 4 == 0, F.concat(F.lit("88A8"), _h(key % 65536, 4), F.lit("81000009"))).otherwise(F.concat(F.lit("8100"), _h(key % 65536, 4)))
    ip = F.concat(F.lit("86DD60000000000C114020010DB80000000000000000"), _h(cust % 65536, 4), F.lit("0001FE80" + "0000" * 6), _h(key % 65535 + 1, 4))
    udp = F.concat(_h(cust % 1000 + 1000, 4), _h(key % 100 + 5000, 4), F.lit("000C0000"), _h(key % 65536, 4), _h(cust % 65536, 4))
    whole = F.concat(F.lit("020000000001020000000002"), tag, ip, udp)
    rows = layers(_orders(spark, sf_dir, F.when(key % 5 == 0, F.left(whole, F.lit(100))).otherwise(F.concat(whole, F.lit("0000")))))
    return rows.select("frame_no", "vlan", "ethertype", "src", "dst", "src_port", "dst_port", "proto", F.hex("payload").alias("payload"), "forward")


@query("""SELECT o_orderkey AS frame_no, CASE WHEN o_orderkey % 3 = 0 THEN 'request' ELSE 'reply' END AS op, '02:00:' || regexp_replace(lower(lpad(hex(o_orderkey), 8, '0')), '(..)(..)(..)(..)', '\\1:\\2:\\3:\\4') AS sender_mac,
 '10.0.' || o_custkey % 200 || '.' || o_custkey % 5 AS src, CASE WHEN o_orderkey % 7 = 0 THEN '10.0.' || o_custkey % 200 || '.' || o_custkey % 5 ELSE '10.1.0.9' END AS target_ip, o_orderkey % 7 = 0 AS is_gratuitous FROM orders WHERE o_orderkey % 3 < 2""")
def arp_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests, replies and an operation that is neither."""
    key, cust = _keys()
    mac, own = F.concat(F.lit("0200"), _h(key, 8)), F.concat(F.lit("0A00"), _h(cust % 200, 2), _h(cust % 5, 2))
    to = F.when(key % 7 == 0, own).otherwise(F.lit("0A010009"))
    data = F.concat(F.lit("FFFFFFFFFFFF"), mac, F.lit("08060001080006040"), F.lit("00"), (key % 3 + 1).cast("string"), mac, own, F.lit("000000000000"), to, F.lit("00" * 18))
    return layers(_orders(spark, sf_dir, data)).where("arp is not null").select("frame_no", "arp.op", "arp.sender_mac", "arp.src", "arp.target_ip", "arp.is_gratuitous")


@query("""SELECT o_orderkey AS frame_no, CAST(o_orderkey % 65536 AS INT) AS txid, o_orderkey % 2 = 1 AS is_response, CAST(CASE WHEN o_orderkey % 2 = 1 THEN 3 ELSE 0 END AS INT) AS rcode, 'host' || o_custkey || '.example.' AS query, CAST(CASE WHEN o_custkey % 2 = 0 THEN 16 ELSE 1 END AS INT) AS qtype,
 CASE WHEN o_orderkey % 2 = 1 THEN 'host' || o_custkey || '.example. 10.0.' || o_custkey % 200 || '.' || o_custkey % 5 ELSE '' END AS answers FROM orders WHERE o_orderkey % 5 <> 0""")
def dns_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with capitals, answers through a pointer; every fifth message is cut short."""
    key, cust = _keys()
    answer = key % 2 == 1
    name = F.concat(F.when(answer, "host").otherwise("HoSt"), cust.cast("string"))
    head = F.concat(_h(key % 65536, 4), F.when(answer, "8183").otherwise("0100"), F.lit("0001"), F.when(answer, "0001").otherwise("0000"), F.lit("00000000"))
    question = F.concat(_h(F.length(name), 2), F.hex(F.encode(name, "utf-8")), F.lit("07"), F.lit(b"example".hex()), F.lit("00"), F.when(cust % 2 == 0, "0010").otherwise("0001"), F.lit("0001"))
    rest = F.when(answer, F.concat(F.lit("C00C000100010000003C00040A00"), _h(cust % 200, 2), _h(cust % 5, 2))).otherwise("")
    data = F.concat(head, question, rest)
    rows = _orders(spark, sf_dir, F.when(key % 5 == 0, F.substring(data, F.lit(1), F.length(data) - 4)).otherwise(data))
    return rows.select("frame_no", payloads.dns("data").alias("p")).where("p.found").select("frame_no", "p.txid", "p.is_response", "p.rcode", "p.query", "p.qtype", F.array_join("p.answers", ",").alias("answers"))


@query("""SELECT page_id AS frame_no, CASE WHEN page_id % 3 = 0 THEN 'request' ELSE 'response' END AS kind, CASE WHEN page_id % 3 = 0 THEN 'GET' END AS method, CASE WHEN page_id % 3 = 0 THEN '/p/' || page_id END AS uri, CASE WHEN page_id % 3 = 0 THEN 'h' || page_id || '.example' END AS host,
 CASE WHEN page_id % 3 = 0 THEN repeat('a', 128) END AS user_agent, CAST(CASE WHEN page_id % 3 = 1 THEN 200 + page_id % 300 END AS INT) AS status FROM pages WHERE page_id % 3 < 2""")
def http_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with a long agent, responses, and headers that do not end."""
    no = F.col("page_id")
    ask = F.concat(F.lit("GET /p/"), no, F.lit(" HTTP/1.1\r\nAccept: */*\r\nhost:  h"), no, F.lit(".example \r\nUser-Agent: " + "a" * 200 + "\r\nHost: second\r\n\r\nbody"))
    reply = F.concat(F.lit("HTTP/1.1 "), (no % 300 + 200).cast("string"), F.lit(" OK\r\nServer: x\r\n\r\n"))
    data = F.when(no % 3 == 0, ask).when(no % 3 == 1, reply).otherwise(F.substring(ask, 1, 40))
    rows = table(spark, sf_dir, "pages").select(no.alias("frame_no"), payloads.http(F.encode(data, "utf-8")).alias("p"))
    return rows.where("p.found").select("frame_no", "p.kind", "p.method", "p.uri", "p.host", "p.user_agent", "p.status")


@query("""SELECT o_orderkey AS frame_no, '0x0303' AS version, CASE WHEN o_orderkey % 4 <> 0 THEN 'w' || o_orderkey || '.example' END AS sni, o_orderkey % 4 = 0 AS truncated FROM orders""")
def tls_hellos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ClientHellos with a server name; every fourth is cut inside the name."""
    key, cust = _keys()
    name = F.concat(F.lit("w"), key.cast("string"), F.lit(".example"))
    n = F.length(name)
    server = F.concat(F.lit("0000"), _h(n + 5, 4), _h(n + 3, 4), F.lit("00"), _h(n, 4), F.hex(F.encode(name, "utf-8")))
    data = F.concat(F.lit("160301"), _h(n + 56, 4), F.lit("01"), _h(n + 52, 6), F.lit("0303" + "11" * 32 + "00" + "00021301" + "0100"), _h(n + 9, 4), server)
    rows = _orders(spark, sf_dir, F.when(key % 4 == 0, F.substring(data, F.lit(1), F.length(data) - 6)).otherwise(data))
    return rows.select("frame_no", payloads.tls("data").alias("p")).where("p.found").select("frame_no", "p.version", "p.sni", "p.truncated")


@query(f"WITH {E} SELECT {_FLOW_COLUMNS} FROM e WHERE us >= 1706659200000000 - 10 * {DAY} AND (user_id = 3 OR k = 3)")
def flows_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flow_view(Q.query_flows(_stored(spark, sf_dir), since=Q.since_from_last("240h", now=1706659200.0), host="3"))


@query(f"""WITH {E}, k AS (SELECT DISTINCT user_id FROM e WHERE event_type = 'error' AND us < 1704412800000000), f AS (SELECT user_id, MIN(event_id) AS event_id FROM e WHERE user_id NOT IN (SELECT user_id FROM k) GROUP BY user_id)
SELECT e.us AS end_us, CAST(e.k AS VARCHAR) AS src, 'first time seeing ' || e.user_id || ' claiming ' || e.k AS message FROM f JOIN e USING (event_id)""")
def unknown_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every device that an earlier inventory (errors of the first days) does not know; no gap."""
    claims = _claims(spark, sf_dir)
    known = I.inventory(claims.where((F.col("event_type") == "error") & (F.col("ts_us") < 1704412800000000)))
    return I.new_devices(claims, gap=0.0, known=known).select(F.round(F.col("ts") * 1e6).cast("long").alias("end_us"), "src", "message")


@query(f"""WITH RECURSIVE {E}, b AS (SELECT us, event_id - event_id % 300 AS n FROM e), g AS (SELECT *, lag(n) OVER (ORDER BY us) AS p FROM b), s AS (SELECT us, max(CASE WHEN p IS NULL OR n > p THEN us END) OVER (ORDER BY us ROWS UNBOUNDED PRECEDING) AS since FROM g),
q AS (SELECT us, row_number() OVER (ORDER BY us) AS rn FROM s WHERE us - since >= 6 * {HOUR}),
c AS (SELECT rn, us FROM q WHERE rn = 1 UNION ALL SELECT * FROM (SELECT q.rn, q.us FROM c JOIN q ON q.rn > c.rn AND q.us - c.us >= 12 * {HOUR} ORDER BY q.rn LIMIT 1))
SELECT us AS end_us, 'sensor-blind' AS name, 'high' AS severity FROM c""")
def blind_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots whose frame count grows at every 300th event only."""
    beats = adapted(spark, sf_dir).select("ts", (F.col("seq") - F.col("seq") % 300).alias("total_frames"))
    return I.blind_alerts(beats, blind=6 * 3600.0, again=12 * 3600.0).select(F.round(F.col("ts") * 1e6).cast("long").alias("end_us"), "name", "severity")


# Flows that end at ticks of 10 s (idle after 60 s): a flow can only end between two slots of ticks, so what a key
# does in one slot is one flow, and it ended before the next slot if it had a FIN or RST or a tick saw it idle.
_CUT = f"""{_X}, k AS (SELECT *, CASE WHEN fw THEN sip ELSE dip END AS src, CASE WHEN fw THEN sp ELSE dp END AS src_port, CASE WHEN fw THEN dip ELSE sip END AS dst, CASE WHEN fw THEN dp ELSE sp END AS dst_port FROM y),
t AS (SELECT src, src_port, dst, dst_port, no // 10000 AS slot, MIN(no) AS first, MAX(no) AS last, COUNT(*) AS pkts, bool_or(f = 4) AS rst, bool_or(f = 3) AS fin FROM k GROUP BY ALL),
u AS (SELECT *, lag(rst OR fin OR ((last + 69999) // 10000) * 10000 <= nxt, 1, TRUE) OVER w AS new FROM (SELECT *, lead(first) OVER w0 AS nxt FROM t WINDOW w0 AS (PARTITION BY src, src_port, dst, dst_port ORDER BY slot)) WINDOW w AS (PARTITION BY src, src_port, dst, dst_port ORDER BY slot)),
v AS (SELECT *, SUM(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY src, src_port, dst, dst_port ORDER BY slot ROWS UNBOUNDED PRECEDING) AS part FROM u),
z AS (SELECT src, src_port, dst, dst_port, part, MIN(first) AS first, MAX(last) AS last, SUM(pkts) AS pkts, bool_or(rst) AS rst, bool_or(fin) AS fin, (SELECT MAX(no) // 10000 + 1 FROM x) AS final FROM v GROUP BY ALL),
f AS (SELECT *, CASE WHEN rst OR fin THEN last // 10000 + 1 ELSE (last + 69999) // 10000 END AS tick FROM z)"""


@query(f"""WITH {_CUT} SELECT CAST(src AS VARCHAR) AS src, CAST(src_port AS INT) AS src_port, dst, CAST(dst_port AS INT) AS dst_port, CAST(first * 1000 AS BIGINT) AS first_us, CAST(last * 1000 AS BIGINT) AS last_us, CAST(pkts AS BIGINT) AS pkts,
CASE WHEN tick > final THEN 'eof' WHEN rst THEN 'rst' WHEN fin THEN 'fin' ELSE 'idle' END AS end_reason, CASE WHEN tick <= final THEN CAST(tick * 10000000 AS BIGINT) END AS end_us FROM f""")
def tick_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = flows_with_ticks(layers(frames_of_lineitem(spark, sf_dir)), Every(10_000_000), idle=60, active=1e9)
    return flows.select(
        F.col("a.ip").alias("src"), F.col("a.port").alias("src_port"), F.col("b.ip").alias("dst"), F.col("b.port").alias("dst_port"), F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"),
        (F.col("pkts_a_to_b") + F.col("pkts_b_to_a")).alias("pkts"), "end_reason", "end_us",
    )


@query(f"""WITH {_CUT}, d AS (SELECT no // 10000 + 1 AS tick, 1 AS frames, len AS bytes, 0 AS flows, 0 AS events FROM x UNION ALL SELECT first // 10000 + 1, 0, 0, 1, 0 FROM f UNION ALL SELECT tick, 0, 0, -1, 1 FROM f WHERE tick <= final
UNION ALL SELECT unnest(range(MIN(no) // 10000 + 1, MAX(no) // 10000 + 2)), 0, 0, 0, 1 FROM x)
SELECT tick * 10.0::DOUBLE AS ts, CAST(SUM(SUM(frames)) OVER w AS BIGINT) AS total_frames, CAST(SUM(SUM(bytes)) OVER w AS BIGINT) AS bytes, CAST(SUM(SUM(flows)) OVER w AS BIGINT) AS active_flows, CAST(SUM(SUM(events)) OVER w AS BIGINT) AS events_emitted
FROM d GROUP BY tick WINDOW w AS (ORDER BY tick ROWS UNBOUNDED PRECEDING)""")
def tick_heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heartbeats(layers(frames_of_lineitem(spark, sf_dir)), every=10, idle=60, active=1e9)


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/lines-{spark.sparkContext.applicationId}-{next(_numbers)}"


_numbers = iter(range(1 << 30))


@query(f"WITH {E} SELECT row_number() OVER (ORDER BY event_id) AS seq, CAST(event_id AS VARCHAR) AS uid, us, CAST(user_id AS VARCHAR) AS src, CAST(k AS INT) AS dst_port, event_type AS conn_state, event_id AS pkts_a_to_b FROM e")
def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events written as JSON lines and read again by the strict reader, in file and line order."""
    path = _folder(spark)
    rows = as_envelope(_stored(spark, sf_dir).where("event = 'conn'"), "conn")
    write_events(rows, path, max_bytes=1 << 20)
    return read_events(spark, path).select("seq", "uid", F.round(F.col("ts") * 1e6).cast("long").alias("us"), "src", "dst_port", "conn_state", "pkts_a_to_b")


@query(f"WITH {E} SELECT CAST(event_id AS VARCHAR) AS uid, us, event_type AS name, CASE event_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'medium' ELSE 'low' END AS severity, CAST(user_id AS VARCHAR) AS src FROM e")
def alert_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of two kinds in one folder, of which the alert reader takes the alerts."""
    path, rows = _folder(spark), _stored(spark, sf_dir)
    write_events(as_envelope(rows.where("event = 'conn'"), "conn").unionByName(as_envelope(rows.where("event = 'alert'"), "alert")), path)
    return read_alert_file(spark, path).select("uid", F.round(F.col("ts") * 1e6).cast("long").alias("us"), "name", "severity", "src")


@query(f"WITH {E} SELECT kind AS event, CAST(event_id AS VARCHAR) AS uid, us FROM e, (VALUES ('conn'), ('alert')) v(kind)")
def imported_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events imported into a table and read from it."""
    path, rows = _folder(spark), _stored(spark, sf_dir)
    Q.import_events(as_envelope(rows.where("event = 'conn'"), "conn").unionByName(as_envelope(rows.where("event = 'alert'"), "alert")), path)
    return spark.read.parquet(path).select("event", "uid", F.round(F.col("ts") * 1e6).cast("long").alias("us"))


@query(f"WITH {E} SELECT CAST(user_id AS VARCHAR) AS sender_mac, arg_min(us, event_id) AS first_us, arg_max(us, event_id) AS last_us, CAST(arg_max(k, event_id) AS VARCHAR) AS last_ip FROM e GROUP BY user_id")
def saved_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The devices of the first half saved and loaded again, then carried on over the other."""
    path, claims = _folder(spark), _claims(spark, sf_dir)
    half = F.col("ts_us") < 1705363200000000
    I.save_inventory(I.inventory(claims.where(half)), path)
    known, _ = I.load_inventory(spark, path)
    us = lambda c: F.round(F.col(c) * 1e6).cast("long")
    return I.inventory(claims.where(~half), known).select("sender_mac", us("first_seen").alias("first_us"), us("last_seen").alias("last_us"), "last_ip")


@query(f"""WITH {_X}, k AS (SELECT *, CASE WHEN fw THEN sip ELSE dip END AS src, CASE WHEN fw THEN sp ELSE dp END AS src_port, CASE WHEN fw THEN dip ELSE sip END AS dst, CASE WHEN fw THEN dp ELSE sp END AS dst_port FROM y),
a AS (SELECT src, src_port, dst, dst_port, MIN(no) AS no, COUNT(*) AS pkts FROM k GROUP BY src, src_port, dst, dst_port)
SELECT 'conn' AS event, no * 1000 AS us, src, CAST(src_port AS INT) AS src_port, dst, pkts FROM a""")
def capture_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capture's frames to events: these frames hold flows only (frame numbers repeat, so the events' numbers are left out)."""
    events = events_of_frames(frames_of_lineitem(spark, sf_dir))
    return events.select("event", F.round(F.col("ts") * 1e6).cast("long").alias("us"), "src", "src_port", "dst", (F.col("pkts_a_to_b") + F.col("pkts_b_to_a")).alias("pkts"))
