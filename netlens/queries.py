"""The engine's operators over the driver's tables, and the same in DuckDB SQL.

The tables hold no network events: each query projects one of them into the event schema
(user ids as hosts, event types as peers, the number in ``props`` as a port) and runs the
engine's own operator with limits that fire at these sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import detections as D
from .operators import inventory as I
from .operators import store as Q
from .operators.flows import fold_flows
from .operators.frames import layers, link_counters
from .plans.folds import cooldown

DAY, HOUR = 86_400_000_000, 3_600_000_000
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: The adapter as SQL: event id, microseconds, user, type and the number in props.
E = "e AS (SELECT event_id, epoch_us(ts) AS us, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k, value FROM events)"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def adapted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts_us, ts, user_id, event_type and k of ``events``; seq and uid are the id."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("uid"), us.alias("ts_us"), (us / 1e6).alias("ts"), F.col("user_id").cast("string").alias("user"), "user_id", "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"), "value",
    )


def _conn(rows: DataFrame, dst: str, port: str) -> DataFrame:
    return rows.withColumn("event", F.lit("conn")).withColumn("proto", F.lit("tcp")).withColumn("src", F.col("user")).withColumn("dst", F.col(dst).cast("string")).withColumn("dst_port", F.col(port))


def _shown(alerts: DataFrame) -> DataFrame:
    """Alerts with whole microseconds and evidence as one text."""
    return alerts.select(F.round(F.col("ts") * 1e6).cast("long").alias("end_us"), "src", "dst", "message", F.concat_ws(",", "evidence").alias("evidence"))


def _densest_sql(rows: str, group: str, width: int, least: int, count: str, message: str, dst: str, src: str = "CAST(g1 AS VARCHAR)") -> str:
    """SQL of a densest window over ``rows`` (g1, g2, us, event_id, key, lastv)."""
    frame = "(PARTITION BY g1, g2 ORDER BY us RANGE BETWEEN CURRENT ROW AND {w} FOLLOWING)".format(w=width)
    n = f"COUNT(DISTINCT key) OVER {frame}" if count == "distinct" else f"COUNT(*) OVER {frame}"
    return f"""WITH {E}, r AS ({rows}),
w AS (SELECT *, {n} AS n FROM r),
b AS (SELECT *, row_number() OVER (PARTITION BY g1, g2 ORDER BY n DESC, us, event_id) AS rn FROM w),
s AS (SELECT g1, g2, us AS start_us, event_id AS start_id, CAST(n AS BIGINT) AS n FROM b WHERE rn = 1 AND n >= {least}),
m AS (SELECT s.*, r.us, r.event_id, r.lastv, row_number() OVER (PARTITION BY s.g1, s.g2 ORDER BY r.us, r.event_id) AS i FROM s JOIN r
  ON r.g1 = s.g1 AND r.g2 IS NOT DISTINCT FROM s.g2 AND r.us BETWEEN s.start_us AND s.start_us + {width} AND (r.us > s.start_us OR r.event_id >= s.start_id)),
a AS (SELECT g1, g2, n, MAX(us) AS end_us, arg_max(lastv, (us, event_id)) AS lastv, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY i) FILTER (WHERE i <= 10) AS evidence FROM m GROUP BY g1, g2, n)
SELECT end_us, {src} AS src, {dst} AS dst, {message} AS message, evidence FROM a"""


@query(_densest_sql("SELECT user_id AS g1, event_type AS g2, us, event_id, k AS key, NULL AS lastv FROM e", "", 3 * DAY, 6, "distinct", "n || ' distinct ports on ' || g2 || ' within 259200s'", "g2"))
def scan_vertical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(D.PortScan(window=3 * 86400, ports=6).vertical(_conn(adapted(spark, sf_dir), "event_type", "k")))


@query(_densest_sql("SELECT user_id AS g1, event_type AS g2, us, event_id, k AS key, NULL AS lastv FROM e", "", 7 * DAY, 9, "distinct", "n || ' distinct ports on ' || g2 || ' within 604800s'", "g2"))
def scan_vertical_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(D.PortScan(window=7 * 86400, ports=9).vertical(_conn(adapted(spark, sf_dir), "event_type", "k")))


@query(_densest_sql("SELECT user_id AS g1, k % 10 AS g2, us, event_id, event_type AS key, NULL AS lastv FROM e", "", 3 * DAY, 4, "distinct", "n || ' hosts contacted on port ' || g2 || ' within 259200s'", "CAST(NULL AS VARCHAR)"))
def scan_horizontal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapted(spark, sf_dir).withColumn("port", F.col("k") % 10)
    return _shown(D.PortScan(window=3 * 86400, hosts=4).horizontal(_conn(rows, "event_type", "port")))


@query(f"""WITH {E}, g AS (SELECT user_id, event_type, event_id, us, us - lag(us) OVER w AS gap, row_number() OVER w AS i FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY us, event_id)),
a AS (SELECT user_id, event_type, COUNT(*) AS n, MIN(us) AS f, MAX(us) AS l, MIN(gap) AS lo, MAX(gap) AS hi, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY i) FILTER (WHERE i <= 10) AS evidence FROM g GROUP BY ALL),
m AS (SELECT *, CAST(l - f AS DOUBLE) / (n - 1) / 1e6 AS mean FROM a WHERE n >= 5)
SELECT l AS end_us, CAST(user_id AS VARCHAR) AS src, event_type AS dst, n || ' flows to ' || event_type || ':443 at ~' || printf('%.1f', mean) || 's intervals' AS message, evidence
FROM m WHERE mean BETWEEN 10 AND 1e6 AND hi / 1e6 - mean <= 1.0 * mean AND mean - lo / 1e6 <= 1.0 * mean""")
def beacon(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _conn(adapted(spark, sf_dir).withColumn("port", F.lit(443)), "event_type", "port")
    return _shown(D.Beaconing(least=5, shortest=10.0, longest=1e6, jitter=1.0).detect(rows))


@query(f"""WITH {E}, d AS (SELECT event_id, us, user_id, event_type, repeat('x', k + 1) || '.' || event_type AS q FROM e),
m AS (SELECT *, list_max(list_transform(string_split(q, '.'), lambda x: length(x))) AS label, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i FROM d WHERE k_ok(q)),
a AS (SELECT user_id, MAX(label) AS n, MAX(us) AS end_us, arg_max(event_type, (us, event_id)) AS dst, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY i) FILTER (WHERE i <= 10) AS evidence FROM m GROUP BY user_id)
SELECT end_us, CAST(user_id AS VARCHAR) AS src, dst, 'dns label of ' || n || ' chars from ' || user_id AS message, evidence FROM a""".replace("WHERE k_ok(q)", "WHERE list_max(list_transform(string_split(q, '.'), lambda x: length(x))) > 45"))
def dns_long_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapted(spark, sf_dir).withColumn("event", F.lit("dns")).withColumn("src", F.col("user")).withColumn("dst", F.col("event_type"))
    return _shown(D.DnsTunnel().long_labels(rows.withColumn("query", F.concat(F.repeat(F.lit("x"), F.col("k") + 1), F.lit("."), F.col("event_type")))))


@query(_densest_sql("SELECT user_id AS g1, NULL AS g2, us, event_id, k AS key, event_type AS lastv FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY us, event_id) AS rn FROM e WHERE event_type = 'view') WHERE rn = 1", "", 3 * DAY, 5, "rows", "n || ' txt queries within 259200s'", "lastv"))
def txt_flood(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapted(spark, sf_dir).where("event_type = 'view'").withColumn("event", F.lit("dns")).withColumn("qtype", F.lit(16))
    return _shown(D.DnsTunnel(window=3 * 86400, queries=5).txt_flood(rows.withColumn("src", F.col("user")).withColumn("dst", F.col("event_type")).withColumn("query", F.col("k").cast("string"))))


@query(_densest_sql("SELECT k AS g1, NULL AS g2, us, event_id, user_id AS key, NULL AS lastv FROM e", "", 6 * HOUR, 2, "distinct", "g1 || ' claimed by ' || n || ' macs within 21600s'", "CAST(NULL AS VARCHAR)"))
def arp_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapted(spark, sf_dir).withColumn("event", F.lit("arp")).withColumn("src", F.col("k").cast("string")).withColumn("sender_mac", F.col("user"))
    return _shown(D.ArpSpoof(window=6 * 3600).conflicts(rows))


@query(_densest_sql("SELECT user_id AS g1, NULL AS g2, us, event_id, user_id AS key, CAST(k AS VARCHAR) AS lastv FROM e WHERE event_type = 'error'", "", DAY, 4, "rows", "n || ' gratuitous arps from ' || g1 || ' within 86400s'", "CAST(NULL AS VARCHAR)", "lastv"))
def arp_storm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapted(spark, sf_dir).where("event_type = 'error'").withColumn("event", F.lit("arp")).withColumn("is_gratuitous", F.lit(True))
    return _shown(D.ArpSpoof(storm_window=86400, storm=4).storms(rows.withColumn("src", F.col("k").cast("string")).withColumn("sender_mac", F.col("user"))))


@query("""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS h FROM pages),
w(d, i) AS (VALUES ('example.net', 0), ('example.org', 1), ('blog.example.org', 2)),
m AS (SELECT page_id, h, arg_min(d, i) AS d FROM p JOIN w ON h = d OR ends_with(h, '.' || d) GROUP BY page_id, h),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id % 7, d ORDER BY page_id) AS n FROM m)
SELECT CAST(MIN(page_id) * 1000000 AS BIGINT) AS end_us, CAST(page_id % 7 AS VARCHAR) AS src, arg_min(h, page_id) AS dst, (page_id % 7) || ' connected to watched domain ' || d AS message, string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY n) FILTER (WHERE n <= 10) AS evidence
FROM r GROUP BY page_id % 7, d""")
def sni_watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "^https?://([^/:?#]+)", 1)
    rows = table(spark, sf_dir, "pages").select(
        F.lit("ssl").alias("event"), F.col("page_id").alias("seq"), F.col("page_id").cast("string").alias("uid"), F.col("page_id").cast("double").alias("ts"), (F.col("page_id") % 7).cast("string").alias("src"), F.lower(host).alias("dst"), host.alias("sni")
    )
    return _shown(D.SniWatch(["example.net", "example.org", "blog.example.org"]).detect(rows))


_ARP = f"WITH RECURSIVE {E}, f AS (SELECT user_id, MIN(event_id) AS event_id FROM e GROUP BY user_id), o AS (SELECT e.event_id, e.us, e.user_id, e.k, row_number() OVER (ORDER BY e.event_id) AS rn FROM e JOIN f USING (event_id))"


@query(_ARP + f""", c AS (SELECT rn, us AS last, event_id FROM o WHERE rn = 1 UNION ALL
SELECT * FROM (SELECT o.rn, o.us, o.event_id FROM c JOIN o ON o.rn > c.rn AND o.us - c.last >= {HOUR} ORDER BY o.rn LIMIT 1))
SELECT o.us AS end_us, CAST(o.k AS VARCHAR) AS src, CAST(NULL AS VARCHAR) AS dst, 'first time seeing ' || o.user_id || ' claiming ' || o.k AS message, CAST(o.event_id AS VARCHAR) AS evidence FROM c JOIN o USING (event_id)""")
def new_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(I.new_devices(_claims(spark, sf_dir), gap=3600))


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapted(spark, sf_dir).withColumn("event", F.lit("arp")).withColumn("src", F.col("k").cast("string")).withColumn("sender_mac", F.col("user"))


@query(f"""WITH {E} SELECT CAST(user_id AS VARCHAR) AS sender_mac, arg_min(us, event_id) AS first_us, arg_max(us, event_id) AS last_us, CAST(arg_max(k, event_id) AS VARCHAR) AS last_ip FROM e GROUP BY user_id""")
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = lambda c: F.round(F.col(c) * 1e6).cast("long")
    return I.inventory(_claims(spark, sf_dir)).select("sender_mac", us("first_seen").alias("first_us"), us("last_seen").alias("last_us"), "last_ip")


@query(f"""WITH RECURSIVE {E}, o AS (SELECT event_id, us, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) AS rn FROM e),
c AS (SELECT user_id, event_type, rn, us, event_id FROM o WHERE rn = 1 UNION ALL
SELECT user_id, event_type, rn, us, event_id FROM (SELECT o.*, row_number() OVER (PARTITION BY o.user_id, o.event_type ORDER BY o.rn) AS x FROM c JOIN o ON o.user_id = c.user_id AND o.event_type = c.event_type AND o.rn > c.rn AND o.us - c.us >= {DAY}) WHERE x = 1)
SELECT event_id AS seq, event_type AS name, CAST(user_id AS VARCHAR) AS src, us AS ts_us FROM c""")
def alert_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapted(spark, sf_dir).select("seq", F.col("event_type").alias("name"), F.col("user").alias("src"), "ts_us")
    return cooldown(rows, DAY, order="ts_us")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a conn row and as an alert row."""
    rows = adapted(spark, sf_dir)
    level = F.when(F.col("event_type") == "error", "high").when(F.col("event_type") == "purchase", "medium").otherwise("low")
    extra = {"duration": "value", "conn_state": "event_type", "end_reason": "event_type", "src_port": "k", "pkts_a_to_b": "seq", "bytes_a_to_b": "seq", "pkts_b_to_a": "seq", "bytes_b_to_a": "seq"}
    out = _conn(rows, "k", "k").withColumn("event", F.explode(F.array(F.lit("conn"), F.lit("alert")))).withColumn("severity", level).withColumn("name", F.col("event_type"))
    for name, of in extra.items():
        out = out.withColumn(name, F.col(of))
    return out.withColumn("message", F.col("event_type")).withColumn("evidence", F.array("uid"))


_FLOW_COLUMNS = "event_id AS seq, us, CAST(user_id AS VARCHAR) AS src, CAST(k AS VARCHAR) AS dst, event_type AS conn_state"


def _flow_view(rows: DataFrame) -> DataFrame:
    return rows.select("seq", F.round(F.col("ts") * 1e6).cast("long").alias("us"), "src", "dst", "conn_state")


@query(f"WITH {E} SELECT {_FLOW_COLUMNS} FROM e WHERE us >= 1704844800000000 AND (user_id = 7 OR k = 7) ORDER BY event_id")
def flow_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flow_view(Q.query_flows(_stored(spark, sf_dir), since=1704844800.0, host="7"))


@query(f"WITH {E} SELECT event_id AS seq, us, event_type AS name FROM e WHERE us >= 1704844800000000 AND event_type IN ('error', 'purchase')")
def alert_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.query_alerts(_stored(spark, sf_dir), since=1704844800.0, min_severity="medium").select("seq", F.round(F.col("ts") * 1e6).cast("long").alias("us"), "name")


@query(f"WITH {E} SELECT event_id AS seq, us, event_type AS name FROM e WHERE event_type = 'error'")
def alert_query_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.query_alerts(_stored(spark, sf_dir), name="error").select("seq", F.round(F.col("ts") * 1e6).cast("long").alias("us"), "name")


@query(f"WITH {E} SELECT {_FLOW_COLUMNS} FROM e ORDER BY us DESC, event_id LIMIT 50")
def recent_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flow_view(Q.recent_flows(_stored(spark, sf_dir)))


@query(f"WITH {E}, u AS (SELECT 0 AS o, * FROM e UNION ALL SELECT 1 AS o, * FROM e WHERE event_type = 'error') SELECT event_id AS seq, us, event_type AS name FROM u ORDER BY us DESC, o, event_id LIMIT 50")
def recent_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stored(spark, sf_dir)
    return Q.recent_alerts(rows, rows.where("name = 'error'")).select("seq", F.round(F.col("ts") * 1e6).cast("long").alias("us"), "name")


@query(f"WITH {E} SELECT 2 * COUNT(*) AS n FROM e")
def event_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.count_events(_stored(spark, sf_dir))


@query(f"WITH {E} SELECT us, event_id AS total_frames, event_id * 2 AS bytes, CAST(k AS BIGINT) AS active_flows, user_id AS events_emitted FROM e WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 1")
def latest_heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapted(spark, sf_dir).where("event_type = 'error'").withColumn("event", F.lit("heartbeat")).withColumn("total_frames", F.col("seq")).withColumn("bytes", F.col("seq") * 2)
    beat = Q.latest_heartbeat(rows.withColumn("active_flows", F.col("k").cast("long")).withColumn("events_emitted", F.col("user_id")))
    return beat.select(F.round(F.col("ts") * 1e6).cast("long").alias("us"), "total_frames", "bytes", "active_flows", "events_emitted")


@query(f"""WITH {E}, a AS (SELECT event_id, user_id, event_type, k, us FROM e)
SELECT a.event_id AS alert_no, e.event_id AS seq, e.event_type FROM a JOIN e ON e.event_id BETWEEN a.event_id AND a.event_id + 2 WHERE a.event_type = 'error'""")
def alert_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapted(spark, sf_dir)
    ids = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: (F.col("seq") + i).cast("string"))
    alerts = rows.where("event_type = 'error'").select("uid", ids.alias("evidence"))
    return D.with_evidence(alerts, rows.select("uid", "seq", "event_type")).select(F.col("alert_uid").cast("long").alias("alert_no"), "seq", "event_type")


def _hex2(c) -> object:
    return F.lpad(F.hex(c), 2, "0")


def frames_of_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TCP frames between 10.0.x.y hosts made of lineitem rows: real bytes, through all layers."""
    c = lambda name, n: F.pmod(F.col(name), F.lit(n)).cast("long")
    host = lambda a, b: F.concat(F.lit("0A00"), _hex2(a), _hex2(b))
    port = lambda x: F.lpad(F.hex(x), 4, "0")
    flags = F.when(c("l_linenumber", 7) == 1, 2).when(c("l_linenumber", 7) == 2, 16).when(c("l_linenumber", 7) == 3, 1).when(c("l_linenumber", 7) == 4, 4).otherwise(24)
    head = F.concat(F.lit("020000000001020000000002"), F.lit("0800"), F.lit("450000280000000040060000"), host(c("l_suppkey", 200), c("l_suppkey", 5)), host(c("l_partkey", 200), c("l_partkey", 3)))
    data = F.concat(head, port(c("l_suppkey", 1000) + 1000), port(c("l_partkey", 1000) + 2000), F.lit("0000000000000000"), F.lit("50"), _hex2(flags), F.lit("FAF000000000"), F.repeat(F.lit("00"), 6))
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("frame_no"), F.timestamp_micros((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000).alias("ts"),
        (60 + F.col("l_linenumber")).cast("int").alias("wire_len"), F.unhex(data).alias("data"),
    )


_X = """x AS (SELECT l_orderkey * 8 + l_linenumber AS no, 60 + l_linenumber AS len, l_linenumber % 7 AS f,
  l_suppkey % 200 AS s1, l_suppkey % 5 AS s2, l_suppkey % 1000 + 1000 AS sp, l_partkey % 200 AS d1, l_partkey % 3 AS d2, l_partkey % 1000 + 2000 AS dp FROM lineitem),
y AS (SELECT *, (s1, s2, sp) <= (d1, d2, dp) AS fw, '10.0.' || s1 || '.' || s2 AS sip, '10.0.' || d1 || '.' || d2 AS dip FROM x)"""


@query(f"""WITH {_X}, k AS (SELECT *, CASE WHEN fw THEN sip ELSE dip END AS src, CASE WHEN fw THEN sp ELSE dp END AS src_port, CASE WHEN fw THEN dip ELSE sip END AS dst, CASE WHEN fw THEN dp ELSE sp END AS dst_port FROM y),
a AS (SELECT src, src_port, dst, dst_port, MIN(no) * 1000 AS first_us, MAX(no) * 1000 AS last_us, COUNT(*) FILTER (WHERE fw) AS pkts_a_to_b, COALESCE(SUM(len) FILTER (WHERE fw), 0) AS bytes_a_to_b, COUNT(*) FILTER (WHERE NOT fw) AS pkts_b_to_a, COALESCE(SUM(len) FILTER (WHERE NOT fw), 0) AS bytes_b_to_a,
 bool_or(f = 1) AS syn, bool_or(f = 3) AS fin, bool_or(f = 4) AS rst FROM k GROUP BY ALL)
SELECT CAST(src AS VARCHAR) AS src, CAST(src_port AS INT) AS src_port, dst, CAST(dst_port AS INT) AS dst_port, CAST(first_us AS BIGINT) AS first_us, CAST(last_us AS BIGINT) AS last_us, pkts_a_to_b, CAST(bytes_a_to_b AS BIGINT) AS bytes_a_to_b, pkts_b_to_a, CAST(bytes_b_to_a AS BIGINT) AS bytes_b_to_a,
 CASE WHEN syn AND rst THEN 'REJ' WHEN rst THEN 'RSTO' WHEN syn AND fin THEN 'SF' WHEN syn THEN 'S0' ELSE 'OTH' END AS conn_state FROM a""")
def flow_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = fold_flows(layers(frames_of_lineitem(spark, sf_dir)))
    return flows.select(
        F.col("a.ip").alias("src"), F.col("a.port").alias("src_port"), F.col("b.ip").alias("dst"), F.col("b.port").alias("dst_port"), F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"),
        "pkts_a_to_b", "bytes_a_to_b", "pkts_b_to_a", "bytes_b_to_a", S.conn_state(F.col("proto"), F.col("syn"), F.col("fin"), F.col("rst")).alias("conn_state"),
    )


@query("SELECT COUNT(*) AS frames, COUNT(*) * 60 AS bytes, COUNT(*) AS ipv4, CAST(0 AS BIGINT) AS ipv6, CAST(0 AS BIGINT) AS arp, CAST(0 AS BIGINT) AS other FROM lineitem")
def frame_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_counters(frames_of_lineitem(spark, sf_dir))


@query(f"WITH {_X} SELECT no AS frame_no, sip AS src, dip AS dst, CAST(sp AS INT) AS src_port, CAST(dp AS INT) AS dst_port, 'tcp' AS proto, fw AS forward FROM y")
def frame_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers(frames_of_lineitem(spark, sf_dir)).select("frame_no", "src", "dst", "src_port", "dst_port", "proto", "forward")


@query("""SELECT o_orderkey, CASE o_orderkey % 20 WHEN 1 THEN 'icmp' WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' ELSE 'other' END AS proto,
CASE WHEN o_orderkey % 20 <> 6 THEN '-' WHEN o_custkey % 2 = 0 AND o_custkey % 5 = 0 THEN 'REJ' WHEN o_custkey % 5 = 0 THEN 'RSTO' WHEN o_custkey % 2 = 0 AND o_custkey % 3 = 0 THEN 'SF' WHEN o_custkey % 2 = 0 THEN 'S0' ELSE 'OTH' END AS state FROM orders""")
def flow_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    proto = S.proto_name(F.col("o_orderkey") % 20)
    every = lambda n: F.col("o_custkey") % n == 0
    return table(spark, sf_dir, "orders").select("o_orderkey", proto.alias("proto"), S.conn_state(proto, every(2), every(3), every(5)).alias("state"))


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages)
SELECT page_id, CAST(list_max(list_transform(string_split(host, '.'), lambda x: length(x))) AS INT) AS label FROM p""")
def longest_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", S.longest_label(F.regexp_extract("url", "^https?://([^/:?#]+)", 1)).alias("label"))


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_custkey || 's' WHEN 1 THEN ' ' || o_custkey || 'M ' WHEN 2 THEN o_custkey || 'h' WHEN 3 THEN '' || o_custkey WHEN 4 THEN '-' || o_custkey || 's' ELSE o_custkey || ' m' END AS d FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 3) THEN n WHEN o_orderkey % 6 = 1 THEN n * 60 WHEN o_orderkey % 6 = 2 THEN n * 3600 END AS seconds FROM (SELECT o_orderkey, CAST(regexp_extract(d, '([0-9]+)', 1) AS BIGINT) AS n FROM t)""")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, kind = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 6
    text = F.when(kind == 0, F.concat(n, F.lit("s"))).when(kind == 1, F.concat(F.lit(" "), n, F.lit("M "))).when(kind == 2, F.concat(n, F.lit("h"))).when(kind == 3, n).when(kind == 4, F.concat(F.lit("-"), n, F.lit("s"))).otherwise(F.concat(n, F.lit(" m")))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.parse_duration(text).alias("seconds"))


@query("SELECT o_orderkey, CAST(o_orderkey % 65536 AS INT) AS u16, CAST(o_custkey % 256 AS INT) AS u8 FROM orders")
def byte_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.unhex(F.concat(F.lpad(F.hex(F.col("o_orderkey") % 65536), 4, "0"), F.lpad(F.hex(F.col("o_custkey") % 256), 2, "0")))
    return table(spark, sf_dir, "orders").select("o_orderkey", data.alias("d")).select("o_orderkey", S.u16_at(F.col("d"), 0).alias("u16"), S.byte_at(F.col("d"), 2).alias("u8"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' END AS severity, CAST(CASE WHEN o_orderkey % 4 < 3 THEN o_orderkey % 4 + 1 END AS INT) AS rank FROM orders""")
def severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("o_orderkey") % 4
    level = S.parse_severity(F.when(kind == 0, " LOW").when(kind == 1, "Medium ").when(kind == 2, "high").otherwise("urgent"))
    return table(spark, sf_dir, "orders").select("o_orderkey", level.alias("severity"), S.severity_rank(level).alias("rank"))


@query(f"WITH {E} SELECT event_id AS seq, strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%SZ') AS at, CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 ELSE 1 END AS priority, user_id || ' -> ' || CASE WHEN k < 50 THEN '-' ELSE CAST(k AS VARCHAR) END || ': ' || event_type AS body FROM e")
def push_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapted(spark, sf_dir)
    level = F.when(F.col("event_type") == "error", "high").when(F.col("event_type") == "purchase", "medium").otherwise("low")
    dst = F.when(F.col("k") >= 50, F.col("k").cast("string"))
    return rows.select("seq", S.iso_utc(F.col("ts")).alias("at"), S.push_priority(level).alias("priority"), S.push_body(F.col("user"), dst, F.col("event_type")).alias("body"))


@query(f"WITH {E}, h AS (SELECT date_trunc('hour', make_timestamp(us)) AS h, COUNT(*) AS n FROM e GROUP BY 1), c AS (SELECT epoch_us(h) AS us, CAST(SUM(n) OVER (ORDER BY h) AS BIGINT) AS frames FROM h) SELECT us, frames, COALESCE(CAST(frames - lag(frames) OVER (ORDER BY us) AS DOUBLE) / ((us - lag(us) OVER (ORDER BY us)) / 1e6), 0) AS pps FROM c")
def frame_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.capture import rate

    hours = adapted(spark, sf_dir).groupBy((F.floor(F.col("ts_us") / HOUR) * HOUR).alias("us")).agg(F.count("*").alias("n"))
    total = hours.select("us", F.sum("n").over(Window.orderBy("us")).alias("frames"), (F.col("us") / 1e6).alias("ts"))
    return rate(total).select("us", "frames", "pps")


from . import parser_queries  # noqa: E402, F401  registers its queries here
