import datetime

import pytest
from pyspark.sql import functions as F

from netlens.functions.payloads import dns_row, http_row, tls_row
from netlens.operators.detections import ArpSpoof, RuleEngine
from netlens.operators.flows import conn_events, events_of_frames, flows_with_ticks, fold_flows
from netlens.operators.frames import layers, link_counters
from netlens.operators.inventory import load_inventory, save_inventory
from netlens.sources.capture import FRAMES, read_synthetic
from netlens.sources.ndjson import read_events
from netlens.sources.sinks import sweep
from netlens.streaming.sensor import Sensor
from netlens.functions.scalars import ipv6_text
from netlens.streaming.live import LiveDetector, keyed_cooldown, live_query, slid

from . import frames as B
from .test_detections import conn, events

UTC = datetime.timezone.utc


def capture(spark, rows):
    """(ts, frame) rows as frames."""
    full = [(i, datetime.datetime.fromtimestamp(t, UTC), len(f), bytearray(f)) for i, (t, f) in enumerate(rows)]
    return spark.createDataFrame(full, FRAMES)


def syn(src, dst, sport, dport, flags=2, body=b""):
    return B.ethernet(0x0800, B.ipv4(src, dst, 6, B.tcp(sport, dport, flags, body)))


def test_layers(spark):
    inner = B.ipv4("10.0.0.10", "10.0.0.9", 17, B.udp(53, 9999, b"xyz"))
    rows = [
        (0, B.ethernet(0x0800, inner)),
        (0, B.ethernet(0x0800, inner, [(0x8100, 0x2005)])),
        (0, B.ethernet(0x0800, inner, [(0x88A8, 7), (0x8100, 9)])),
        (0, B.ethernet(0x86DD, B.ipv6("2001:db8::1", "::2", 6, B.tcp(1, 2, 0x12, b"hey")))),
        (0, B.ethernet(0x0800, inner[:15])),
        (0, b"short"),
        (0, B.ethernet(0x0800, B.ipv4("1.2.3.4", "1.2.3.5", 1, b"\x08\0\0\0"))),
        (0, B.ethernet(0x0800, B.ipv4("1.2.3.4", "1.2.3.5", 6, b"\0" * 10))),
        (0, B.arp(2, "aa:aa:aa:aa:aa:01", "10.0.0.5", "00:00:00:00:00:00", "10.0.0.5", pad=18)),
    ]
    got = {r.frame_no: r for r in layers(capture(spark, rows)).collect()}
    for i, vlan in ((0, None), (1, 5), (2, 7)):
        r = got[i]
        assert (r.src, r.dst, r.proto, r.src_port, r.dst_port, bytes(r.payload), r.vlan) == ("10.0.0.10", "10.0.0.9", "udp", 53, 9999, b"xyz", vlan)
        assert not r.forward and r.a.ip == "10.0.0.9"
    assert (got[3].src, got[3].dst, got[3].tcp_flags, bytes(got[3].payload)) == ("2001:db8::1", "::2", 0x12, b"hey")
    assert got[4].version is None and got[5].version is None and got[5].outer is None
    assert got[6].proto == "icmp" and got[6].src_port is None and got[6].payload is None
    assert got[7].proto == "tcp" and got[7].src_port is None and got[7].a.port == -1
    assert got[8].arp.asDict() == {"op": "reply", "sender_mac": "aa:aa:aa:aa:aa:01", "src": "10.0.0.5", "target_mac": "00:00:00:00:00:00", "target_ip": "10.0.0.5", "is_gratuitous": True}
    c = link_counters(capture(spark, rows)).first()
    assert (c.frames, c.ipv4, c.ipv6, c.arp, c.other) == (9, 4, 1, 1, 3)


def test_payload_parsers():
    answer = b"\xc0\x0c" + bytes.fromhex("0001000100000005") + b"\0\4" + bytes([1, 2, 3, 4])
    assert dns_row(B.dns_query(7, "WWW.Example.com", 1, 0x8183, answer, 1)) == (7, True, 3, "www.example.com.", 1, ["WWW.Example.com. 1.2.3.4"])
    assert dns_row(b"\0" * 5) is None and dns_row(B.dns_query(7, "a.b")[:-3]) is None
    assert dns_row(b"\0\1\0\0\0\0\0\0\0\0\0\0") == (1, False, 0, None, None, [])
    assert http_row(b"GET /x HTTP/1.1\r\nhost: a\r\nHOST: b\r\nUser-Agent: u\r\n\r\nbody") == ("request", "GET", "/x", "a", "u", None)
    assert http_row(b"HTTP/1.1 404 Not Found\r\nServer: s\r\n\r\n") == ("response", None, None, None, None, 404)
    assert http_row(b"GET / HTTP/1.1\r\nhost: a\r\n") is None
    assert http_row(b"GET / HTTP/1.1\r\n" + b"a: b\r\n" * 17 + b"\r\n") is None
    assert http_row(b"GET /" + b"x" * 600 + b" HTTP/1.1\r\n\r\n")[2] == "/" + "x" * 511
    hello = B.client_hello("evil.example", (1, 2, 3))
    assert tls_row(hello) == ("0x0303", "evil.example", False, [1, 2, 3], [0, 43])
    assert tls_row(B.client_hello(None))[1] is None
    assert tls_row(hello[:60])[2] is True and tls_row(hello[:8]) is None and tls_row(b"\x17" + hello[1:]) is None


def test_flow_counts_and_states(spark):
    a, b = "10.0.0.1", "10.0.0.2"
    rows = [(0, syn(a, b, 1000, 80)), (1, syn(b, a, 80, 1000, 0x12)), (2, syn(a, b, 1000, 80, 0x10)), (3, syn(a, b, 5, 6)), (4, syn(b, a, 6, 5, 4)), (5, B.ethernet(0x0800, B.ipv4(a, b, 17, B.udp(7, 8)))), (6, B.ethernet(0x0800, B.ipv4(b, a, 1, b"\0" * 8))), (7, B.ethernet(0x0800, B.ipv4(a, b, 1, b"\0" * 8)))]
    got = {(r.proto, r.src_port): r for r in conn_events(fold_flows(layers(capture(spark, rows)))).collect()}
    t = got["tcp", 1000]
    assert (t.src, t.dst, t.dst_port, t.pkts_a_to_b, t.pkts_b_to_a, t.bytes_a_to_b, t.conn_state, t.duration, t.ts) == (a, b, 80, 2, 1, 108, "S0", 2.0, 0.0)
    assert got["tcp", 5].conn_state == "REJ" and got["udp", 7].conn_state == "-"
    assert (got["icmp", None].pkts_a_to_b, got["icmp", None].pkts_b_to_a) == (1, 1)


def test_flows_end_at_ticks(spark):
    a, b = "10.0.0.1", "10.0.0.2"
    rows = layers(capture(spark, [(t, syn(a, b, 1, 2, 0x10)) for t in range(11)]))
    out = flows_with_ticks(rows, [5.5], idle=60, active=5).orderBy("frame_no").collect()
    assert [(r.pkts_a_to_b, r.end_reason) for r in out] == [(6, "active"), (5, "eof")]
    idle = layers(capture(spark, [(0, syn(a, b, 1, 2)), (1, syn(b, a, 2, 1, 0x12))]))
    (r,) = conn_events(flows_with_ticks(idle, [61])).collect()
    assert (r.end_reason, r.conn_state, r.duration) == ("idle", "S0", 1.0)
    reset = layers(capture(spark, [(0, syn(a, b, 1, 2)), (1, syn(b, a, 2, 1, 4)), (3, syn(a, b, 1, 2))]))
    assert [(r.end_reason, r.conn_state) for r in conn_events(flows_with_ticks(reset, [2, 4])).orderBy("ts").collect()] == [("rst", "REJ"), ("eof", "S0")]


def test_frames_to_alerts(spark):
    rows = [(i, syn("192.0.2.66", "198.51.100.7", 40000 + i, 1000 + i)) for i in range(15)]
    rows += [(100 + 60 * i, syn("192.0.2.66", "198.51.100.99", 41000 + i, 443)) for i in range(5)]
    rows += [(400, B.ethernet(0x0800, B.ipv4("192.0.2.20", "198.51.100.7", 17, B.udp(5353, 53, B.dns_query(1, "a" * 60 + ".tunnel.example")))))]
    rows += [(500 + i, B.arp(2, f"aa:aa:aa:aa:aa:0{1 + i % 2}", "10.0.0.5", "00:00:00:00:00:00", "10.0.0.1")) for i in range(4)]
    rows += [(600, syn("192.0.2.66", "198.51.100.9", 4444, 443, 0x18, B.client_hello("evil.example"))), (601, syn("192.0.2.66", "198.51.100.9", 4445, 80, 0x18, b"GET / HTTP/1.1\r\nHost: h\r\n\r\n"))]
    out = events_of_frames(capture(spark, rows), heartbeat=True).persist()
    kinds = {r.event: r["count"] for r in out.groupBy("event").count().collect()}
    assert kinds == {"conn": 23, "dns": 1, "arp": 4, "ssl": 1, "http": 1, "heartbeat": 1}
    assert out.where("event = 'heartbeat'").first().events_emitted == 31
    names = [r.name for r in RuleEngine().alerts(out).orderBy("no").collect()]
    assert names == ["port-scan", "beaconing", "dns-tunnel", "arp-spoof"]


def test_frames_are_taken_apart_twice_at_most(spark):
    """The plan of a capture's events reads checkpoints; frames are read for the flows and for those that carry events."""
    frames = spark.range(50).select(F.col("id").alias("frame_no"), F.timestamp_micros("id").alias("ts"), F.lit(60).alias("wire_len"), F.lit(syn("10.0.0.1", "10.0.0.2", 1, 2)).alias("data"))
    out = events_of_frames(frames)
    assert "Range (" not in out._jdf.queryExecution().toString() and out.count() == 1


def test_synthetic_frames_play_the_drill(spark):
    out = events_of_frames(read_synthetic(spark, frames=560))
    assert [r.name for r in RuleEngine([RuleEngine().rules[0]]).alerts(out).where("src = '192.0.2.66'").collect()] == ["port-scan"]


def test_sensor_ticks_equal_one_run(spark, tmp_path):
    """What a sensor writes at its ticks, a restart between them, equals the flows of one run with these ticks."""
    a, b = "10.0.0.1", "10.0.0.2"
    rows = [(i, syn("192.0.2.66", "198.51.100.7", 40000 + i, 1000 + i)) for i in range(15)]
    rows += [(3, B.arp(2, "aa:aa:aa:aa:aa:01", "10.0.0.5", "00:00:00:00:00:00", "10.0.0.1"))]
    rows += [(20, syn(a, b, 1, 2)), (40, syn(b, a, 2, 1, 4)), (100, syn(a, b, 1, 2, 0x10)), (101, syn(a, b, 9, 9, 0x10))]
    rows.sort(key=lambda r: r[0])
    ticks, state, out = [30], str(tmp_path / "state"), str(tmp_path / "out")
    alerts, before = [], 0
    for t in ticks:  # a new sensor each time: it goes on from the state folder
        own = [r for r in rows if before <= r[0] < t]
        alerts += Sensor(spark, state, out).tick(capture(spark, own), t).collect()
        before = t
    last = Sensor(spark, state, out)
    own = [r for r in rows if r[0] >= before]
    alerts += last.tick(capture(spark, own), 102).collect() + last.finish(110).collect()
    assert [r.name for r in alerts] == ["new-device", "port-scan"]
    got = read_events(spark, out).persist()
    whole = conn_events(flows_with_ticks(layers(capture(spark, rows)), [*ticks, 102]))
    key = ["ts", "duration", "end_reason", "conn_state", "src", "src_port", "pkts_a_to_b", "pkts_b_to_a", "bytes_a_to_b"]
    flows = lambda df: sorted(map(repr, df.select(*key).collect()))
    assert flows(got.where("event = 'conn'")) == flows(whole)
    beats = got.where("event = 'heartbeat'").orderBy("ts").collect()
    assert [(r.ts, r.total_frames, r.active_flows) for r in beats] == [(30, 17, 16), (102, 20, 1)]
    told = got.where("event <> 'alert'").orderBy("seq").collect()
    assert all(r.uid == f"{r.event}{i}" for i, r in enumerate(told, 1) if r.event != "heartbeat")
    assert [r.events_emitted for i, r in enumerate(told, 1) if r.event == "heartbeat"] == [i for i, r in enumerate(told, 1) if r.event == "heartbeat"]
    (device,) = load_inventory(spark, last.told["devices"])[0].collect()
    assert (device.sender_mac, device.last_ip) == ("aa:aa:aa:aa:aa:01", "10.0.0.5")


def test_sensor_blind_alerts(spark, tmp_path):
    sensor = Sensor(spark, str(tmp_path / "state"), str(tmp_path / "out"))
    told = {"last_frame": 10.0, "blind_at": None}
    got = [(t, df and df.first().message) for t in (609, 610, 700, 2409, 2410) for df in [sensor._blind(told, t * 1.0)]]
    assert got == [(609, None), (610, "zero frames for 600s"), (700, None), (2409, None), (2410, "zero frames for 2400s")]


def test_sweep_leaves_the_newest(spark, tmp_path):
    for n in ("events-1", "events-2", "events-3", "other-1"):
        (tmp_path / f"{n}.ndjson").write_text("{}")
    assert sweep(spark, str(tmp_path), "events", now=4e9) == 0
    assert sweep(spark, str(tmp_path), "events", now=4e9, max_age=1.0) == 2
    assert sorted(f.name for f in tmp_path.glob("*.ndjson")) == ["events-3.ndjson", "other-1.ndjson"]


def test_inventory_file(spark, tmp_path):
    assert load_inventory(spark, str(tmp_path / "none"))[0].count() == 0
    devices = spark.createDataFrame([("m", 1.0, 2.0, "10.0.0.1")], "sender_mac string, first_seen double, last_seen double, last_ip string")
    for _ in range(2):
        save_inventory(devices, str(tmp_path / "d"))
    assert load_inventory(spark, str(tmp_path / "d"))[0].collect() == devices.collect()
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text("{nothing\n")
    got, error = load_inventory(spark, str(tmp_path / "bad"))
    assert got.count() == 0 and error.startswith(str(tmp_path / "bad"))


def scan(n=15, src="s"):
    return [conn(i, port=1000 + i, src=src) for i in range(n)]


def test_live_ticks_and_cooldown(spark, tmp_path):
    live = LiveDetector(spark, str(tmp_path / "a"))
    live.push(events(spark, scan()))
    assert [len(live.tick(t).collect()) for t in (14, 20, 313.9, 314)] == [1, 0, 0, 1]
    two = LiveDetector(spark, str(tmp_path / "b"))
    two.push(events(spark, scan() + scan(src="t")))
    assert two.tick(14).count() == 2


def test_live_state_survives_a_restart(spark, tmp_path):
    live = LiveDetector(spark, str(tmp_path / "a"))
    live.push(events(spark, scan()))
    assert [r.uid for r in live.tick(14).collect()] == ["alert1"]
    again = LiveDetector(spark, str(tmp_path / "a"))
    assert again.tick(20).count() == 0  # still cooling down
    again.push(events(spark, scan(src="t")))
    third = LiveDetector(spark, str(tmp_path / "a"))
    assert [(r.uid, r.src) for r in third.tick(21).collect()] == [("alert4", "t")]


def test_ipv6_text(spark):
    import ipaddress
    import random

    r = random.Random(6)
    raw = [bytes(16), b"\0" * 15 + b"\1", b"\1" + bytes(15), b"\0" * 10 + b"\xff\xff\1\2\3\4"]
    raw += [b"".join(r.choice((b"\0\0", b"\0\0", b"\0\7", b"\x12\x30")) for _ in range(8)) for _ in range(300)]
    df = spark.createDataFrame([(bytearray(x),) for x in raw] + [(bytearray(b"abc"),), (None,)], "raw binary")
    got = [x.t for x in df.select(ipv6_text(F.col("raw")).alias("t")).collect()]
    assert got == [str(ipaddress.IPv6Address(x)) for x in raw] + [None, None]


def test_live_window_slides(spark, tmp_path):
    live = LiveDetector(spark, str(tmp_path / "a"))
    live.push(events(spark, scan() + [{"event": "heartbeat", "ts": 1000.0}]))
    assert live.tick(1000).count() == 0


def test_window_is_emptied_from_its_front_only(spark):
    rows = spark.createDataFrame([(i, int(t * 1e6)) for i, t in enumerate([100, 0, 50, 205, 10, 104])], "seq long, ts_us long")
    assert sorted(r.seq for r in slid(rows, 100).collect()) == [3, 4, 5]
    assert sorted(r.seq for r in slid(rows, 1000, most=2).collect()) == [4, 5]


def test_stream_equals_batch(spark, tmp_path):
    events(spark, scan()).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    got = []
    q = live_query(stream, LiveDetector(spark, str(tmp_path / "state")), lambda df, i: got.extend(df.collect()), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert [(r.name, r.ts) for r in got] == [("port-scan", 14.0)]


def test_keyed_cooldown_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("n", "a", int(t * 1e6)) for t in (0, 100, 299.9, 300, 700)] + [("n", "b", 5)]
    spark.createDataFrame(rows, "name string, src string, ts_us long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("name string, src string, ts_us long").parquet(str(tmp_path / "in"))
    try:
        q = keyed_cooldown(stream, 300).writeStream.format("memory").queryName("cooled").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted((r.src, r.ts_us // 10**6) for r in spark.table("cooled").collect()) == [("a", 0), ("a", 300), ("a", 700), ("b", 0)]
