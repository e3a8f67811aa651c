import json
import pathlib

import pytest
from pyspark.sql import functions as F

from netlens.operators.detections import ArpSpoof, Beaconing, DnsTunnel, PortScan, RuleEngine, SniWatch, with_evidence
from netlens.schema import COLUMNS, envelope, to_json
from netlens.sources.demo import demo_events, demo_watchlist


def events(spark, rows):
    """Rows as dicts; seq is their order, uid their kind and number unless given."""
    full = []
    names = [f.name for f in envelope().fields]
    for i, r in enumerate(rows):
        r = {"uid": f"{r['event']}{i}", "evidence": None, "answers": None} | r
        full.append((i, *[r.get(n) for n in names]))
    from pyspark.sql import types as T

    return spark.createDataFrame(full, T.StructType([T.StructField("seq", T.LongType()), *envelope().fields]))


def conn(ts, dst="d", port=443, src="s", proto="tcp"):
    return {"event": "conn", "ts": float(ts), "src": src, "dst": dst, "dst_port": port, "proto": proto}


def dns(ts, query, qtype=1, src="s", dst="d"):
    return {"event": "dns", "ts": float(ts), "src": src, "dst": dst, "query": query, "qtype": qtype}


def claim(ts, mac, src="10.0.0.5", gratuitous=False):
    return {"event": "arp", "ts": float(ts), "src": src, "sender_mac": mac, "is_gratuitous": gratuitous}


def found(df):
    return [r.asDict() for r in df.orderBy("sub", "k1", "k2", "kn").collect()]


@pytest.mark.parametrize("n,step,fires", [(15, 1, 1), (14, 1, 0), (15, 120, 0)])
def test_vertical(spark, n, step, fires):
    out = found(PortScan().vertical(events(spark, [conn(i * step, port=1000 + i) for i in range(n)])))
    assert len(out) == fires
    if fires:
        assert out[0]["ts"] == 14.0 and out[0]["evidence"] == [f"conn{i}" for i in range(10)] and out[0]["message"] == "15 distinct ports on d within 60s"


def test_vertical_bounds_ties_and_order(spark):
    inside = [conn(0 if i < 7 else 60, port=i) for i in range(15)]
    assert len(found(PortScan().vertical(events(spark, inside[::-1])))) == 1
    outside = [conn(0 if i < 7 else 60.001, port=i) for i in range(15)]
    assert not found(PortScan().vertical(events(spark, outside)))
    # equal windows: the earliest start wins; null ports and other protocols do not count
    twice = [conn(i, port=i) for i in range(15)] + [conn(500 + i, port=i) for i in range(15)] + [conn(3, port=None), conn(4, port=99, proto="icmp")]
    (only,) = found(PortScan().vertical(events(spark, twice)))
    assert only["ts"] == 14.0 and only["message"].startswith("15 ")


def test_horizontal(spark):
    (only,) = found(PortScan().horizontal(events(spark, [conn(i, dst=f"h{i:02d}", port=444) for i in range(30)])))
    assert only["ts"] == 29.0 and only["dst"] is None and only["message"] == "30 hosts contacted on port 444 within 60s"
    assert not found(PortScan().horizontal(events(spark, [conn(i, dst=f"h{i}", port=444) for i in range(29)])))


@pytest.mark.parametrize("times,fires", [([0, 60, 120, 180, 240], 1), ([0, 60, 200, 240, 500], 0), ([0, 60, 120, 180], 0), ([0, 2, 4, 6, 8], 0), ([0, 10, 20, 30, 40], 1), ([0, 3600, 7200, 10800, 14400], 1), ([0, 3601, 7202, 10803, 14404], 0), ([0, 8, 20, 30, 40], 1), ([0, 7.9, 20, 30, 40], 0)])
def test_beacon(spark, times, fires):
    out = found(Beaconing().detect(events(spark, [conn(t) for t in times])))
    assert len(out) == fires
    if fires and times[1] == 60:
        assert out[0]["ts"] == 240.0 and out[0]["message"] == "5 flows to d:443 at ~60.0s intervals"


def test_two_beacons_in_order(spark):
    rows = [conn(60 * i, dst="b") for i in range(5)] + [conn(90 * i, dst="a") for i in range(5)]
    assert [r["dst"] for r in found(Beaconing().detect(events(spark, rows)))] == ["a", "b"]


def test_long_labels(spark):
    rows = [dns(1, "a" * 60 + ".x."), dns(2, "b" * 50 + ".x."), dns(3, "c" * 45 + ".x."), dns(4, None)]
    (only,) = found(DnsTunnel().long_labels(events(spark, rows)))
    assert only["message"] == "dns label of 60 chars from s" and only["ts"] == 2.0 and only["evidence"] == ["dns0", "dns1"]
    assert len(found(DnsTunnel().long_labels(events(spark, [dns(0, "a" * 46)])))) == 1
    assert not found(DnsTunnel().long_labels(events(spark, [dns(0, "a" * 45)])))


def test_txt_flood(spark):
    (only,) = found(DnsTunnel().txt_flood(events(spark, [dns(i, f"q{i}", 16) for i in range(20)])))
    assert only["message"] == "20 txt queries within 60s" and len(only["evidence"]) == 10
    assert not found(DnsTunnel().txt_flood(events(spark, [dns(120 * i, f"q{i}", 16) for i in range(20)])))
    assert not found(DnsTunnel().txt_flood(events(spark, [dns(i, f"q{i}", 1) for i in range(20)])))
    # a name counts at its first occurrence only
    early = [dns(0, "q0", 16)] + [dns(1000 + i, f"q{i}", 16) for i in range(20)]
    assert not found(DnsTunnel().txt_flood(events(spark, early)))


def test_arp(spark):
    (only,) = found(ArpSpoof().conflicts(events(spark, [claim(i, f"m{i % 2}") for i in range(4)])))
    assert only["src"] == "10.0.0.5" and only["dst"] is None and only["message"] == "10.0.0.5 claimed by 2 macs within 300s" and only["ts"] == 3.0
    assert not found(ArpSpoof().conflicts(events(spark, [claim(0, "m0"), claim(301, "m1")])))
    assert len(found(ArpSpoof().conflicts(events(spark, [claim(0, "m0"), claim(300, "m1")])))) == 1
    storm = [claim(i, "m", src=f"10.0.0.{i}", gratuitous=True) for i in range(10)]
    (only,) = found(ArpSpoof().storms(events(spark, storm)))
    assert only["src"] == "10.0.0.9" and only["message"] == "10 gratuitous arps from m within 10s"
    assert not found(ArpSpoof().storms(events(spark, storm[:9])))


def test_sni(spark):
    ssl = lambda ts, sni, src="s": {"event": "ssl", "ts": float(ts), "src": src, "dst": "d", "sni": sni}
    run = lambda rows, *d: found(SniWatch(list(d)).detect(events(spark, rows)))
    assert len(run([ssl(1, "evil.example")], "evil.example")) == 1
    assert len(run([ssl(1, "a.b.evil.example")], "evil.example")) == 1
    assert not run([ssl(1, "notevil.example"), ssl(2, None)], "evil.example")
    assert not run([ssl(1, "evil.example")])
    (only,) = run([ssl(5, "EVIL.example"), ssl(1, "x.Evil.Example")], "Evil.EXAMPLE")
    assert only["ts"] == 5.0 and only["evidence"] == ["ssl0", "ssl1"]
    (only,) = run([ssl(1, "a.evil.example")], "a.evil.example", "evil.example")
    assert only["k2"] == "a.evil.example"


def test_demo_gives_the_expected_alerts(spark):
    rows = demo_events(spark)
    assert {r.event: r["count"] for r in rows.groupBy("event").count().collect()} == {"conn": 26, "dns": 8, "arp": 4, "ssl": 1, "heartbeat": 1}
    out = RuleEngine().register(SniWatch(demo_watchlist())).alerts(rows).orderBy("no").collect()
    short = [(r.uid, r.ts, r.name, r.severity, r.src, r.dst, r.message, r.evidence) for r in out]
    assert short == [
        ("alert1", 1770000114.0, "port-scan", "medium", "192.0.2.66", "198.51.100.7", "15 distinct ports on 198.51.100.7 within 60s", [f"conn{i}" for i in range(13, 23)]),
        ("alert2", 1770000440.0, "beaconing", "high", "192.0.2.66", "198.51.100.99", "5 flows to 198.51.100.99:443 at ~60.0s intervals", [f"conn{i}" for i in range(28, 33)]),
        ("alert3", 1770000301.0, "dns-tunnel", "high", "192.0.2.20", "198.51.100.7", "dns label of 60 chars from 192.0.2.20", ["dns33", "dns34"]),
        ("alert4", 1770000403.0, "arp-spoof", "high", "10.0.0.5", None, "10.0.0.5 claimed by 2 macs within 300s", [f"arp{i}" for i in range(35, 39)]),
        ("alert5", 1770000500.0, "sni-watchlist", "medium", "192.0.2.66", "198.51.100.9", "192.0.2.66 connected to watched domain evilsite.example", ["ssl39"]),
    ]
    joined = with_evidence(RuleEngine().alerts(rows), rows)
    assert joined.where("alert_uid = 'alert2'").count() == 5


def test_numbers_go_on(spark):
    rows = events(spark, [conn(i, port=1000 + i) for i in range(15)] + [conn(60 * i, dst="b") for i in range(5)])
    engine = RuleEngine()
    assert [r.uid for r in engine.run(rows).orderBy("no").collect()] == ["alert1", "alert2"]
    assert [r.uid for r in engine.run(rows).orderBy("no").collect()] == ["alert3", "alert4"]


def test_nothing_from_nothing(spark):
    assert RuleEngine().alerts(events(spark, [conn(0)]).limit(0)).count() == 0


def test_json_has_all_fields_and_nulls(spark):
    rows = to_json(demo_events(spark)).orderBy("seq").collect()
    for r in rows:
        x = json.loads(r.value)
        assert list(x) == ["event", *[n for n, _, _ in COLUMNS[x["event"]]]]
    assert json.loads(rows[-1].value)["events_emitted"] == 40
