import json
import struct

import pytest
from pyspark.sql import functions as F

from netlens.operators import store as Q
from netlens.operators.inventory import blind_alerts, inventory, new_devices
from netlens.plans.chains import byte_cuts
from netlens.report import ALERTS, alert_lines, flow_lines, heartbeat_line, table_text
from netlens.schema import of_kind, to_json
from netlens.sources.capture import read_captures, read_synthetic
from netlens.sources.config import load_config
from netlens.sources.demo import demo_events, demo_watchlist, write_demo
from netlens.sources.ndjson import InvalidEvent, read_events, read_watchlist
from netlens.sources.sinks import retention_victims, write_alerts, write_events

from .test_detections import claim, conn, events


def alert(ts, name="port-scan", severity="medium"):
    return {"event": "alert", "ts": float(ts), "name": name, "severity": severity, "src": "s", "dst": None, "message": "m", "evidence": ["u"]}


def full(ts, **more):
    return conn(ts) | {"duration": 1.0, "conn_state": "SF", "end_reason": "fin", "src_port": 1, "pkts_a_to_b": 1, "bytes_a_to_b": 2, "pkts_b_to_a": 3, "bytes_b_to_a": 4} | more


def test_flow_and_alert_queries(spark):
    rows = events(spark, [full(100.0, src="a", dst="b"), alert(100), full(50.0, src="b", dst="c"), alert(101, "arp-spoof", "high")])
    seqs = lambda df: [r.seq for r in df.collect()]
    assert seqs(Q.query_flows(rows)) == [0, 2]
    assert seqs(Q.query_flows(rows, since=100.0)) == [0] and seqs(Q.query_flows(rows, since=100.5)) == []
    assert seqs(Q.query_flows(rows, host="b")) == [0, 2] and seqs(Q.query_flows(rows, host="c")) == [2] and seqs(Q.query_flows(rows, host="x")) == []
    assert seqs(Q.query_alerts(rows)) == [1, 3] and seqs(Q.query_alerts(rows, name="arp-spoof")) == [3]
    assert seqs(Q.query_alerts(rows, min_severity="high")) == [3] and seqs(Q.query_alerts(rows, since=101)) == [3]
    assert Q.count_events(rows).first().n == 4
    assert seqs(Q.recent_flows(rows, 1)) == [0]
    assert [r.ts for r in Q.recent_alerts(rows, events(spark, [alert(300), alert(101)])).collect()] == [300.0, 101.0, 101.0, 100.0]


def test_latest_heartbeat_is_last_in_order(spark):
    beat = lambda ts: {"event": "heartbeat", "ts": float(ts), "total_frames": 1, "bytes": 2, "active_flows": 3, "events_emitted": 4}
    assert Q.latest_heartbeat(events(spark, [beat(300), full(1), beat(200)])).first().ts == 200.0
    assert Q.latest_heartbeat(events(spark, [full(1)])).count() == 0


def test_since_from_last():
    assert Q.since_from_last("10m", 1000.0) == 400.0 and Q.since_from_last("1h", 10.0) == 0 and Q.since_from_last(None, 5) is None
    with pytest.raises(ValueError):
        Q.since_from_last("1x", 5)


def test_ndjson_round_trip_in_order(spark, tmp_path):
    write_demo(spark, f"{tmp_path}/demo")
    rows = read_events(spark, f"{tmp_path}/demo")
    assert [r.value for r in to_json(rows).orderBy("seq").collect()] == [r.value for r in to_json(demo_events(spark)).orderBy("seq").collect()]
    assert read_watchlist(spark, f"{tmp_path}/demo/watchlist.txt") == demo_watchlist() == ["nasty.example", "evilsite.example"]


GOOD = {"event": "arp", "uid": "a", "ts": 1.0, "src": "s", "sender_mac": "m", "target_ip": "t", "target_mac": None, "op": "reply", "is_gratuitous": False, "extra": 1}


@pytest.mark.parametrize("change", ["not json", "[]", {"event": "nope"}, {"event": None}, {"uid": None}, {"ts": "1"}, {"is_gratuitous": 1}, {"op": 5}])
def test_bad_lines(spark, tmp_path, change):
    bad = change if isinstance(change, str) else json.dumps({k: v for k, v in (GOOD | change).items() if v is not None})
    (tmp_path / "b.ndjson").write_text("\n" + json.dumps(GOOD) + "\n\n" + bad + "\n")
    (tmp_path / "a.ndjson").write_text(json.dumps(GOOD) + "\n")
    (tmp_path / "notes.txt").write_text("not read")
    with pytest.raises(InvalidEvent, match=r"b\.ndjson:4: invalid event"):
        read_events(spark, str(tmp_path))
    assert read_events(spark, str(tmp_path), strict=False).where("error is null").count() == 2


@pytest.mark.parametrize("port,ok", [(65535, True), (65536, False), (-1, False), (None, True), (1.5, False)])
def test_port_range(spark, tmp_path, port, ok):
    row = {k: v for k, v in full(1.0).items()} | {"uid": "c", "dst_port": port}
    (tmp_path / "a.ndjson").write_text(json.dumps(row))
    assert (read_events(spark, str(tmp_path), strict=False).where("error is null").count() == 1) == ok


def test_new_devices_and_inventory(spark):
    rows = events(spark, [claim(100, "a"), claim(100.5, "b"), claim(100.9, "c"), claim(161, "d"), claim(300, "a", src="10.0.0.9")])
    assert [(r.ts, r.evidence) for r in new_devices(rows).orderBy("seq").collect()] == [(100.0, ["arp0"]), (161.0, ["arp3"])]
    assert len(new_devices(events(spark, [claim(0, "a"), claim(59.9, "b"), claim(60, "c")])).collect()) == 2
    known = inventory(rows)
    got = {r.sender_mac: (r.first_seen, r.last_seen, r.last_ip) for r in known.collect()}
    assert got["a"] == (100.0, 300.0, "10.0.0.9") and len(got) == 4
    again = events(spark, [claim(900, "a"), claim(901, "z")])
    assert [r.evidence for r in new_devices(again, known=known).collect()] == [["arp1"]]
    assert inventory(again, known).where("sender_mac = 'a'").first().first_seen == 100.0


def test_blind(spark):
    beats = spark.createDataFrame([(float(60 * i), 10 if i > 2 else 3 * i) for i in range(60)], "ts double, total_frames long")
    assert [r.ts for r in blind_alerts(beats).orderBy("ts").collect()] == [780.0, 2580.0]


def test_captures(spark, tmp_path):
    head = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    frames = [b"x" * 20, b"y" * 70]
    body = b"".join(struct.pack("<4I", 100 + i, 5, len(f), len(f) + 4) + f for i, f in enumerate(frames))
    (tmp_path / "ok").mkdir()
    (tmp_path / "ok/a.pcap").write_bytes(head + body)
    rows = read_captures(spark, f"{tmp_path}/ok").orderBy("frame_no").collect()
    assert [(r.frame_no, r.wire_len, bytes(r.data)) for r in rows] == [(0, 24, frames[0]), (1, 74, frames[1])]
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut/a.pcap").write_bytes(head + body[:-1])
    with pytest.raises(Exception, match="record 1 is cut"):
        read_captures(spark, f"{tmp_path}/cut").count()


def test_synthetic_frames(spark):
    rows = read_synthetic(spark, seed=7, frames=600).collect()
    again = read_synthetic(spark, seed=7, frames=600).collect()
    assert rows == again and all(60 <= len(r.data) <= 400 for r in rows)
    kinds = [bytes(r.data[12:14]).hex() for r in rows]
    assert 0.75 < kinds.count("0800") / 600 < 0.95 and "86dd" in kinds and "0806" in kinds
    assert sum(bytes(r.data[26:30]) == bytes([192, 0, 2, 66]) for r in rows) == 15


def test_sinks(spark, tmp_path):
    rows = demo_events(spark)
    names = write_events(rows, f"{tmp_path}/out", max_bytes=2000)
    assert len(names) > 3 and sorted(p.name for p in (tmp_path / "out").glob("*.ndjson")) == names
    assert read_events(spark, f"{tmp_path}/out").count() == 40
    Q.import_events(rows, f"{tmp_path}/table")
    assert spark.read.parquet(f"{tmp_path}/table").where("event = 'conn'").count() == 26
    from netlens.operators.detections import RuleEngine

    write_alerts(RuleEngine().alerts(rows), f"{tmp_path}/alerts")
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/alerts").collect()]
    assert [x["uid"] for x in lines] == ["alert1", "alert2", "alert3", "alert4"] and lines[3]["dst"] is None


@pytest.mark.parametrize("most", [10, 700, 1500])
def test_files_end_where_a_sequential_writer_ends_them(spark, tmp_path, most):
    """A new file when the next line does not fit; an oversize line alone."""
    from netlens.schema import to_json

    rows = demo_events(spark).repartition(7)
    write_events(rows, f"{tmp_path}/out", most, "events")
    want, held = [], 0
    for r in to_json(rows).orderBy("seq").collect():
        line = r.value + "\n"
        if not want or (held > 0 and held + len(line.encode()) > most):
            want.append("")
            held = 0
        want[-1] += line
        held += len(line.encode())
    assert [p.read_text() for p in sorted((tmp_path / "out").glob("*.ndjson"))] == want


def test_lines_of_a_file_are_in_order_however_they_arrive(spark, tmp_path, monkeypatch):
    """A file's lines come from several tasks, whose blocks arrive in any order."""
    from netlens.sources import sinks

    monkeypatch.setattr(sinks, "byte_cuts", lambda *a: byte_cuts(*a).orderBy(F.desc("seq")).checkpoint())
    write_events(demo_events(spark), f"{tmp_path}/out", 4000)
    assert [r.uid for r in read_events(spark, f"{tmp_path}/out").orderBy("seq").collect()] == [r.uid for r in demo_events(spark).orderBy("seq").collect()]


def test_a_lost_write_leaves_nothing_to_the_next(spark, tmp_path, monkeypatch):
    """A driver lost between the write and the moves, or in the midst of them, then the same or another write."""
    from netlens.sources import sinks

    rows, out, real = demo_events(spark), tmp_path / "out", sinks._files

    def files(spark, path):
        raise InterruptedError

    monkeypatch.setattr(sinks, "_files", files)
    for prefix in ("a", None):
        with pytest.raises(InterruptedError):
            write_events(rows, str(out), 2000, prefix)
    monkeypatch.setattr(sinks, "_files", real)
    assert not list(out.glob("*.ndjson"))
    write_events(rows.where("seq <= 5"), str(out), 2000, "b")
    assert read_events(spark, str(out)).count() == 5
    write_events(rows, str(out), 2000, "a")
    (out / sorted(p.name for p in out.glob("a-*"))[0]).unlink()  # half moved
    write_events(rows, str(out), 2000, "a")
    assert read_events(spark, str(out)).count() == 45


def test_retention(spark):
    rows = [("events-1-0001.ndjson", 100, 10), ("events-2-0001.ndjson", 200, 10), ("events-3-0001.ndjson", 300, 10), ("events-4-0001.ndjson", 400, 10), ("other.txt", 0, 99)]
    files = spark.createDataFrame(rows, "name string, modified long, size long")
    got = {r.name for r in retention_victims(files, "events", now=450, max_age=250, max_bytes=20, current="events-4-0001.ndjson").collect()}
    assert got == {"events-1-0001.ndjson", "events-2-0001.ndjson"}


def test_report(spark):
    rows = events(spark, [full(1.5, src="10.0.0.1", dst="10.0.0.2", src_port=None), alert(2)])
    (line,) = [r.line for r in flow_lines(of_kind(rows, "conn")).collect()]
    assert line == "1.5          tcp    SF     fin     10.0.0.1:- -> 10.0.0.2:443      1p/     2B     3p/     4B 1.000s"
    assert table_text(alert_lines(of_kind(rows, "alert")), ALERTS).split("\n")[1] == "2            medium   port-scan      s -> -  m"
    assert heartbeat_line(Q.latest_heartbeat(demo_events(spark))).first().line == "heartbeat ts=1770000600 frames=4200 bytes=2400000 active_flows=3 events=40"


def test_config(tmp_path):
    (tmp_path / "c.toml").write_text("[detect]\nwindow = 30\nunknown = 1\n[retention]\nmax_bytes = 5\n")
    c = load_config(str(tmp_path / "c.toml"), window=None, max_age=9)
    assert (c.window, c.max_bytes, c.max_age, c.gap) == (30, 5, 9, 300.0)
    assert load_config(str(tmp_path / "c.toml"), window=10).window == 10
