"""Readers by byte ranges: capture files in slices, and files that grow."""

import random
import struct

import pytest

from netlens.sources.capture import capture_records, capture_slices, read_captures
from netlens.sources.follow import GrowingLines
from netlens.schema import to_json
from netlens.sources.ndjson import InvalidEvent, follow_events, read_events, read_lines
from netlens.sources.ranges import last_line_end, lines_in, listed

HEAD = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)


def record(i, data):
    return struct.pack("<4I", 100 + i, i % 1000, len(data), len(data)) + data


def capture_file(seed, n=120):
    """Frames among which some hold whole captures, so that places inside them look like record starts."""
    r = random.Random(seed)
    frames = [r.randbytes(r.randrange(0, 80)) for _ in range(n)]
    frames += [b"".join(record(k, bytes(r.randrange(40))) for k in range(30)), bytes(300), r.randbytes(2000)]
    r.shuffle(frames)
    return HEAD + b"".join(record(i, f) for i, f in enumerate(frames))


@pytest.mark.parametrize("size", [250, 5000, 1 << 20])
def test_slices_equal_the_sequential_reader(spark, tmp_path, size):
    for name in ("a", "b"):
        (tmp_path / f"{name}.pcap").write_bytes(capture_file(size + ord(name)))
    got = {}
    for r in read_captures(spark, str(tmp_path), size).collect():
        got.setdefault(r.path[-6:], []).append((r.frame_no, r.ts.timestamp(), r.wire_len, bytes(r.data)))
    for name in ("a.pcap", "b.pcap"):
        want = [(no, ts.timestamp(), wire, data) for no, ts, wire, data in capture_records((tmp_path / name).read_bytes())]
        assert sorted(got[name]) == want
    slices = capture_slices(spark, listed(str(tmp_path)), str(tmp_path), size)
    assert len(slices) > 3 or size > 5000


@pytest.mark.parametrize("cut", [1, 10, 17])
def test_a_cut_record_is_an_error_in_any_slice(spark, tmp_path, cut):
    raw = HEAD + b"".join(record(i, b"z" * 30) for i in range(40))
    (tmp_path / "a.pcap").write_bytes(raw[:-cut] if cut < 17 else raw + bytes(5))
    with pytest.raises(Exception, match="record 39 is cut" if cut < 17 else "record 40 is cut"):
        read_captures(spark, str(tmp_path), 200).count()
    (tmp_path / "a.pcap").write_bytes(b"nothing")
    with pytest.raises(Exception, match="not a capture file"):
        read_captures(spark, str(tmp_path), 200).count()


@pytest.mark.parametrize("size", [1, 3, 7, 50])
def test_lines_of_ranges(tmp_path, size):
    raw = b"one\n\ntwo\xff\nthree is longer\n" + b"x" * 40 + b"\nno end"
    (tmp_path / "f").write_bytes(raw)
    limit = raw.rfind(b"\n") + 1
    with open(tmp_path / "f", "rb") as f:
        assert last_line_end(f, 0, len(raw), 5) == limit and last_line_end(f, limit, len(raw), 5) == limit
        got = [x for at in range(0, limit, size) for x in lines_in(f, at, min(at + size, limit), limit, 4)]
    want, at = [], 0
    for line in raw[:limit].split(b"\n")[:-1]:
        want.append((at, line))
        at += len(line) + 1
    assert got == want


def test_following_a_folder_that_grows(spark, tmp_path):
    """Lines added to a known file come once, also over a restart; a line without its end waits."""
    src, out = tmp_path / "in", []
    src.mkdir()
    spark.dataSource.register(GrowingLines)

    def run(*steps):
        lines = spark.readStream.format("growing_lines").option("path", str(src)).option("slice", 7).load()
        q = lines.writeStream.foreachBatch(lambda df, i: out.extend((r.path[-1], r.start, r.value) for r in df.collect())).option("checkpointLocation", str(tmp_path / "ck")).start()
        for step in steps:
            step()
            q.processAllAvailable()
        q.stop()
        got = sorted(out)
        out.clear()
        return got

    def add(name, text):
        return lambda: (src / f"{name}.ndjson").open("ab").write(text)

    (src / "other.txt").write_text("not this\n")
    assert run(add("a", b"one\ntwo\nthr"), add("a", b"ee\n\nfour"), add("b", b"b1\n")) == [("n", 0, "b1"), ("n", 0, "one"), ("n", 4, "two"), ("n", 8, "three")]
    add("a", b" goes on\nhi \xff there\n")()
    assert run(lambda: None, add("b", b"b2\nb3 which is much longer than a slice\nb4")) == [("n", 3, "b2"), ("n", 6, "b3 which is much longer than a slice"), ("n", 15, "four goes on"), ("n", 28, "hi � there")]
    assert run(lambda: None) == []
    assert run(lambda: (src / "a.ndjson").unlink(), add("b", b"!\n")) == [("n", 43, "b4!")]


def test_followed_events(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text('{"event":"heartbeat","ts":1.5,"total_frames":1,"bytes":2,"active_flows":0,"events_emitted":1}\n{"event":"none"}\n')
    q = follow_events(spark, str(tmp_path)).writeStream.format("memory").queryName("followed").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.ts, r.error is None) for r in spark.table("followed").orderBy("place").collect()] == [(1.5, True), (None, False)]


@pytest.mark.parametrize("size", [1, 2, 7, 64, 1 << 20])
def test_numbered_lines_of_slices_equal_a_loop(spark, tmp_path, size):
    """Lines longer than slices, blank ones, a file without a last line feed, an empty one, cuts in characters of many bytes."""
    r = random.Random(size)
    bits = ["", " ", "\t", "{}", "é日", "x" * 40, "a\rb", "\u2028"]
    want, seq = [], 0
    for n in range(3 if size < 7 else 30):
        text = "\n".join(r.choices(bits, k=r.randint(0, 12))) + "\n" * r.randint(0, 2)
        (tmp_path / f"{n:02}.ndjson").write_bytes(text.encode())
        lines = text.split("\n")[: None if text and not text.endswith("\n") else -1]
        want += [(f"{n:02}.ndjson", i, seq + i, line) for i, line in enumerate(lines, 1) if line.strip(" \t\r\n")]
        seq += len(lines)
    (tmp_path / "notes.txt").write_text("not read")
    got = read_lines(spark, str(tmp_path), size).collect()
    assert sorted((x.path.rsplit("/", 1)[1], x.line_no, x.seq, x.value) for x in got) == want
    assert read_lines(spark, str(tmp_path / "00.ndjson"), size).count() == sum(w[0] == "00.ndjson" for w in want)


def test_a_bad_line_far_into_a_file_is_told_by_its_number(spark, tmp_path):
    good = '{"event":"heartbeat","ts":1.5,"total_frames":1,"bytes":2,"active_flows":0,"events_emitted":1}\n'
    (tmp_path / "a.ndjson").write_text(good * 4000 + "\n\n" + "{}\n" + good * 4000)
    with pytest.raises(InvalidEvent, match=r"a\.ndjson:4003: invalid event"):
        read_events(spark, f"file://{tmp_path}", size=10_000)
    rows = read_events(spark, str(tmp_path), strict=False, size=10_000)
    assert rows.where("error is null").count() == 8000 and rows.where("error is not null").collect()[0].seq == 4003
    assert rows.rdd.getNumPartitions() > 50


def test_a_folder_without_lines(spark, tmp_path):
    assert read_lines(spark, str(tmp_path)).collect() == []
    with pytest.raises(FileNotFoundError):
        read_lines(spark, str(tmp_path / "gone"))
    (tmp_path / "a.ndjson").write_text("")
    assert read_events(spark, str(tmp_path)).collect() == []


def test_plain_records_pass_without_the_rules(spark):
    """Only lines that one pattern and the parsed columns cannot clear go through the rules, which take some 170 us each."""
    from netlens.sources.demo import demo_events
    from netlens.sources.ndjson import checked, suspects

    good = to_json(demo_events(spark)).select("value")
    assert suspects(good).count() == 0
    record = '{"event":"alert","uid":"u","ts":1.5,"name":"n","severity":"low","src":"s","dst":null,"message":"m","evidence":["u"]}'
    changes = [("1.5", "1e400"), ('"low"', '"urgent"'), ('["u"]', '["u",null]'), ('["u"]', "[null]"), ('"s"', "1"), ('"uid":"u",', ""), ('"m"', "null"), ('"dst":null', '"dst":1'), ('"alert"', '"x"')]
    bad = [record.replace(a, b) for a, b in changes]
    conn = '{"event":"conn","uid":"u","ts":1,"duration":0.5,"proto":"tcp","conn_state":"SF","end_reason":"fin","src":"s","dst":"d","src_port":null,"pkts_a_to_b":1,"bytes_a_to_b":1,"pkts_b_to_a":1,"bytes_b_to_a":1}'
    bad += [conn.replace("null", x) for x in ("65536", "-1", "1.5", '"1"', "9223372036854775808")]
    rows = spark.createDataFrame([(x,) for x in [record, conn, *bad]], "value string")
    assert suspects(rows).count() == len(bad) and checked(rows).where("error is null").count() == 2
