"""A sensor or detector whose driver is lost after any step, and a sensor without frames."""

import datetime
import shutil

import pytest

from netlens.sources.capture import FRAMES
from netlens.sources.ndjson import read_events
from netlens.streaming import live, sensor
from netlens.streaming.live import LiveDetector, live_query
from netlens.streaming.sensor import Sensor, clock, sensor_query

from . import frames as B
from .test_detections import events
from .test_frames_and_live import capture, scan, syn


class Lost(Exception):
    pass


def losing(monkeypatch, after):
    """From now on the driver is lost once so many durable steps are done."""
    done = []

    def wrapped(real):
        def step(*a, **b):
            out = real(*a, **b)
            done.append(real.__name__)
            if len(done) == after:
                raise Lost
            return out

        return step

    for where, name in ((Sensor, "_saved"), (LiveDetector, "_saved"), (sensor, "write_events"), (sensor, "save_inventory"), (sensor, "forget"), (live, "forget")):
        monkeypatch.setattr(where, name, wrapped(getattr(where, name)))
    return done


def files(out):
    return {p.name: p.read_text() for p in out.glob("*.ndjson")}


FIRST = [(i, syn("192.0.2.66", "198.51.100.7", 40000 + i, 1000 + i, 4)) for i in range(9)]
SECOND = [(20 + i, syn("192.0.2.66", "198.51.100.7", 41000 + i, 2000 + i, 4)) for i in range(8)] + [(25, B.arp(2, "aa:aa:aa:aa:aa:01", "10.0.0.5", "00:00:00:00:00:00", "10.0.0.1")), (26, syn("10.0.0.1", "10.0.0.2", 1, 2, 4))]
THIRD = [(90, syn("10.0.0.1", "10.0.0.2", 1, 2, 4))]


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    """A run that is not lost, and its folders after the first tick."""
    at = tmp_path_factory.mktemp("whole")
    one = Sensor(spark, str(at / "state"), str(at / "out"))
    one.tick(capture(spark, FIRST), 10, batch=3).collect()
    shutil.copytree(at, at.parent / "first")
    alerts = one.tick(capture(spark, SECOND), 30, batch=4).collect()
    counts = dict(one.told)
    after = files(at / "out")
    last = one.tick(capture(spark, THIRD), 95, batch=5).collect()
    assert [r.name for r in alerts] == ["new-device", "port-scan"]
    return at.parent / "first", alerts, counts, after, last, files(at / "out")


def moved(first, to):
    """The folders of the first tick at another place: paths in the manifests follow."""
    shutil.copytree(first, to)
    for p in [*to.glob("state/manifest/*.json"), *to.glob("state/live/manifest/*.json")]:
        p.write_text(p.read_text().replace(str(first.parent / "whole0"), str(to)))
        (p.parent / f".{p.name}.crc").unlink(missing_ok=True)


@pytest.mark.parametrize("after", [5, 9, 12])
def test_a_lost_tick_is_repeated_exactly(spark, tmp_path, monkeypatch, whole, after):
    first, alerts, counts, want, last, want_last = whole
    to = tmp_path / "run"
    moved(first, to)
    with monkeypatch.context() as m:
        done = losing(m, after)
        with pytest.raises(Lost):
            Sensor(spark, str(to / "state"), str(to / "out")).tick(capture(spark, SECOND), 30, batch=4)
        assert len(done) == after
    again = Sensor(spark, str(to / "state"), str(to / "out"))
    assert after == 12 or not [n for n in files(to / "out") if "-00000002-" in n]  # nothing of a tick without a manifest row
    assert again.tick(capture(spark, SECOND), 30, batch=4).collect() == alerts
    assert files(to / "out") == want and sorted(n for n in want if "-00000002-" in n) == again.told["files"]
    same = ("version", "batch", "frames", "bytes", "emitted", "last_frame", "device_at", "files")
    assert {k: again.told[k] for k in same} == {k: counts[k] for k in same}
    if after == 12:
        assert again.tick(capture(spark, FIRST), 31, batch=3).count() == 0  # an older batch: taken long ago
        assert again.tick(capture(spark, THIRD), 95, batch=5).collect() == last and files(to / "out") == want_last


@pytest.mark.parametrize("after", [1, 4])
def test_a_lost_batch_of_the_detector_is_taken_once(spark, tmp_path, monkeypatch, after):
    state = str(tmp_path / "state")
    two = [events(spark, scan()[:9]), events(spark, scan()[9:])]
    with monkeypatch.context() as m:
        one = LiveDetector(spark, state)
        one.step(two[0], 8, 0)
        losing(m, after)
        with pytest.raises(Lost):
            one.step(two[1], 14, 1)
    for detector in (LiveDetector(spark, state), one):  # another driver, then the same
        assert [(r.uid, r.ts, r.name) for r in detector.step(two[1], 14, 1).collect()] == [("alert1", 14.0, "port-scan")]
    assert LiveDetector(spark, state).step(two[0], 8, 0).count() == 0
    assert spark.read.parquet(LiveDetector(spark, state)._rows).count() == 15


def test_a_silent_sensor_ticks_and_tells(spark, tmp_path):
    """Frames stop, a timer goes on: heartbeats and blind alerts come from batches without frames."""
    capture(spark, FIRST[:3]).coalesce(1).write.parquet(str(tmp_path / "frames"))
    for i, t in enumerate((5, 612, 700, 2413)):
        at = datetime.datetime.fromtimestamp(t, datetime.timezone.utc)
        spark.createDataFrame([(at,)], "ts timestamp").coalesce(1).write.parquet(str(tmp_path / f"tmp{i}"))
        (tmp_path / "times").mkdir(exist_ok=True)
        next((tmp_path / f"tmp{i}").glob("part-*")).rename(tmp_path / "times" / f"{i}.parquet")
    one = lambda kind, at: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / at))
    got = []
    run = Sensor(spark, str(tmp_path / "state"), str(tmp_path / "out"))
    q = sensor_query(one(FRAMES, "frames"), run, lambda df, i: got.extend(df.collect()), str(tmp_path / "ck"), timer=one("ts timestamp", "times"))
    q.awaitTermination(300)
    assert q.exception() is None
    assert [(r.name, r.ts, r.message) for r in got] == [("sensor-blind", 612.0, "zero frames for 610s"), ("sensor-blind", 2413.0, "zero frames for 2411s")]
    beats = read_events(spark, str(tmp_path / "out")).where("event = 'heartbeat'").orderBy("ts").collect()
    assert [(r.ts, r.total_frames, r.active_flows) for r in beats] == [(5, 3, 0), (612, 3, 0), (700, 3, 0), (2413, 3, 0)]


def test_clock(spark):
    assert clock(spark).isStreaming and clock(spark).columns == ["ts"]
