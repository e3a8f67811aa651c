"""Flows that end at ticks against a loop over frames and ticks."""

import random

import pytest

from netlens.operators.flows import Every, flows_with_ticks, heartbeats
from netlens.operators.frames import layers

from .test_frames_and_live import capture, syn


def looped(frames, ticks, idle, active):
    """(key, first, last, packets, reason, end) by walking each key's frames; a clock only goes forward in arrival order."""
    keys = {}
    for t, key, flags in frames:
        keys.setdefault(key, []).append((t, flags))
    out = []
    for key, rows in keys.items():
        flow, seen = None, 0

        def until(limit):
            nonlocal flow, seen
            while seen < len(ticks) and (limit is None or ticks[seen] <= limit):
                at = ticks[seen]
                seen += 1
                if flow:
                    why = "rst" if flow[3] & 4 else "fin" if flow[3] & 1 else "idle" if at - flow[1] >= idle else "active" if at - flow[0] >= active else None
                    if why:
                        out.append((key, *flow[:3], why, at))
                        flow = None

        for t, flags in rows:
            until(t)
            flow = [t, t, 1, flags] if flow is None else [flow[0], max(flow[1], t), flow[2] + 1, flow[3] | flags]
        until(None)
        if flow:
            out.append((key, *flow[:3], "eof", None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_the_loop(spark, seed):
    r = random.Random(seed)
    t, frames = 0, []
    for _ in range(300):
        t += r.choice((0, 1, 1, 2, 15, -3))
        frames.append((max(t, 0), r.randrange(1, 6), r.choice((0x10, 0x10, 0x10, 2, 1, 4))))
    rows = layers(capture(spark, [(t, syn("10.0.0.1", "10.0.0.2", p, 80, f)) for t, p, f in frames]).repartition(3))
    most = max(f[0] for f in frames)
    lists = sorted(r.sample(range(1, most), 25))
    for ticks, given in ((lists, [float(x) for x in lists]), (list(range(7, most + 8, 7)), Every(7_000_000))):
        last = [x for x in ticks if x <= most // 7 * 7 + 7]
        got = flows_with_ticks(rows, given, idle=10, active=40).collect()
        own = [(f.a.port, f.first.timestamp(), f.last.timestamp(), f.pkts_a_to_b + f.pkts_b_to_a, f.end_reason, None if f.end_us is None else f.end_us / 1e6) for f in got]
        want = [(k, float(a), float(b), n, w, None if e is None else float(e)) for k, a, b, n, w, e in looped(frames, last if isinstance(given, Every) else lists, 10, 40)]
        assert sorted(own, key=repr) == sorted(want, key=repr)


def test_heartbeats_count_frames_and_flows(spark):
    rows = layers(capture(spark, [(t, syn("10.0.0.1", "10.0.0.2", p, 81, f)) for t, p, f in ((1, 1, 2), (3, 2, 2), (4, 1, 4), (12, 2, 0x10), (31, 3, 2))]))
    got = heartbeats(rows, every=10, idle=15).orderBy("ts").collect()
    assert [(r.ts, r.total_frames, r.active_flows, r.events_emitted) for r in got] == [(10, 3, 1, 2), (20, 4, 1, 3), (30, 4, 0, 5), (40, 5, 1, 6)]


def test_flows_over_batches_need_no_further_shuffle(spark):
    """Long flows over Arrow batches of two slots, each cut by age again and again; flows come out of the pass over slots."""
    frames = [(t, 1 + t % 2, 0x10) for t in range(1, 120)] + [(130, 1, 4), (131, 1, 0x10)]
    rows = layers(capture(spark, [(t, syn("10.0.0.1", "10.0.0.2", p, 80, f)) for t, p, f in frames]))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        flows = flows_with_ticks(rows, Every(3_000_000), idle=10, active=13)
        got = [(f.a.port, f.first.timestamp(), f.last.timestamp(), f.pkts_a_to_b + f.pkts_b_to_a, f.end_reason, None if f.end_us is None else f.end_us / 1e6) for f in flows.collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = [(k, float(a), float(b), n, w, None if e is None else float(e)) for k, a, b, n, w, e in looped(frames, list(range(3, 133, 3)), 10, 13)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert "Aggregate" not in flows._jdf.queryExecution().optimizedPlan().toString()


def test_heartbeats_read_all_frames_for_their_counts_and_flows_only(spark):
    beats = heartbeats(layers(capture(spark, [(1, syn("10.0.0.1", "10.0.0.2", 1, 81, 2))])), every=10)
    plan = beats._jdf.queryExecution().analyzed().toString()
    assert sum("LogicalRDD" in line and "wire_len" in line for line in plan.split("\n")) == 2
