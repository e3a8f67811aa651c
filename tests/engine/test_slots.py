"""Beacons and long labels over many slots, against plain Python."""

import random

from netlens.operators.detections import Beaconing, DnsTunnel

from .test_detections import conn, events


def test_beacons_over_slots_equal_a_loop(spark):
    r = random.Random(8)
    rows = []
    for g, step in enumerate((700, 1300, 3599, 30, 5000)):  # several a slot, one a slot, slots without any
        t = r.randrange(100)
        for _ in range(r.choice((4, 5, 12, 40))):
            rows.append(conn(t, port=g, src=f"s{g}"))
            t += step + r.choice((0, 0, 1, -1, step // 3 if g == 3 else 0))
    r.shuffle(rows)
    got = {x.dst_port: (x.n, round(x.mean, 6), x.evidence) for x in Beaconing().groups(events(spark, rows)).collect()}
    uids = [x.uid for x in events(spark, rows).orderBy("seq").collect()]
    want = {}
    for g in range(5):
        own = sorted((x["ts"], i) for i, x in enumerate(rows) if x["dst_port"] == g)
        gaps = [b[0] - a[0] for a, b in zip(own, own[1:], strict=False)]
        mean = (own[-1][0] - own[0][0]) / len(gaps)
        if len(own) >= 5 and 10 <= mean <= 3600 and max(gaps) - mean <= 0.2 * mean and mean - min(gaps) <= 0.2 * mean:
            want[g] = (len(own), round(mean, 6), [uids[i] for _, i in own[:10]])
    assert got == want and len(want) >= 2


def test_long_labels_over_slots(spark):
    rows = [{"event": "dns", "uid": f"d{i}", "ts": 400.0 * (i * 7 % 30), "src": "a", "dst": f"x{i}", "query": "q" * (46 + i % 5) + ".example"} for i in range(30)]
    (got,) = DnsTunnel().long_labels(events(spark, rows)).collect()
    last = max(rows, key=lambda x: x["ts"])
    first = sorted(rows, key=lambda x: x["ts"])[:10]
    assert (got.message, got.ts, got.dst, got.evidence) == ("dns label of 50 chars from a", last["ts"], last["dst"], [x["uid"] for x in first])
