"""Densest windows against a plain sweep, and their work in a hot slot."""

import random
import time

import pytest
from pyspark.sql import functions as F

from netlens.plans.windows import densest


def plain(rows, width, distinct):
    out = {}
    groups = {}
    for g, ts, seq, key in rows:
        groups.setdefault(g, []).append((ts, seq, key))
    for g, own in groups.items():
        own.sort(key=lambda r: r[:2])
        best = None
        for i, (ts, _, _) in enumerate(own):
            inside = [r for r in own[i:] if r[0] <= ts + width]
            n = len({r[2] for r in inside if r[2] is not None}) if distinct else len(inside)
            if best is None or n > best[0]:
                best = (n, ts, inside[-1][0], [f"u{r[1]}" for r in inside[:10]], inside[-1][1])
        if best[0] >= 2:
            out[g] = best
    return out


@pytest.mark.parametrize("distinct", [None, "key"])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_sweep(spark, seed, distinct):
    r = random.Random(seed)
    rows = [(r.choice("abcde"), r.choice((-25, 0, 7, 10, 20, 95, 1000)) + r.randrange(60), i, r.choice((1, 2, 3, 4, 5, 6, None))) for i in range(400)]
    df = spark.createDataFrame([(g, t, s, k, f"u{s}") for g, t, s, k in rows], "g string, ts_us long, seq long, key int, uid string")
    got = {x.g: (x.n, x.start_us, x.end_us, x.evidence, x.last_seq) for x in densest(df, ["g"], 10, distinct, {"last_seq": F.col("seq")}, at_least=2).collect()}
    assert got == plain(rows, 10, distinct)


def test_a_hot_slot_takes_sorting_time(spark):
    df = spark.range(100_000).selectExpr("'h' g", "id * 5 ts_us", "id seq", "id % 5000 key", "concat('u', id) uid")
    began = time.time()
    (row,) = densest(df, ["g"], 1_000_000, "key", at_least=10).collect()
    assert (row.n, row.start_us, row.end_us) == (5000, 0, 499_995)
    assert time.time() - began < 30
