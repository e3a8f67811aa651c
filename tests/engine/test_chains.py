"""Chains against the sequential loop."""

import random

import numpy as np
import pytest

from netlens.plans import chains as C


def sequential(times, gap, last=None):
    out = []
    for i, t in enumerate(times):
        if last is None or t - last >= gap:
            out.append(i)
            last = t
    return out


def files(sizes, most):
    out, held = [], 0
    for n in sizes:
        if not out or (held > 0 and held + n > most):
            out.append([])
            held = 0
        out[-1].append(n)
        held += n
    return out


@pytest.mark.parametrize("seed", range(30))
def test_functions_compose_as_the_loop(seed):
    r = random.Random(seed)
    times = np.cumsum([r.choice((0, 1, 1, 2, 9, -4)) for _ in range(200)])
    gap = r.choice((0, 1, 3, 10))
    edges = sorted(r.sample(range(201), 5))
    whole = None
    for a, b in zip([0, *edges], [*edges, 200], strict=True):
        f = C.steps(times[a:b] - gap, times[a:b])
        whole = f if whole is None else whole.then(f)
    for start in range(int(times.min()) - 12, int(times.max()) + 12):
        own = sequential(times.tolist(), gap, start)
        assert C.taken(times - gap, times, start) == own
        assert whole(np.array([start])).tolist() == [int(times[own[-1]]) if own else start]


@pytest.mark.parametrize(("fan", "parts"), [(2, 7), (32, 5)])
def test_chain_over_partitions(spark, monkeypatch, fan, parts):
    monkeypatch.setattr(C, "FAN", fan)
    r = random.Random(parts)
    times = np.cumsum([r.choice((0, 1, 3, -2)) for _ in range(400)]).tolist()
    base = spark.createDataFrame(list(enumerate(times)), "seq long, t long").repartitionByRange(parts, "seq").sortWithinPartitions("seq").checkpoint()
    for gap, start in ((5, C.NONE), (5, 30), (0, C.NONE), (1000, C.NONE)):
        got = sorted(x.seq for x in C.chain(base, C.gaps("t", gap), start).collect())
        assert got == sequential(times, gap, None if start == C.NONE else start)


@pytest.mark.parametrize("most", [1, 50, 400])
def test_byte_cuts_equal_a_sequential_writer(spark, monkeypatch, most):
    monkeypatch.setattr(C, "FAN", 3)
    r = random.Random(most)
    sizes = [r.choice((1, 7, 30, 30, 90, 500)) for _ in range(300)]
    base = spark.createDataFrame(list(enumerate(sizes)), "seq long, size long").repartitionByRange(11, "seq").sortWithinPartitions("seq").checkpoint()
    got = {}
    for x in C.byte_cuts(base, "size", most).orderBy("seq").collect():
        got.setdefault(x.state, []).append(x.size)
    want = files(sizes, most)
    assert list(got.values()) == want and list(got) == [0, *np.cumsum([sum(f) for f in want]).tolist()[:-1]]
