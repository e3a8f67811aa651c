from fractions import Fraction

import numpy as np
import pytest

from netlens.llm import embedding_whitening as W

KINDS = "vec_id long, embedding array<float>, component string"


def brute(vectors):
    """Exact sums and covariance over the distinct vectors, in fractions; eigenvalues by numpy."""
    x = [tuple(int(np.floor(256 * float(np.float32(c)))) for c in v) for v in vectors]
    fit = sorted(set(x))
    n, d = len(fit), len(fit[0])
    sums = [sum(v[i] for v in fit) for i in range(d)]
    mean = [Fraction(s, n) for s in sums]
    cov = [[float(sum((v[i] - mean[i]) * (v[j] - mean[j]) for v in fit) / n) for j in range(d)] for i in range(d)]
    e, vec = np.linalg.eigh(np.array(cov))
    return x, n, sums, mean, e[::-1], vec[:, ::-1]


def test_against_fractions(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_ROWS", 7)
    monkeypatch.setattr(W, "FAN", 2)
    r = np.random.default_rng(3)
    vectors = (r.normal(size=(80, 6)) @ r.normal(size=(6, 6)) + 5).astype(np.float32).tolist()
    rows = [(i, v, "x") for i, v in enumerate(vectors)] + [(500, vectors[0], "x"), (500, vectors[1], "x"), (None, vectors[2], None)]
    odd = [(900, None, "x"), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"), (902, [float("nan")] * 6, "x"), (903, [float("inf")] * 6, "x"), (904, [], "x")]
    got = W.whitening(spark.createDataFrame(rows + odd, KINDS).repartition(5)).collect()
    x, n, sums, mean, e, vec = brute([v for _, v, _ in rows])
    assert len(got) == 4 * len(rows) and n == 80
    by = {}
    for g in got:
        by.setdefault((g.vec_id, g.component), []).append(g)
    assert sorted(len(v) for v in by.values()) == [1] * 324 + [2] * 4  # one id is there twice
    signs = {}
    for i, v in zip([i for i, _, _ in rows[:80]], x, strict=False):
        for c in range(4):
            (g,) = by[i, c + 1]
            assert (g.n, g.dimension, g.deviation) == (n, 6, sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)))
            want = sum(float(a - m) * vec[j, c] for j, (a, m) in enumerate(zip(v, mean, strict=True))) / e[c] ** 0.5
            sign = signs.setdefault(c, 1 if want * g.whitened >= 0 else -1)
            assert g.whitened == pytest.approx(sign * want, abs=1e-9)
            assert g.explained == pytest.approx(e[c] / e.sum(), rel=1e-9) and g.identity_error < 1e-9


def test_few_vectors_and_lengths(spark):
    """Two distinct vectors have one component; another length is a space of its own; one vector has no variance."""
    rows = [(1, [0.0, 0.0, 0.0], ""), (2, [1.0, 0.0, 0.0], ""), (3, [1.0, 0.0, 0.0], ""), (4, [2.0, 2.0], "")]
    got = {(g.vec_id, g.component): g for g in W.whitening(spark.createDataFrame(rows, KINDS)).collect()}
    assert sorted(got) == [(i, c) for i in (1, 2, 3) for c in (1, 2, 3)] + [(4, 1), (4, 2)]
    assert [got[i, 1].whitened for i in (1, 2, 3)] == pytest.approx([-1, 1, 1]) and [got[1, c].whitened for c in (2, 3)] == [None, None]
    assert (got[1, 1].n, got[4, 1].n, got[4, 1].deviation, got[4, 1].whitened, got[4, 1].identity_error) == (2, 1, 0, None, None)
    assert got[1, 1].explained == pytest.approx(1) and got[1, 2].explained == 0


def test_large_entries_and_empty_table(spark):
    big = spark.createDataFrame([(i, [float(v), 1.0]) for i, v in enumerate((1 << 40, -(1 << 40), 3, 7))], "vec_id long, embedding array<double>")
    got = W.whitening(big).where("component = 1").orderBy("vec_id").collect()
    assert [g.deviation for g in got] == [None] * 2 + [(4 * 256 * 3 - 2560) ** 2, (4 * 256 * 7 - 2560) ** 2]
    assert W.whitening(big.limit(0)).collect() == []
