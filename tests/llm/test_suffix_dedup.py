import random
from collections import Counter

import pytest

from netlens.llm import suffix_dedup as D
from netlens.llm import suffix_index as S


def brute(texts):
    """Per text the removed byte runs, by counting every 200-byte string."""
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + 200] for r in raws for i in range(len(r) - 199))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - 199):
            if count[r[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        runs, at = [], 0
        while (a := gone.find(1, at)) >= 0:
            b = gone.find(0, a)
            at = b if b >= 0 else len(gone)
            runs.append((a, at))
        out.append((len(r), sum(gone), runs, bytes(c for c, g in zip(r, gone, strict=True) if not g)))
    return out


def corpus(seed):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefgh", k=r.randrange(2, 8))) for _ in range(200)] + ["é", "東京", "\x00x"]
    prose = lambda n: " ".join(r.choices(words, k=n))
    passages = [prose(n) for n in (30, 50, 60, 120)] + [prose(300).encode()[:k].decode(errors="ignore") for k in (199, 200, 201, 271, 272, 330)]
    texts = [prose(r.randrange(0, 80)) + r.choice(passages) + prose(r.randrange(0, 80)) for _ in range(60)]
    near = prose(400)
    texts += [near[:k] + "#" + near[k + 1 :] for k in (5, 700, 705, 1200)] + [near, near]
    texts += ["ab" * 400, "a" * 650, "a" * 199, "", None, prose(60) + "\n" + passages[2] * 3, passages[3], "x" + passages[3][:250]]
    texts += [prose(100) + passages[1][i:] + prose(40) for i in range(0, 40, 7)]  # windows at every distance from an edge
    return texts + [prose(90) for _ in range(8)]


@pytest.mark.parametrize(("together", "piece", "batches"), [(8192, 1 << 20, 4), (2, 700, 3), (3, 1 << 20, 1)])
def test_against_all_strings(spark, monkeypatch, together, piece, batches):
    """Also with pieces so small that runs are cut, and with groups dealt by window."""
    monkeypatch.setattr(D, "TOGETHER", together)
    texts = corpus(together)
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, [tuple(s) for s in r.spans], bytes(r.kept)) for r in D.suffix_dedup(df, batches=batches, piece=piece).collect()}
    want = brute(texts)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[i] == w, i
    assert sum(bool(w[1]) for w in want) > 30 and sum(w[1] == 0 for w in want) > 10


def test_every_window_has_one_anchor():
    """Runs cover each window once, and equal windows have their anchors at one offset."""
    raws = [(t or "").encode() for t in corpus(1)]
    for size in (700, S.PIECE):
        seen, offset = Counter(), {}
        for ids, raw, ends, base in S.pieces(enumerate(raws), size):
            _, _, no, at = S.rows_of(raw, ends, base)
            for i, s, o, n in zip(no.tolist(), *(x.tolist() for x in S.unpacked(at)), strict=True):
                for j in range(n):
                    seen[ids[i], s + j] += 1
                    assert offset.setdefault(raws[ids[i]][s + j : s + j + 200], o - j) == o - j
        assert seen == Counter((i, j) for i, r in enumerate(raws) for j in range(len(r) - 199))


def test_scan_carries_over_batches():
    """The scan gives the same rows whatever the Arrow batches are."""
    import numpy as np
    import pyarrow as pa

    r = random.Random(4)
    rows = []  # a class has one row of a level at most
    for g, run in sorted({(r.randrange(8), r.randrange(4)) for _ in range(24)}):
        places = sorted(r.sample([(t, a) for t in range(5) for a in range(3)], r.randrange(1, 5)))
        old = r.random() < 0.5
        rows += [(g, run, old and not i, *p, r.random() < 0.3) for i, p in enumerate(places)]
        rows += [(*rows[-1][:5], False)] * (r.random() < 0.3)  # a copy of the text

    known = {(*x[:2], *x[3:5]) for x in rows if x[5]}  # marked before; a mark given again says nothing new

    def batch(part):
        g, run, old, t, a, seen = (np.array(c) for c in zip(*part, strict=True))
        n = len(part)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (np.ones(n, np.int32), g, run, t, a, seen, np.zeros(n, bool), old)], names=[*D._NAMES, "old"])

    def scanned(step):
        out = [tuple(x.values()) for b in D.merge_scan(iter([batch(rows[i : i + step]) for i in range(0, len(rows), step)])) for x in b.to_pylist()]
        return {k: {x[1:5] if k == D.MARK else x[1:] for x in out if x[0] == k} - (known if k == D.MARK else set()) for k in (D.MARK, D.SUFFIX, D.APART)}

    assert scanned(1) == scanned(7) == scanned(1000) and all(scanned(3).values())


def test_levels_merge_geometrically(spark):
    r = random.Random(9)
    family = D.SuffixFamily(spark)
    for b in range(5):
        texts = [(b * 10 + i, bytearray("".join(r.choices("abcdefghij ", k=3000)).encode())) for i in range(4)]
        family.add(spark.createDataFrame(texts, "id long, text binary"))
        sizes = [n for n, _, _ in family.levels]
        assert len(sizes) <= 3 and sum(df.count() for _, df, _ in family.levels) > (b + 1) * 4 * 30
    family._merge()
    assert len({n for n, _, _ in family.levels}) == len(family.levels)


def test_empty_table(spark):
    assert D.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
