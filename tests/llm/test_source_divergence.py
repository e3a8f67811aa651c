import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from netlens.llm import source_divergence as D


def brute(rows, least, top=50):
    """The contract in plain Python with unbounded integers."""
    rows = [tuple(v or "" for v in r) for r in rows]
    counts, docs, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        own = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        counts[lang, source].update(own)
        docs[lang].update(set(own))
        sources[lang].add(source)
    out = []
    for lang, own in sources.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[u] for u in kept) + 5 * len(kept)) for t in kept}  # noqa: E731, B023
        q = p(sum((counts[lang, s] for s in own), Counter()))
        ps = {s: p(counts[lang, s]) for s in own}
        for s in own:
            pairs = [(o, sum(abs(ps[s][t] - ps[o][t]) for t in kept)) for o in own if o != s]
            terms = [(t, ps[s][t] - q[t]) for t in kept if counts[lang, s][t] and ps[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(out)


def documents(seed, n=120):
    r = random.Random(seed)
    words = ["alpha", "Beta", "été", "ÉTÉ", "x", "naïve", "zoo", "東京", "q-r", "don't", "A1b", "\u0085"] + [f"w{c}" for c in "abcdefghij"]
    rows = [(r.choice(["en", "en", "de", None]), r.choice(["s0", "s0", "s1", "s2", "é", "", None]), " ".join(r.choices(words[: r.randrange(2, len(words))], k=r.randrange(0, 30)))) for _ in range(n)]
    return [*rows, ("fr", "lone", "word"), ("it", "a", None), ("it", "b", "1 2 3"), ("en", "silent", "")]


@pytest.mark.parametrize(("terms", "tile", "held"), [(2048, 128, 200_000), (3, 2, 5)])
def test_against_plain_python(spark, monkeypatch, terms, tile, held):
    for name, value in (("BLOCK_TERMS", terms), ("TILE", tile), ("HELD", held), ("TOP", 4)):
        monkeypatch.setattr(D, name, value)
    rows = documents(terms)
    df = spark.createDataFrame([(*r, "x") for r in rows], "lang string, source string, text string, term string").repartition(3)
    got = [tuple(r) for r in D.source_divergence(df, least=8).collect()]
    assert sorted(got) == brute(rows, 8, 4) and len({r[3] for r in got if r[2] == "term"}) > 5


def test_shares_are_exact_beyond_longs():
    for c, n, v in ((10**15, 8 * 10**15, 10**6), (0, 10**15, 3), (7, 7, 1), (123456789012345, 987654321098765, 12345)):
        assert D.shares(np.array([c]), n, v).tolist() == [1 + 10**9 * (c + 5) // (n + 5 * v)]


def test_empty_table(spark):
    assert D.source_divergence(spark.createDataFrame([], "lang string, source string, text string")).collect() == []
