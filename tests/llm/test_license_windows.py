import random

import pytest

from netlens.llm.license_scan import Matcher, bigrams, license_scan, words_of
from netlens.llm.license_templates import TEMPLATES


def brute_force(matcher, words):
    out = []
    for k, (_, t, n) in enumerate(matcher.sized):
        for i in range(len(words) - n):
            common = sum((bigrams(words[i : i + n + 1]) & t).values())
            if common / n >= matcher.least:
                out.append((common, k, i))
    return sorted(out)


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_windows_equal_brute_force(least):
    r, matcher = random.Random(5), Matcher(TEMPLATES, least)
    flat = [words_of(t) for ts in TEMPLATES.values() for t in ts]
    n = 0
    for _ in range(25):
        words = []
        for _ in range(r.randrange(1, 4)):
            words += [r.choice(["the", "license", "software", "x", "and", "of", "to"]) for _ in range(r.randrange(12))]
            words += [w if r.random() > 0.04 else r.choice(["x", "the"]) for w in r.choice(flat) if r.random() > 0.02]
        got = sorted(matcher.windows(words))
        assert got == brute_force(matcher, words)
        n += len(got)
    assert n
    assert matcher.windows([]) == matcher.windows(["license"]) == []


def test_notices_inside_longer_units(spark):
    mit, apache = TEMPLATES["MIT"][-1], TEMPLATES["Apache-2.0"][-1]
    code = "\n".join(f"x{i} = call_{i}(y)" for i in range(400))
    rows = [
        (1, "Contact us. This work is licensed under CC BY 4.0. Imprint and privacy"),
        (2, f"{mit}\n{code}"),
        (3, f"{code}\n{apache}\n{code}"),
        (4, "Licensed under the MIT License. Our shop sells many things to all. Licensed under CC BY-NC 4.0. Bye"),
        (5, "words and words " * 99 + "released under\nthe ISC license and more words " + "words and words " * 99),
        (6, f"some {mit} Licensed under CC BY 4.0. {code}"),
        (7, f"see This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. {code}"),
        (8, "Licensed under the MIT License. It is good. " * 40),
        (9, code),
    ]
    got = {}
    for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.first_line, r.n_lines))
    m, a = mit.count("\n") + 1, apache.count("\n") + 1
    assert got.pop(8) == [("MIT", 0, 1)] * 40
    assert {k: sorted(v) for k, v in got.items()} == {
        1: [("CC-BY-4.0", 0, 1)], 2: [("MIT", 0, m)], 3: [("Apache-2.0", 400, a)], 4: [("CC-BY-NC-4.0", 0, 1), ("MIT", 0, 1)], 5: [("ISC", 0, 2)],
        6: [("CC-BY-4.0", m - 1, 1), ("MIT", 0, m)], 7: [("CC-BY-SA-4.0", 0, 1)],
    }


def test_many_notices_in_one_text():
    """As many rows as notices, without comparing each with each."""
    import time

    matcher = Matcher(TEMPLATES, 0.8)
    text = "Released under the MIT License.\nsome other words here\n" * 4000
    began = time.process_time()
    found = matcher.scan(text)
    assert len(found) == 4000 and {f[0] for f in found} == {"MIT"}
    assert time.process_time() - began < 4
