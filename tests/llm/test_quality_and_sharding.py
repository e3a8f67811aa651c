import collections
import math
import random
import re
import zlib

from netlens.llm.quality_rules import quality_rules
from netlens.llm.sharding import shard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in lines
            lines.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered), failed


def test_counts_equal_brute_force(spark):
    r = random.Random(4)
    vocabulary = ["the", "of", "a", "x#", "ü|", "日本", "word", "and", "!!", "\n", "\t", "\x0b", "\x0c", "\r", "  ", "\u00a0", "\u2028", "same line\n"]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.choice((0, 3, 20, 200)))) for _ in range(120)] + [None, "", " \n ", "a b c a b c", "x " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in quality_rules(df).collect():
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed) == counts(row.text), repr(row.text)
        assert not (row.base_failed and row.kept)


def test_rules_judge_and_clashing_columns_give_way(spark):
    r = random.Random(1)
    prose = " ".join(r.choice(["the", "of", "house", "garden", "and", "walked", "river", "to", "morning"]) + str(i) * (i % 5 == 0) for i in range(120))
    junk = " ".join(f"w{i}$$$" for i in range(120))
    listed = " | ".join(f"noun{i}" for i in range(120))
    df = spark.createDataFrame([(1, prose, 7), (2, junk, 7), (3, listed, 7), (1, prose, 7)], "doc_id long, text string, kept int")
    got = {(x.doc_id, x.kept) for x in quality_rules(df).collect()}
    assert got == {(1, True), (2, False), (3, False)}
    assert quality_rules(df.limit(0)).count() == 0


def docs(spark, n=900):
    rows = [(i, f"text {i % 50}", 1) for i in range(n)] + [(None, "no id", 1), (None, None, 1), (3, "text 3", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, shard int")


def test_sharding_keeps_all_rows_and_moves_few(spark):
    df = docs(spark)
    out = shard(df, shards=8, rows_a_task=40).collect()
    assert len(out) == df.count()
    for r in out:
        raw = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(8))
    assert max(map(len, by.values())) < 2 * 900 / 8
    moved = [r for r in out if r.grown_shard != r.shard]
    assert all(r.grown_shard == 8 for r in moved) and len(moved) < 2 * 900 / 9
    grown = {r.doc_id: r.shard for r in shard(df, shards=9).collect() if r.doc_id is not None}
    assert all(grown[r.doc_id] == r.grown_shard for r in out if r.doc_id is not None)


def test_weights_and_empty(spark):
    out = collections.Counter(r.shard for r in shard(docs(spark), shards=3, weights=[1.0, 1.0, 2.0]).collect())
    assert math.isclose(out[2] / 903, 0.5, abs_tol=0.08)
    assert shard(docs(spark).limit(0), shards=3).count() == 0
