"""Shards recomputed in plain Python: hashes, scores and the highest of all shards."""

import math
import struct

import pytest
import xxhash

from netlens.llm.sharding import shard


def place(key: int, shards: int, weights=None) -> int:
    own = xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
    own -= (own >> 63) << 64
    scores = []
    for s in range(shards):
        first = xxhash.xxh64_intdigest(struct.pack("<q", own), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<i", s), first)
        u = ((h >> 11) + 0.5) / 2.0**53
        scores.append((-(weights[s] if weights else 1.0) / math.log(u), -s))
    return -max(scores)[1]


@pytest.mark.parametrize("weights", [None, [1.0, 2.0, 0.5, 1.5, 3.0]])
def test_equals_brute_force(spark, weights):
    rows = [(i * 37 - 900, f"text {i % 50}") for i in range(600)]
    out = shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=5, weights=weights).collect()
    grown = weights and [*weights, sum(weights) / 5]
    assert {(r.doc_id, r.shard, r.grown_shard) for r in out} == {(k, place(k, 5, weights), place(k, 6, grown)) for k, _ in rows}
    for s in range(5):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
