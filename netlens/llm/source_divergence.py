"""Operator 12: how far the sources of a language are apart in their use of terms.

Terms are the ASCII letters and all other characters beyond ASCII between separators, lower-cased
in A-Z only. Each task counts its documents by (lang, source, term) before anything is shuffled;
terms in at least ``least`` documents of a language are kept. A group's share of a term is a whole
number of billionths, ``p = 1 + floor(10^9 (count + 5) / (N + 5 V))``, and all arithmetic is exact.

The kept terms of a language are cut in blocks by a hash and its sources in tiles. A task builds
the dense int64 matrix of a block and two tiles, broadcasts all pairs of its rows and sums the
absolute differences to a partial matrix of pairs; terms that neither tile has are one product.
The partial matrices are summed, and each block's heaps of the most overused terms are merged.

Defined results: null text, lang and source are ''. Groups without terms have every kept term
with count 0; a language without kept terms gives pairs of value 0 and no terms. An only source
of a language has no pairs. Repeated documents count as often as they stand. An empty table gives
no rows. Ties rank by the item's UTF-8 bytes. Sums of counts must be below 9 * 10^15.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Terms of a block and sources of a tile: a matrix of some megabytes. Counts that a task holds before it passes them on.
BLOCK_TERMS, TILE, HELD = 2048, 128, 200_000
SMOOTH = 5
#: Terms of a source that are told.
TOP = 50
#: Every byte as it stands in a term, separators as blanks.
_BYTES = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split(b" ") if text else []


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): partial sums, a few rows a task, group and term; docs counts documents that have the term."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, own) in held.items():
                terms = list(n)
                columns = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()), pa.array([n[t] for t in terms], pa.int64()), pa.array([own[t] for t in terms], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
            held.clear()

        size = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = Counter(terms_of(text.as_py()))
                own.pop(b"", None)
                n, docs = held.setdefault((lang, source), [Counter(), Counter()])
                before = len(n)
                n.update(own)
                docs.update(own.keys())
                size += len(n) - before
                if size >= HELD:
                    yield from out()
                    size = 0
        yield from out()

    text = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    return text.mapInArrow(counted, "lang string, source string, term binary, n long, docs long").withColumn("term", F.col("term").cast("string"))


def shares(count: np.ndarray, total: np.ndarray | int, kept: int) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)) in int64 by long division, three digits at a time."""
    by = np.asarray(total, np.int64) + SMOOTH * kept
    whole, rest = np.divmod(count + SMOOTH, by)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, by)
        whole = whole * 1000 + more
    return whole + 1


def _matrix(rows: pa.Table, sources: dict[int, int], terms: np.ndarray) -> np.ndarray:
    """Counts of a tile's sources (rows) in the block's terms (columns)."""
    out = np.zeros((len(sources), len(terms)), np.int64)
    no, term = rows.column("no").to_numpy(), rows.column("term").to_numpy(zero_copy_only=False)
    here = np.isin(no, list(sources))
    at = np.array([sources[i] for i in no[here].tolist()], np.int64)
    out[at, np.searchsorted(terms, term[here])] = rows.column("n").to_numpy()[here]
    return out


def _cells(blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """Partial pair sums (kind 0: no, other, value) and each source's first terms (kind 1: no, term, value) of all cells."""
    heap_size = TOP

    def cell(key: tuple, own: pa.Table, rows: pa.Table) -> pa.Table:
        lang, block, a, b = (k.as_py() for k in key)
        told = own.to_pylist()[0]
        first, second = told["first"], told["second"]
        terms, where = np.unique(rows.column("term").to_numpy(zero_copy_only=False), return_index=True)
        totals = rows.column("all").to_numpy()[where]
        p = {}
        for side in ("first", "second"):
            tile = told[side]
            counts = _matrix(rows, {s["no"]: i for i, s in enumerate(tile)}, terms)
            total = np.array([[s["total"]] for s in tile], np.int64)
            p[side] = counts, shares(counts, total, told["kept"]), shares(np.zeros((len(tile), 1), np.int64), total, told["kept"])
        absent = told["terms"] - len(terms)  # kept terms of the block that no source of the tiles has
        kinds, nos, others, items, values = [], [], [], [], []
        no_b = np.array([s["no"] for s in second], np.int64)
        for i, s in enumerate(first):
            f = np.abs(p["second"][1] - p["first"][1][i]).sum(1)
            if absent:
                f += absent * np.abs(p["second"][2][:, 0] - p["first"][2][i, 0])
            ahead = no_b > s["no"]
            kinds += [0] * int(ahead.sum())
            nos += [s["no"]] * int(ahead.sum())
            others += no_b[ahead].tolist()
            values += f[ahead].tolist()
        items += [None] * len(kinds)
        if a == b and len(terms):
            q = shares(totals, told["all_total"], told["kept"])
            for i, s in enumerate(first):
                more = p["first"][1][i] - q
                over = np.flatnonzero((more > 0) & (p["first"][0][i] > 0))
                heap = over[np.argsort(-more[over], kind="stable")[:heap_size]]  # terms are in order, so ties are too
                kinds += [1] * len(heap)
                nos += [s["no"]] * len(heap)
                others += [None] * len(heap)
                items += terms[heap].tolist()
                values += more[heap].tolist()
        m = len(kinds)
        return pa.table([pa.array([lang] * m, pa.string()), pa.array(kinds, pa.int32()), pa.array(nos, pa.int64()), pa.array(others, pa.int64()), pa.array(items, pa.binary()), pa.array(values, pa.int64())], names=["lang", "kind", "no", "other", "item", "value"])

    key = ["lang", "block", "a", "b"]
    return blocks.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(cell, "lang string, kind int, no long, other long, item binary, value long")


def source_divergence(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = 30) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the other sources and the terms that a source overuses."""
    none = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    docs = df.select(none(lang).alias("lang"), none(source).alias("source"), none(text).alias("text"))
    sums = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    over = Window.partitionBy("lang", "term")  # rows of one term: a row a source
    counted = sums.withColumn("all_docs", F.sum("docs").over(over)).withColumn("all", F.sum("n").over(over)).where(F.col("all_docs") >= least)
    kept = written(counted.select("lang", "source", F.col("term").cast("binary").alias("term"), "n", "all"), "kept_terms")

    # a row a language, a row a group
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"))
    numbered = written(groups.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1).withColumn("tile", F.expr(f"no div {TILE}").cast("int")), "groups")
    dealt = kept.withColumn("bucket", F.xxhash64("term"))
    v = kept.groupBy("lang").agg(F.count_distinct("term").alias("kept"), F.sum("n").alias("all_total"))
    langs = numbered.groupBy("lang").agg(F.max("tile").alias("last")).join(v, "lang", "left").select("lang", "last", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("all_total", F.lit(0)).alias("all_total"))
    langs = langs.withColumn("blocks", F.greatest(F.ceil(F.col("kept") / BLOCK_TERMS), F.lit(1)).cast("long"))

    # a row a cell: a block of terms and two tiles of sources
    tiles = numbered.groupBy("lang", "tile").agg(F.sort_array(F.collect_list(F.struct("no", "total"))).alias("sources"))
    pairs = tiles.select("lang", F.col("tile").alias("a"), F.col("sources").alias("first")).join(tiles.select("lang", F.col("tile").alias("b"), F.col("sources").alias("second")), "lang").where("a <= b")
    block = F.pmod("bucket", "blocks").alias("block")
    placed = dealt.join(langs.select("lang", "blocks", "last"), "lang").join(numbered.select("lang", "source", "no", "tile"), ["lang", "source"])
    sizes = placed.groupBy("lang", block).agg(F.count_distinct("term").alias("terms"))
    cells = langs.select("lang", "kept", "all_total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    cells = cells.join(sizes, ["lang", "block"], "left").withColumn("terms", F.coalesce("terms", F.lit(0))).join(pairs, "lang")
    every = F.explode(F.sequence(F.lit(0), F.col("last"))).alias("with")
    sent = placed.select("lang", block, "no", "tile", "term", "n", "all", every).withColumn("a", F.least("tile", "with")).withColumn("b", F.greatest("tile", "with"))
    found = written(_cells(cells, sent.select("lang", "block", "a", "b", "no", "term", "n", "all")), "cells")

    names = numbered.select("lang", "no", "source")
    half = found.where("kind = 0").groupBy("lang", "no", "other").agg(F.sum("value").alias("value"))
    both = half.union(half.select("lang", F.col("other").alias("no"), F.col("no").alias("other"), "value"))
    pair = both.join(names, ["lang", "no"]).join(names.select("lang", F.col("no").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    term = found.where("kind = 1").join(names, ["lang", "no"]).withColumn("item", F.col("item").cast("string"))
    out = ["lang", "source", "part", "item", "value", "rank"]
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda part, rows: rows.withColumn("part", F.lit(part)).withColumn("rank", rank).select(*out)
    return ranked("pair", pair).unionByName(ranked("term", term).where(F.col("rank") <= TOP))
