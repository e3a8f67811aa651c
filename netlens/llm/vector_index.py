"""Operator 3: approximate nearest neighbours by multi-index hashing of learned codes.

Codes: several iterative-quantisation rotations (PCA, then rotations that bring vectors near
sign vectors), 64 bits each, learned on a bounded sample (``sample`` vectors with the smallest
id hashes). Index: every vector; blocks of about ``block_rows`` rows, and in each a directory
of the distinct values of each 64-bit substring with their rows. Search: a code within Hamming
radius r of the query has a substring within its share of r (pigeonhole), so the directories
give all codes within r; those are reranked by inner product in double precision. r is set on
the sample so that ``target`` of true neighbours lie within it; a block that gives fewer than
k rows is searched with a growing radius.

The queries meet the index in blocks: a task holds an index block and a query block of like
size. Both are sent once, straight to the place where they meet, so an index of n blocks is
shipped once for each ``query_rows`` queries.

Defined results: vectors that are null, zero, or that hold null or non-finite numbers take no
part, nor do null ids; vectors of each length are a space of their own (with an index, and jobs,
of its own); rows that repeat an id count once (shortest, then least vector); equal scores go to
the smaller id; fewer than k candidates are all returned.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WORD = 64
FOUND = "query_id long, rank int, vec_id long, score double"
#: Tasks in which blocks meet, at most: more meetings share a task, one after another.
TASKS = 8192


def learned_rotations(x: np.ndarray, words: int, rounds: int = 30, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection of dim x 64*words): iterative quantisation from several random rotations."""
    mean = x.mean(0)
    centred = x - mean
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    rng = np.random.default_rng(seed)
    own = min(WORD, vt.shape[0])
    parts = []
    for _ in range(words):
        v = centred @ vt[:own].T
        r = np.linalg.qr(rng.normal(size=(own, own)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        p = vt[:own].T @ r
        if own < WORD:  # few dimensions: the rest of the word are random directions
            p = np.hstack([p, rng.normal(size=(x.shape[1], WORD - own))])
        parts.append(p)
    return mean, np.hstack(parts)


def codes_of(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Codes as (rows, words) unsigned 64-bit numbers."""
    bits = np.packbits((x - mean) @ projection > 0, axis=1)
    return np.ascontiguousarray(bits).view(np.uint64)


def fitted_radius(x: np.ndarray, codes: np.ndarray, near: int, target: float) -> int:
    """The radius within which ``target`` of the nearest ``near`` others of a sample row lie."""
    own = slice(0, 512)
    score = x[own] @ x.T
    score[np.arange(len(score)), np.arange(len(score))] = -np.inf
    top = np.argsort(-score, axis=1)[:, :near]
    far = np.bitwise_count(codes[own][:, None, :] ^ codes[top]).sum(2)
    return int(np.quantile(far, target, method="higher"))


class Block:
    """The index of one block: vectors, codes and a directory for each substring."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray):
        self.ids, self.x, self.codes = ids, x, codes
        self.tables = []
        for j in range(codes.shape[1]):
            values, at = np.unique(codes[:, j], return_inverse=True)
            order = np.argsort(at, kind="stable")
            self.tables.append((values, order, np.searchsorted(at[order], np.arange(len(values) + 1))))
        self.masks: dict[int, np.ndarray] = {}

    def _probe(self, j: int, value: np.uint64, radius: int) -> np.ndarray:
        """Rows whose substring j is within the radius: by enumeration where that is less work."""
        values, order, ends = self.tables[j]
        if radius <= 2 and 1 + WORD + WORD * (WORD - 1) // 2 * (radius == 2) < len(values):
            if radius not in self.masks:
                self.masks[radius] = np.array([sum(1 << b for b in c) for n in range(radius + 1) for c in itertools.combinations(range(WORD), n)], np.uint64)
            probes = self.masks[radius] ^ value
            at = np.searchsorted(values, probes)
            at = at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == probes)]
        else:
            at = np.flatnonzero(np.bitwise_count(values ^ value) <= radius)
        counts = ends[at + 1] - ends[at]
        places = np.repeat(ends[at] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        return order[places]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows within the Hamming radius."""
        share, extra = divmod(radius, len(code))
        hit = np.zeros(len(self.ids), bool)
        for j, value in enumerate(code):
            least = share if j <= extra else share - 1
            if least >= 0:
                hit[self._probe(j, value, least)] = True
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(1) <= radius]

    def nearest(self, own_id: int, vector: np.ndarray, code: np.ndarray, k: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
        rows = self.within(code, radius)
        others = len(self.ids) - int((self.ids == own_id).sum())
        while len(rows := rows[self.ids[rows] != own_id]) < min(k, others):
            radius += 8
            rows = self.within(code, radius)
        score = (self.x[rows] * vector).sum(1)
        if len(rows) > k:
            keep = score >= np.partition(score, len(score) - k)[len(score) - k]
            rows, score = rows[keep], score[keep]
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows][best], score[best]


def nearest_neighbours(df: DataFrame, key: str = "vec_id", vector: str = "embedding", query_every: int = 20, k: int = 20, words: int = 4, sample: int = 4096, target: float = 0.975, block_rows: int = 16384, query_rows: int = 16384) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by ``query_every``."""
    v = F.col(f"`{vector}`").cast("array<double>")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("v")).where("id is not null").where(F.coalesce(usable, F.lit(False)))
    spaces = lambda: rows.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()
    sizes = spaces()
    if len(sizes) > 1:
        own = rows.groupBy("id").agg(F.min(F.size("v")).alias("d"))
        rows = rows.join(own, "id").where(F.size("v") == F.col("d")).select("id", "v")
        sizes = spaces()
    found = df.sparkSession.createDataFrame([], FOUND)
    for space in sizes:
        found = found.unionByName(_searched(rows.where(F.size("v") == space["d"]), space["d"], space["count"], query_every, k, words, sample, target, block_rows, query_rows))
    return found


def _searched(rows: DataFrame, dim: int, n: int, query_every: int, k: int, words: int, sample: int, target: float, block_rows: int, query_rows: int) -> DataFrame:
    """The search in the space of one length: ``rows`` are some ``n`` of (id, v)."""
    chosen = [r.id for r in rows.select("id").orderBy(F.xxhash64("id"), "id").limit(sample).collect()]
    x = np.array([r.v for r in rows.where(F.col("id").isin(chosen)).orderBy(F.xxhash64("id"), "id").limit(2 * sample).collect()])
    mean, projection = learned_rotations(x, words)
    radius = fitted_radius(x, codes_of(x, mean, projection), min(max(1, round(k * len(x) / n)), len(x)), target)

    def gathered(t: pa.Table) -> pa.Table:
        """One row a block: ids, vectors and codes as bytes."""
        values = np.asarray(t.column("v").combine_chunks().flatten(), np.float64).reshape(-1, dim)
        ids = t.column("id").to_numpy()
        order = np.lexsort((*values.T[::-1], ids))
        order = order[np.concatenate([[True], ids[order][1:] != ids[order][:-1]])]
        ids, values = ids[order], np.ascontiguousarray(values[order])
        return pa.table({"no": [t.column("no")[0].as_py()], "ids": [ids.tobytes()], "x": [values.tobytes()], "codes": [codes_of(values, mean, projection).tobytes()]})

    def blocks(part: DataFrame, count: int) -> DataFrame:
        dealt = part.select(F.pmod(F.xxhash64("id", F.lit("block")), F.lit(count)).alias("no"), "id", "v")
        return dealt.groupBy("no").applyInArrow(gathered, "no long, ids binary, x binary, codes binary")

    def unpacked(ids: bytes, x: bytes, codes: bytes) -> tuple:
        return np.frombuffer(ids, np.int64), np.frombuffer(x, np.float64).reshape(-1, dim), np.frombuffer(codes, np.uint64).reshape(-1, words)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(*unpacked(row["ids"], row["x"], row["codes"]))
                out: list[list] = [[], [], []]
                for own, vec, code in zip(*unpacked(row["q_ids"], row["q_x"], row["q_codes"]), strict=True):
                    ids, score = block.nearest(own, vec, code, k, radius)
                    out[0].append(np.full(len(ids), own))
                    out[1].append(ids)
                    out[2].append(score)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["query_id", "vec_id", "score"])

    asked = rows.where(F.pmod("id", F.lit(query_every)) == 0)
    n_index, n_asked = max(1, -(-n // block_rows)), max(1, -(-n // (query_every * query_rows)))
    index = written(blocks(rows, n_index), "index")
    queries = written(blocks(asked, n_asked), "queries")
    to = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    tasks = min(2 * n_index * n_asked, TASKS)
    left = index.select("no", to(n_asked).alias("q_no"), "ids", "x", "codes").repartition(tasks, "no", "q_no")
    right = queries.select(to(n_index).alias("no"), F.col("no").alias("q_no"), *[F.col(c).alias(f"q_{c}") for c in ("ids", "x", "codes")]).repartition(tasks, "no", "q_no")
    met = left.join(right.hint("merge"), ["no", "q_no"])
    found = met.select("ids", "x", "codes", "q_ids", "q_x", "q_codes").mapInArrow(searched, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
