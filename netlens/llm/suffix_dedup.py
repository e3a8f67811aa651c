"""Operator 11: removal of long repeated passages with a logarithmic family of suffix arrays.

``SuffixFamily`` takes texts in batches. A batch gets its sparse suffix array
(``suffix_index``); the array is merged with those of the existing levels in one sorted scan,
which finds the runs that stand elsewhere too, in the batch or in a level; then the batch's new
suffixes become a level, and levels of like size (the same power of two of rows) merge. A level
keeps one suffix of those that agree, so a passage in very many texts is one row of it.

The scan streams sorted rows and holds one. Runs that agree in whole are marked at once. Suffixes
that agree for ``GRAM`` bytes but differ in their run are told apart window by window at the end
(``_window_marks``): groups of moderate size each in a task, larger ones as rows dealt by window.

Defined results: every byte covered by a string of ``WINDOW`` bytes that also starts anywhere
else, same text included, goes. Null texts are empty; texts shorter than ``WINDOW`` bytes stay
whole; of equal longer texts nothing stays. Repeated and null keys are rows of their own. An empty
table gives no rows. Columns called like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, BATCH_SETTING, fewer, new_path, written
from .suffix_index import PIECE, WINDOW, pieces, rows_of, unpacked, window_prints

MARK, SUFFIX, APART = 0, 1, 2
_ROW = "kind int, gram long, run long, text long, at long, seen boolean, apart boolean"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]
#: Suffixes with one gram that a task takes together; groups beyond are dealt by window.
TOGETHER = 8192
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _saved(df: DataFrame, name: str, *parts: str) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder and its path; shuffle files go as soon as it is written."""
    spark = df.sparkSession
    path, own = new_path(spark, name), {BATCH_SETTING: BATCH_BYTES, _CLEANUP: "true"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        df.write.partitionBy(*parts).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path), path


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _batch(kind: int, gram, run, text, at, seen, apart) -> pa.RecordBatch:
    n = len(at)
    columns = [np.full(n, kind, np.int32), gram, run, text, at, seen, apart]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_NAMES)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where any of the sorted columns changes, the first place included."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def suffix_array(size: int):
    """Texts (id, bytes) to suffix rows. Runs that a piece has twice are marked here, and only one of them goes on."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: dict[int, int] = {}
            for i, name in enumerate(batch.column(0).to_pylist()):
                texts.setdefault(name, i)
            for names, raw, ends, base in pieces(((k, batch.column(1)[i].as_py()) for k, i in texts.items()), size):
                gram, run, no, at = rows_of(raw, ends, base)
                text = np.array(names, np.int64)[no]
                order = np.lexsort((at, text, run, gram))
                gram, run, text, at = (c[order] for c in (gram, run, text, at))
                first = _starts(gram, run)
                count = np.diff(np.append(np.flatnonzero(first), len(first)))
                twice = np.repeat(count > 1, count)
                none = np.zeros(int(twice.sum()), bool)
                if len(none):
                    yield _batch(MARK, gram[twice], run[twice], text[twice], at[twice], none, none)
                yield _batch(SUFFIX, gram[first], run[first], text[first], at[first], twice[first], np.zeros(int(first.sum()), bool))

    return rows


def merge_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a batch and of all levels, sorted by gram and run (those of levels first), to marks, new level rows and runs to tell apart.

    ``seen``: the row is marked already; ``apart``: it was given to be told apart already. The
    last class (gram, run) of each Arrow batch is carried on as one row, with whether its gram had
    another class before it.
    """
    held: list[np.ndarray] | None = None
    others = False

    def scanned(gram, run, text, at, seen, apart, old, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, others
        keep = _starts(gram, run, text, at)
        gram, run, text, at, seen, apart, old = (c[keep] for c in (gram, run, text, at, seen, apart, old))
        first = _starts(gram, run)
        where = np.flatnonzero(first)
        size = np.diff(np.append(where, len(first)))
        repeated = (size > 1) | np.logical_or.reduceat(seen, where)
        marked = np.repeat(repeated, size) & ~seen
        if marked.any():
            yield _batch(MARK, gram[marked], run[marked], text[marked], at[marked], seen[marked], apart[marked])
        new_gram = _starts(gram[where])
        group = np.cumsum(new_gram) - 1
        mixed = np.bincount(group)[group] > 1
        if others:
            mixed |= group == 0
        done = len(where) if last else len(where) - 1
        at_ = where[:done]
        own = ~old[at_]
        if own.any():
            k = at_[own]
            yield _batch(SUFFIX, gram[k], run[k], text[k], at[k], repeated[:done][own], mixed[:done][own])
        tell = mixed[:done] & ~apart[at_]
        if tell.any():
            k = at_[tell]
            yield _batch(APART, gram[k], run[k], text[k], at[k], repeated[:done][tell], tell[tell])
        if not last:
            i = where[-1]
            held = [c[i : i + 1] for c in (gram, run, text, at, repeated[-1:].repeat(len(gram)), apart, old)]
            others = bool(mixed[-1])

    for batch in batches:
        columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("kind", "gram", "run", "text", "at", "seen", "apart", "old")]
        sure = columns[0] == MARK
        if sure.any():
            yield _batch(MARK, *(c[sure] for c in columns[1:7]))
        rest = [c[~sure] for c in columns[1:]]
        if held is not None:
            rest = [np.concatenate(pair) for pair in zip(held, rest, strict=True)]
        if len(rest[0]):
            yield from scanned(*rest, last=False)
    if held is not None:
        yield from scanned(*held, last=True)


class SuffixFamily:
    """Levels of suffixes, and what was found so far. Tables lie in the shared folder."""

    def __init__(self, spark: SparkSession, piece: int = PIECE):
        self.spark, self.piece = spark, piece
        self.levels: list[tuple[int, DataFrame, str]] = []  # power of two of the rows, rows, folder
        self.found: list[DataFrame] = []

    def add(self, texts: DataFrame) -> None:
        """Takes a batch of texts (id long, text binary) of ``WINDOW`` bytes or more; the same id is the same text."""
        self._merge()
        array = texts.mapInArrow(suffix_array(self.piece), _ROW).withColumn("old", F.lit(False))
        for _, level, _ in self.levels:
            array = array.unionByName(level.withColumn("kind", F.lit(SUFFIX)).withColumn("old", F.lit(True)))
        # rows that are marked already need not meet their gram's others
        deal = F.when(F.col("kind") == MARK, F.xxhash64("text", "at")).otherwise(F.col("gram"))
        dealt = array.withColumn("deal", deal).repartition("deal")
        merged = dealt.sortWithinPartitions("kind", "gram", "run", F.desc("old"), "text", "at", F.desc("seen")).drop("deal")
        found, path = _saved(merged.mapInArrow(merge_scan, _ROW), "scan", "kind")
        self.found.append(found)
        self._keep(found.where(F.col("kind") == SUFFIX).drop("kind"), f"{path}/kind={SUFFIX}")

    def _keep(self, level: DataFrame, folder: str) -> None:
        n = level.count()
        if n:
            self.levels.append((n.bit_length(), level, folder))

    def _merge(self) -> None:
        """Two levels of like size become one, until all sizes differ. No class is in two levels."""
        while same := next(((a, b) for a in self.levels for b in self.levels if a is not b and a[0] == b[0]), None):
            both = same[0][1].unionByName(same[1][1])
            level, path = _saved(both.repartition("gram").sortWithinPartitions("gram", "run"), "level")
            self.levels = [x for x in self.levels if x not in same]
            for _, _, folder in same:
                _delete(self.spark, folder)
            self._keep(level, path)

    def of_kind(self, kind: int) -> DataFrame:
        out = self.found[0]
        for f in self.found[1:]:
            out = out.unionByName(f)
        return out.where(F.col("kind") == kind).select("gram", "text", "at")


def _run_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, runs) to (gram, many, text, at, the bytes of the run's windows)."""
    for batch in batches:
        for text, raw, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            whole = raw.as_buffer()
            view = memoryview(whole)
            gram, at, many = (runs.values.field(n).to_numpy(zero_copy_only=False) for n in ("gram", "at", "many"))
            start, _, n = unpacked(at)
            own = [bytes(view[a : a + k - 1 + WINDOW]) for a, k in zip(start.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(many), pa.array(np.full(len(at), text, np.int64)), pa.array(at), pa.array(own, pa.binary())], names=["gram", "many", "text", "at", "raw"])


def _prints(raws: list[bytes], n: np.ndarray) -> np.ndarray:
    """The window fingerprints of all runs, some thousand runs at a time."""
    out = [np.zeros(0, np.uint64)]
    for i in range(0, len(raws), 2048):
        part = raws[i : i + 2048]
        sizes = np.array([len(r) for r in part])
        out.append(window_prints(np.frombuffer(b"".join(part), np.uint8), np.cumsum(sizes) - sizes, n[i : i + 2048]))
    return np.concatenate(out)


def _windows(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """A row a window: (place of its run in the batch, gram, offset of the anchor, fingerprint, start)."""
    start, before, n = unpacked(batch.column("at").to_numpy())
    run = np.repeat(np.arange(len(n)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return run, batch.column("gram").to_numpy()[run], before[run] - step, _prints(batch.column("raw").to_pylist(), n), start[run] + step


_SPAN = "text long, start long, n long"


def _spans(text: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Windows that begin at (text, start), in order, as stretches of neighbours."""
    fresh = _starts(text, start - np.arange(len(start)))
    at = np.flatnonzero(fresh)
    return pa.RecordBatch.from_arrays([pa.array(text[at]), pa.array(start[at]), pa.array(np.diff(np.append(at, len(fresh))))], names=["text", "start", "n"])


def _told_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by gram to the stretches of windows that two of a gram share; holds whole grams of ``TOGETHER`` runs at most."""

    def told(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        run, gram, offset, print_, start = _windows(rows)
        order = np.lexsort((print_, offset, gram))
        first = _starts(gram[order], offset[order], print_[order])
        size = np.diff(np.append(np.flatnonzero(first), len(first)))
        hit = np.sort(order[np.repeat(size > 1, size)])
        if len(hit):
            yield _spans(rows.column("text").to_numpy()[run[hit]], start[hit])

    held: pa.Table | None = None
    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        gram = held.column("gram").to_numpy()
        cut = int(np.searchsorted(gram, gram[-1])) if len(gram) else 0
        if cut:
            yield from told(held.slice(0, cut).combine_chunks().to_batches()[0])
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield from told(held.combine_chunks().to_batches()[0])


def _dealt_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 2048):
            part = batch.slice(i, 2048)
            run, gram, offset, print_, start = _windows(part)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(offset), pa.array(print_.view(np.int64)), part.column("text").take(pa.array(run)), pa.array(start)], names=["gram", "offset", "print", "text", "start"])


def _window_marks(apart: DataFrame, texts: DataFrame) -> DataFrame:
    """The stretches of windows (text, start, n) that runs with one gram share although the runs differ.

    ``apart``: (gram, text, at); ``texts``: (id, text) with each text once.
    """
    rows, _ = _saved(apart.distinct(), "apart")
    many = rows.groupBy("gram").count().where(F.col("count") > TOGETHER).select("gram", F.lit(True).alias("many"))
    runs = rows.join(many, "gram", "left").withColumn("many", F.coalesce("many", F.lit(False)))
    by_text = runs.groupBy("text").agg(F.collect_list(F.struct("gram", "at", "many")).alias("runs")).withColumnRenamed("text", "id")  # a text's own runs
    cut, _ = _saved(texts.join(by_text, "id").select("id", "text", "runs").mapInArrow(_run_bytes, "gram long, many boolean, text long, at long, raw binary"), "runs")
    few = cut.where("not many").repartition("gram").sortWithinPartitions("gram").mapInArrow(_told_apart, _SPAN)
    windows = cut.where("many").mapInArrow(_dealt_windows, "gram long, offset long, print long, text long, start long")
    key = ["gram", "offset", "print"]
    shared = windows.groupBy(*key).agg(F.count("*").alias("c")).where("c > 1").select(*key)
    return few.unionByName(windows.join(shared, key).select("text", "start", F.lit(1).cast("long").alias("n")))


def _covered(spans: np.ndarray, size: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes of sorted (start, end) pairs."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _ids(df: DataFrame, text: Column) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``__id``, a hash of the text that no two different texts of the table share, and the ids of texts with copies."""
    for seed in range(100):
        named = df.withColumn("__id", F.xxhash64(F.lit(seed), text))
        ids = named.select("__id", F.xxhash64(F.lit("second"), text).alias("h"), F.octet_length(text).cast("long").alias("size"))
        copies, _ = _saved(ids.groupBy("__id").agg(F.count("*").alias("n"), F.max("size").alias("size"), F.min("h").alias("low"), F.max("h").alias("high")).where("n > 1"), "copies")
        if not copies.where("low <> high").limit(1).count():
            return named, copies.select("__id", "size")
    raise ValueError("no seed tells all texts apart")


def suffix_dedup(df: DataFrame, text: str = "text", batches: int = 4, piece: int = PIECE) -> DataFrame:
    """``df`` with n_bytes, n_removed, ``spans`` (array of start and end of the removed bytes) and ``kept`` (the bytes left).

    The table is taken in ``batches`` of about equal size (dealt by text), as a growing corpus would come.
    ``piece``: bytes of text that a task works on at a time; it changes no result.
    """
    spark = df.sparkSession
    docs = fewer(df, "n_bytes", "n_removed", "spans", "kept", "__id").withColumn("__raw", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary"))
    named, copies = _ids(docs, F.col("__raw"))
    long = named.where(F.octet_length("__raw") >= WINDOW).select(F.col("__id").alias("id"), F.col("__raw").alias("text"))
    family = SuffixFamily(spark, piece)
    for b in range(batches):
        family.add(long.where(F.pmod("id", F.lit(batches)) == b))
    once = long.groupBy("id").agg(F.any_value("text").alias("text"))
    at = F.col("at")
    before = F.shiftright(at, 8).bitwiseAND(255)
    marks = family.of_kind(MARK).select("text", (F.shiftright(at, 16) - before).alias("start"), at.bitwiseAND(255).alias("n"))
    marks = marks.unionByName(_window_marks(family.of_kind(APART), once))
    whole = copies.where(F.col("size") >= WINDOW).select(F.col("__id").alias("text"), F.lit(0).cast("long").alias("start"), (F.col("size") - WINDOW + 1).alias("n"))
    spans = marks.unionByName(whole).groupBy("text").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("n") + (WINDOW - 1)).alias("end")))).alias("spans"))
    spans, _ = _saved(spans.withColumnRenamed("text", "__id"), "spans")  # a text's own stretches
    rest = [c for c in docs.columns if c != "__raw"]

    def cut(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            sizes, gone, all_, kept = [], [], [], []
            for raw, own in zip(batch.column("__raw"), batch.column("spans").to_pylist(), strict=True):
                raw = raw.as_py()
                runs = _covered([(s["start"], s["end"]) for s in own or []], len(raw))
                edges = [0, *(x for run in runs for x in run), len(raw)]
                sizes.append(len(raw))
                gone.append(sum(b - a for a, b in runs))
                all_.append([{"start": a, "end": b} for a, b in runs])
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            more = [pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(all_, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + more, names=[*rest, "n_bytes", "n_removed", "spans", "kept"])

    joined = named.join(spans, "__id", "left").select(*[F.col(f"`{c}`") for c in rest], "__raw", "spans")
    out = joined.select(*[F.col(f"`{c}`") for c in rest]).withColumns({"n_bytes": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "spans": F.lit(None).cast("array<struct<start:long,end:long>>"), "kept": F.lit(None).cast("binary")})
    return joined.mapInArrow(cut, out.schema)
