"""Ordered greedy choices over a whole table, without a task that sees all of it.

A chain holds one number, its state. It goes through rows in order; the first row whose ``key``
is at least the state is taken, the state becomes that row's ``mark``, and so on. What a task's
rows do to any state they may be entered with is a step function (``Steps``), made by pointer
jumping. The functions of neighbouring tasks are composed as a tree, which gives the state that
each task is entered with, and a second pass takes the rows. So a task holds two numbers a row of
its own range, and the driver one number a task.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The state before anything was taken. Functions that a task composes.
NONE, FAN = -(1 << 62), 32


class Steps:
    """A function from states to states: ``value[i]`` up to ``upto[i]``, beyond the last the state itself."""

    def __init__(self, upto: np.ndarray, value: np.ndarray):
        last = np.ones(len(value), bool)
        last[:-1] = value[1:] != value[:-1]
        self.upto, self.value = upto[last], value[last]

    def __call__(self, states: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.upto, states, "left")
        inside = at < len(self.upto)
        out = states.copy()
        out[inside] = self.value[at[inside]]
        return out

    def then(self, after: Steps) -> Steps:
        beyond = after.upto > (self.upto[-1] if len(self.upto) else np.iinfo(np.int64).min)
        return Steps(np.concatenate([self.upto, after.upto[beyond]]), np.concatenate([after(self.value), after.value[beyond]]))


def _candidates(key: np.ndarray) -> np.ndarray:
    """Only rows whose key no earlier one exceeds can be taken: what was passed over had a key below the state."""
    return np.flatnonzero(key >= np.maximum.accumulate(key)) if len(key) else np.zeros(0, np.int64)


def steps(key: np.ndarray, mark: np.ndarray, most: int | None = None) -> Steps:
    """The function of rows in order. ``most``: a bound of the states that they can be entered with."""
    own = _candidates(key)
    key, mark = key[own], mark[own]
    n = len(key)
    after = np.append(np.maximum(np.arange(n) + 1, np.searchsorted(key, mark, "left")), n)
    last = np.where(after < n, after, np.arange(n + 1))  # the end of each row's chain, by doubling
    while (further := last[last]).tolist() != last.tolist():
        last = further
    if most is not None:
        n = min(n, int(np.searchsorted(key, most, "left")) + 1)
    return Steps(key[:n], mark[last[:n]])


def taken(key: np.ndarray, mark: np.ndarray, state: int) -> list[int]:
    """The rows that a chain takes from a state on."""
    own = _candidates(key)
    key, mark, out = key[own], mark[own], []
    at = int(np.searchsorted(key, state, "left"))
    while at < len(key):
        out.append(int(own[at]))
        at = max(at + 1, int(np.searchsorted(key, mark[at], "left")))
    return out


def in_order(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` in ranges of ``order``, sorted, as a checkpoint: its partitions stay as they are for all later passes."""
    spark = rows.sparkSession
    shared_folder(spark)
    return rows.repartitionByRange(order).sortWithinPartitions(order).checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share: spark.checkpoint.dir, or a new local one where it is unset (tests)."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


Numbers = Callable[[int, Iterable[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]]
_TABLE = "part int, upto array<long>, value array<long>"


def _row(part: int, f: Steps) -> pa.RecordBatch:
    lists = [pa.array([x], pa.list_(pa.int64())) for x in (f.upto, f.value)]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *lists], names=["part", "upto", "value"])


def _functions(table: pa.Table) -> list[tuple[int, Steps]]:
    table = table.sort_by("part")
    own = [[x.values.to_numpy() for x in table.column(c)] for c in ("upto", "value")]
    return [(p, Steps(u, v)) for p, u, v in zip(table.column("part").to_pylist(), *own, strict=True)]


def _entered(tables: DataFrame, parts: int, start: DataFrame) -> DataFrame:
    """(part, state): the state that each part is entered with; ``start``: (up, state) of each group of ``FAN`` parts."""

    def along(key: tuple, own: pa.Table, first: pa.Table) -> pa.Table:
        state, out = np.array([first.column("state")[0].as_py()]), []
        functions = _functions(own)
        for _, f in functions:
            out.append(int(state[0]))
            state = f(state)
        return pa.table({"part": pa.array([p for p, _ in functions], pa.int32()), "state": pa.array(out, pa.int64())})

    dealt = tables.withColumn("up", F.expr(f"part div {FAN}").cast("int"))
    return dealt.groupBy("up").cogroup(start.groupBy("up")).applyInArrow(along, "part int, state long")


def _composed(tables: DataFrame) -> DataFrame:
    def composed(key: tuple, own: pa.Table) -> pa.Table:
        functions = [f for _, f in _functions(own)]
        all_ = functions[0]
        for f in functions[1:]:
            all_ = all_.then(f)
        return pa.Table.from_batches([_row(key[0].as_py(), all_)])

    return tables.withColumn("up", F.expr(f"part div {FAN}").cast("int")).groupBy("up").applyInArrow(composed, _TABLE)


def entry_states(base: DataFrame, numbers: Numbers, start: int, parts: int, bounded: bool) -> list[int]:
    """The state that each partition of ``base`` is entered with."""
    if parts <= 1:
        return [start] * parts

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        got = [(k, m) for _, k, m in numbers(part, batches)]
        key, mark = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*got, strict=True) if got else ((), ())))
        yield _row(part, steps(key, mark, int(mark[0]) if bounded and len(mark) else None))

    levels = [base.mapInArrow(table, _TABLE).checkpoint()]
    sizes = [parts]
    while sizes[-1] > FAN:
        levels.append(_composed(levels[-1]).checkpoint())
        sizes.append(-(-sizes[-1] // FAN))
    spark = base.sparkSession
    states = spark.createDataFrame([(0, start)], "up int, state long")
    for level, size in zip(levels[::-1], sizes[::-1], strict=True):
        states = _entered(level, size, states).withColumnRenamed("part", "up")
    out = [start] * parts
    for r in states.collect():  # a number a task
        out[r.up] = r.state
    return out


def chain(base: DataFrame, numbers: Numbers, start: int = NONE, bounded: bool = False, all_rows: bool = False) -> DataFrame:
    """The rows of ``base`` (from ``in_order``) that a chain takes, or all rows, with ``state`` once a row was seen.

    ``numbers(part, batches)`` gives each batch with its keys and marks. ``bounded``: no state is
    beyond the mark of a row that it comes to.
    """
    states = entry_states(base, numbers, start, base.rdd.getNumPartitions(), bounded)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        state = states[part]
        for batch, key, mark in numbers(part, batches):
            own = np.array(taken(key, mark, state), np.int64)
            after = np.full(len(key), state, np.int64)
            if len(own):
                at = np.searchsorted(own, np.arange(len(key)), "right")
                after = np.where(at > 0, mark[own][np.maximum(at - 1, 0)], state)
                state = int(mark[own[-1]])
            batch = batch.append_column("state", pa.array(after))
            yield batch if all_rows else batch.take(pa.array(own))

    return base.mapInArrow(walked, T.StructType([*base.schema.fields, T.StructField("state", T.LongType())]))


def gaps(time: str, gap: int) -> Numbers:
    """Rows at least ``gap`` after the last one taken, by a column of whole numbers."""

    def numbers(part: int, batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            t = batch.column(batch.schema.get_field_index(time)).to_numpy(zero_copy_only=False)
            yield batch, t - gap, t

    return numbers


def byte_cuts(base: DataFrame, size: str, most: int) -> DataFrame:
    """``base`` with ``state``: where the row's file begins, in bytes of all rows before it.

    A file takes rows as long as it has at most ``most`` bytes; a longer row is a file of its own.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(int(b.column(0).to_numpy().sum()) for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total], pa.int64())], names=["part", "n"])

    parts = base.rdd.getNumPartitions()
    own = [0] * parts
    for r in base.select(F.col(size).cast("long")).mapInArrow(summed, "part int, n long").collect():  # a number a task
        own[r.part] = r.n
    before = [0, *np.cumsum(own).tolist()]

    def numbers(part: int, batches: Iterable[pa.RecordBatch]):
        at = before[part]
        for batch in batches:
            n = batch.column(batch.schema.get_field_index(size)).to_numpy().astype(np.int64)
            end = at + np.cumsum(n)
            begin = end - n
            yield batch, np.minimum(end - most, begin) - 1, begin
            at = int(end[-1]) if len(end) else at

    return chain(base, numbers, 0, bounded=True, all_rows=True)
