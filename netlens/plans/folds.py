"""Ordered greedy folds: what is kept depends on what was kept before."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chains import NONE, chain, gaps, in_order


def _greedy(times: np.ndarray, gap: int, last: int | None) -> tuple[np.ndarray, int | None]:
    keep = np.zeros(len(times), bool)
    for i, t in enumerate(times.tolist()):
        if last is None or t - last >= gap:
            keep[i], last = True, t
    return keep, last


def greedy_gaps(rows: DataFrame, keys: list[str], time: str, gap: int, order: str = "seq", start: int | None = None) -> DataFrame:
    """The rows of each key that come ``gap`` or more after the last kept one, in the given order.

    Spark deals and sorts the rows by key; a task streams them and holds only the last kept
    time, so a hot key costs no memory. Without keys the one sequence is cut in ranges whose
    effects are composed (``chains``). ``start``: a time kept before the first row.
    """
    if not keys:
        return chain(in_order(rows, order), gaps(time, gap), NONE if start is None else start).drop("state")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, start
        for batch in batches:
            if not batch.num_rows:
                continue
            times = batch.column(batch.schema.get_field_index(time)).to_numpy(zero_copy_only=False)
            names = list(zip(*[batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys], strict=True))
            starts = [0] + [i for i in range(1, len(names)) if names[i] != names[i - 1]] + [len(names)]
            mask = []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if names[a] != key:
                    key, last = names[a], start
                own, last = _greedy(times[a:b], gap, last)
                mask.append(own)
            yield batch.filter(pa.array(np.concatenate(mask)))

    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(kept, rows.schema)


def cooldown(alerts: DataFrame, gap: int, time: str = "ts_us", order: str = "seq") -> DataFrame:
    """Alerts that are not within ``gap`` of the last kept one of their (name, src)."""
    return greedy_gaps(alerts, ["name", "src"], time, gap, order)
