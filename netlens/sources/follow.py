"""Following a folder of files that grow, as a stream.

Spark's file stream takes each file once, so lines added to a file that it has seen never come.
Here the offset of the stream is the place after the last whole line of each file: what was
added since the last micro-batch is read, a line without its end waits, and a restart goes on
from the checkpoint's places. A file that became shorter counts from its new end, one that is
gone keeps its place.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .ranges import SLICE, last_line_end, lines_in, listed, opened

LINES = "path string, start long, value string"


class _Slice(InputPartition):
    def __init__(self, path: str, start: int, end: int, limit: int):
        self.path, self.start, self.end, self.limit = path, start, end, limit


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.suffix, self.slice = options["path"], options.get("suffix", ".ndjson"), int(options.get("slice", SLICE))
        self.ends: dict[str, tuple[int, int]] = {}  # size that was looked at, and where its whole lines end

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        fs, _ = opened(self.path)
        for path, size in listed(self.path, self.suffix):
            seen, end = self.ends.get(path, (-1, 0))
            if size != seen:
                with fs.open_input_file(path) as file:
                    self.ends[path] = size, last_line_end(file, min(end, size), size)
        return {p: end for p, (_, end) in self.ends.items()}

    def partitions(self, start: dict, end: dict):
        out = []
        for path, limit in sorted(end.items()):
            begin = start.get(path, 0)
            out += [_Slice(path, at, min(at + self.slice, limit), limit) for at in range(begin, limit, self.slice)]
        return out

    def read(self, partition: _Slice) -> Iterator[tuple]:
        fs, _ = opened(self.path)
        try:
            file = fs.open_input_file(partition.path)
        except FileNotFoundError:  # taken away meanwhile
            return
        with file:
            for place, line in lines_in(file, partition.start, partition.end, partition.limit):
                if line:
                    yield partition.path, place, line.decode(errors="replace")

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    """``spark.readStream.format("growing_lines")`` of a folder: path, place and text of each whole line that is not empty."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Reader(self.options)
