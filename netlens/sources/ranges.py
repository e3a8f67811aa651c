"""Byte ranges of files: what the readers of growing and of very large files share.

Files are reached through Arrow's file systems (local and mounted folders, HDFS, S3, GCS), as
Spark's own readers give no byte places.
"""

from __future__ import annotations

from pyarrow import fs as arrow_fs

#: Bytes that a task reads.
SLICE = 32 << 20


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return arrow_fs.FileSystem.from_uri(path)


def listed(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(path, size) of a folder's own files, or of a file, by name; hidden ones are left out, as is a folder that is not there."""
    fs, root = opened(path)
    if fs.get_file_info(root).type == arrow_fs.FileType.File:
        return [(root, fs.get_file_info(root).size)]
    found = fs.get_file_info(arrow_fs.FileSelector(root, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.type == arrow_fs.FileType.File and f.base_name.endswith(suffix) and f.base_name[0] not in "._")


def read_range(file, start: int, end: int) -> bytes:
    file.seek(start)
    return file.read(end - start)


def last_line_end(file, start: int, end: int, step: int = 64 << 10) -> int:
    """The place after the last line feed in a range; its start if there is none. Looks from the end backwards."""
    while end > start:
        begin = max(start, end - step)
        at = read_range(file, begin, end).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        end = begin
    return start


def lines_in(file, start: int, end: int, limit: int, block: int = 1 << 20):
    """(place, line) of the lines that begin in [start, end); ``limit``: where whole lines end.

    ``start`` counts as a line's begin if it is 0 or follows a line feed; else the first line
    belongs to the range before.
    """
    at = start
    if start > 0:
        at = _after_feed(file, start - 1, limit, block)
    rest, place = b"", at
    while place < end and at < limit:
        more = read_range(file, at, min(at + block, limit))
        if not more:
            return
        at += len(more)
        rest += more
        *whole, rest = rest.split(b"\n")
        for line in whole:
            if place >= end:
                return
            yield place, line
            place += len(line) + 1


def lines_begun(fs: arrow_fs.FileSystem, path: str, start: int, end: int, block: int = 1 << 20) -> int:
    """How many lines begin in [start, end): one at the file's begin and one after each line feed."""
    with fs.open_input_file(path) as file:
        feeds = sum(read_range(file, at, min(at + block, end - 1)).count(b"\n") for at in range(max(start - 1, 0), end - 1, block))
    return feeds + (start == 0 < end)


def line_blocks(file, start: int, end: int, size: int, block: int = 4 << 20):
    """The lines that begin in [start, end) of a file of ``size`` bytes, some ``block`` bytes at a time; the last line may lack its line feed."""
    at = _after_feed(file, start - 1, size, block) if start else 0
    while at < end:
        last = min(at + block, end)
        upto = size if last >= size else _after_feed(file, last - 1, size, block)
        lines = read_range(file, at, upto).split(b"\n")
        yield lines if lines[-1] else lines[:-1]
        at = upto


def _after_feed(file, at: int, limit: int, block: int) -> int:
    while at < limit:
        part = read_range(file, at, min(at + block, limit))
        found = part.find(b"\n")
        if found >= 0:
            return at + found + 1
        if not part:
            return limit
        at += len(part)
    return limit
