"""Frames from capture files and from a synthetic source, as Python data sources.

Both give frame_no, ts, wire_len and data. A capture file is read in slices, a task each.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .ranges import SLICE, listed, opened, read_range

FRAMES = "frame_no long, ts timestamp, wire_len int, data binary"
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}


def capture_records(raw: bytes) -> Iterator[tuple[int, datetime, int, bytes]]:
    """The frames of one capture file; a cut record raises, a clean end does not."""
    order, nanos = _kind(raw)
    return _records(raw, 24, len(raw), 0, order, nanos)


def _kind(head: bytes) -> tuple[str, int]:
    if head[:4] not in _MAGIC or len(head) < 24:
        raise ValueError("not a capture file")
    return _MAGIC[head[:4]]


def _records(raw: bytes, at: int, end: int, no: int, order: str, nanos: int) -> Iterator[tuple[int, datetime, int, bytes]]:
    """The records that begin in raw[at:end]."""
    head = struct.Struct(f"{order}4I")
    while at < end:
        if at + 16 > len(raw):
            raise ValueError(f"record {no} is cut")
        seconds, part, size, wire = head.unpack_from(raw, at)
        if at + 16 + size > len(raw):
            raise ValueError(f"record {no} is cut")
        yield no, _EPOCH + timedelta(seconds=seconds, microseconds=part // nanos), wire, raw[at + 16 : at + 16 + size]
        at, no = at + 16 + size, no + 1


#: Headers in a row that must look like records for a place to be taken as a likely record start.
_LIKELY = 8


def _likely(raw: bytes, order: str, nanos: int) -> int | None:
    """The first place in a slice from which records seem to follow one another. A guess: it is used only if the records before lead to it."""
    head = struct.Struct(f"{order}4I")
    most = 1_000_000 * nanos

    def fits(at: int) -> bool:
        for _ in range(_LIKELY):
            if at + 16 > len(raw):
                return True
            _, part, size, wire = head.unpack_from(raw, at)
            if part >= most or size > 262_144 or size > wire:
                return False
            at += 16 + size
        return True

    return next((at for at in range(max(len(raw) - 16, 0)) if fits(at)), None)


def capture_slices(spark: SparkSession, files: list[tuple[str, int]], path: str, size: int) -> list[tuple[str, int, int, int, int]]:
    """(file, first record's place, end of its slice, number of the first record, file size) for all slices that begin a record.

    Records have no marks between them, so where a slice's first record begins depends on all
    records before it. Each slice is walked from a likely start, all at once; then one number a
    slice is followed from the front: where the guess was wrong, that slice alone is walked again.
    """

    def heads(tasks: list[tuple]) -> dict[tuple[str, int], tuple]:
        def walk(batches):
            import pyarrow as pa

            fs, _ = opened(path)
            for batch in batches:
                for name, start, end, entry in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    with fs.open_input_file(name) as file:
                        order, nanos = _kind(read_range(file, 0, 24))
                        raw = read_range(file, start, end + 12)  # a header may be cut
                    own = raw[: end - start]
                    at = (24 - start if start < 24 else _likely(own, order, nanos)) if entry is None else entry - start
                    if at is None:
                        yield pa.RecordBatch.from_pylist([{"name": name, "start": start, "entry": None, "exit": None, "n": None}], schema)
                        continue
                    exit_, n = _walk_in(raw, at, end - start, order)
                    yield pa.RecordBatch.from_pylist([{"name": name, "start": start, "entry": start + at, "exit": start + exit_, "n": n}], schema)

        import pyarrow as pa

        schema = pa.schema([("name", pa.string()), ("start", pa.int64()), ("entry", pa.int64()), ("exit", pa.int64()), ("n", pa.int64())])
        dealt = spark.createDataFrame(tasks, "name string, start long, end long, entry long").repartition(len(tasks))
        return {(r.name, r.start): (r.entry, r.exit, r.n) for r in dealt.mapInArrow(walk, "name string, start long, entry long, exit long, n long").collect()}  # a row a slice

    tasks = [(name, at, min(at + size, length), None) for name, length in files for at in range(0, max(length, 1), size)]
    found = heads(tasks) if tasks else {}
    out = []
    for name, length in files:
        at, no = 24, 0
        for start in range(0, max(length, 1), size):
            end = min(start + size, length)
            if at >= end:
                continue
            entry, exit_, n = found[name, start]
            if entry != at:
                _, exit_, n = heads([(name, start, end, at)])[name, start]
            out.append((name, at, end, no, length))
            at, no = exit_, no + n
    return out


def _walk_in(raw: bytes, at: int, end: int, order: str) -> tuple[int, int]:
    """(where the first record beyond ``end`` begins, how many begin before it) from a record start on."""
    size, n = struct.Struct(f"{order}I"), 0
    while at < end:
        n += 1
        at += 16 + (size.unpack_from(raw, at + 8)[0] if at + 12 <= len(raw) else 0)  # a cut header ends the file
    return at, n


def read_captures(spark: SparkSession, path: str, size: int = SLICE) -> DataFrame:
    """All frames of the capture files under a path, with their file; frame_no counts within a file.

    A file is cut in slices of ``size`` bytes, a task each, so its size has no limit. A cut record
    at a file's end raises.
    """
    slices = capture_slices(spark, listed(path), path, size)
    dealt = spark.createDataFrame(slices, "path string, at long, end long, no long, length long").repartition(max(len(slices), 1))

    def frames(batches):
        import pyarrow as pa

        fs, _ = opened(path)
        for batch in batches:
            for name, at, end, no, length in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                with fs.open_input_file(name) as file:
                    order, nanos = _kind(read_range(file, 0, 24))
                    raw = read_range(file, at, min(end + 16, length))
                    over = _walk_in(raw, 0, end - at, order)[0] - len(raw)
                    raw += read_range(file, at + len(raw), min(at + len(raw) + max(over, 0), length))
                part: list[tuple] = []
                for record in _records(raw, 0, end - at, no, order, nanos):
                    part.append(record)
                    if len(part) == 4096:
                        yield _arrow(pa, name, part)
                        part = []
                if part:
                    yield _arrow(pa, name, part)

    return dealt.mapInArrow(frames, f"path string, {FRAMES}")


def _arrow(pa, name: str, rows: list[tuple]):
    no, ts, wire, data = zip(*rows, strict=True)
    kinds = (pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(([name] * len(rows), no, ts, wire, data), kinds, strict=True)], names=["path", "frame_no", "ts", "wire_len", "data"])


class _Draws:
    """The synthetic source's numbers: a 64-bit linear congruential sequence."""

    # Multiplier and increment.
    MULTIPLIER, INCREMENT = 6364136223846793005, 1442695040888963407

    def __init__(self, seed: int):
        self.state = seed & (2**64 - 1)

    def long(self) -> int:
        self.state = (self.state * self.MULTIPLIER + self.INCREMENT) & (2**64 - 1)
        return self.state

    def word(self) -> int:
        return self.long() >> 32

    def below(self, n: int) -> int:
        return self.word() % n

    def raw(self, n: int) -> bytes:
        words = b"".join(self.word().to_bytes(4, "little") for _ in range(-(-n // 4)))
        return words[:n]

    def mac(self) -> bytes:
        m = self.raw(6)
        return bytes([m[0] & 0xFE | 0x02]) + m[1:]


def synthetic_frames(seed: int) -> Iterator[bytes]:
    """Endless frames: 85 % IPv4, 8 % IPv6, 5 % ARP, 2 % other, and drills at fixed counts.

    Before frame 500, 1000, ... a scan of 15 ports is played, before 1500, 3000, ... two MACs
    that claim one address.
    """
    d, count = _Draws(seed), 0

    def ethernet(kind: int, body: bytes) -> bytes:
        target = d.mac()
        d.mac()  # the sequence draws the sender twice
        return target + d.mac() + kind.to_bytes(2, "big") + body

    def padded(frame: bytes, n: int) -> bytes:
        return frame + bytes(max(0, n - len(frame)))

    fixed = bytes.fromhex("020000000001020000000002")
    while True:
        count += 1
        if count % 500 == 0:
            for i in range(15):
                tcp = struct.pack(">2H2I2B3H", 40000 + i, 1000 + i, 0, 0, 5 << 4, 2, 64240, 0, 0)
                ip = struct.pack(">2B3H2BH4s4s", 0x45, 0, 40, 0, 0, 64, 6, 0, bytes([192, 0, 2, 66]), bytes([198, 51, 100, 7]))
                yield padded(fixed + b"\x08\x00" + ip + tcp, 60)
        if count % 1500 == 0:
            for i in range(4):
                claim = struct.pack(">2H2BH6s4s6s4s", 1, 0x0800, 6, 4, 2, bytes([0xAA] * 5 + [1 + i % 2]), bytes([10, 0, 0, 5]), bytes(6), bytes([10, 0, 0, 5]))
                yield padded(fixed + b"\x08\x06" + claim, 60)
        roll = d.below(100)
        if roll < 85:
            body = d.raw(20 + d.below(61))
            ports = [d.below(65535) + 1 for _ in range(2)]
            udp = struct.pack(">4H", *ports, 8 + len(body), 0) + body
            no = d.word() & 0xFFFF
            frame = ethernet(0x0800, struct.pack(">2B3H2BH2I", 0x45, 0, 20 + len(udp), no, 0x4000, 64, 17, 0, d.word(), d.word()) + udp)
        elif roll < 93:
            body = d.raw(20 + d.below(61))
            head = 6 << 28 | (d.word() & 0xFF) << 20 | d.word() & 0xFFFFF
            ends = b"".join(d.long().to_bytes(8, "big") for _ in range(4))
            frame = ethernet(0x86DD, struct.pack(">IH2B", head, len(body), 17, 64) + ends + body)
        elif roll < 98:
            parts = [d.mac(), d.word().to_bytes(4, "big"), d.mac(), d.word().to_bytes(4, "big")]
            frame = ethernet(0x0806, struct.pack(">2H2BH", 1, 0x0800, 6, 4, 1 + d.below(2)) + b"".join(parts))
        else:
            frame = ethernet(0x88CC, d.raw(8 + d.below(13)))
        yield padded(frame, 60 + d.below(341))


class _SyntheticReader(DataSourceReader):
    def __init__(self, options: dict):
        self.seed, self.n = int(options.get("seed", 42)), int(options.get("frames", 1000))
        self.start, self.pps = float(options.get("start_ts", 0)), float(options.get("pps", 1000))

    def partitions(self):
        return [InputPartition(0)]  # how many numbers a frame draws depends on all frames before it

    def read(self, partition):
        for no, frame in zip(range(self.n), synthetic_frames(self.seed)):
            yield no, _EPOCH + timedelta(microseconds=round((self.start + no / self.pps) * 1e6)), len(frame), frame


class SyntheticFrames(DataSource):
    """``spark.read.format("synthetic_frames")`` with seed, frames, start_ts and pps."""

    @classmethod
    def name(cls) -> str:
        return "synthetic_frames"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> DataSourceReader:
        return _SyntheticReader(self.options)


def read_synthetic(spark: SparkSession, seed: int = 42, frames: int = 1000, start_ts: float = 0.0, pps: float = 1000.0) -> DataFrame:
    spark.dataSource.register(SyntheticFrames)
    return spark.read.format("synthetic_frames").options(seed=seed, frames=frames, start_ts=start_ts, pps=pps).load()


def rate(snapshots: DataFrame) -> DataFrame:
    """Frames a second between (ts, frames) snapshots; 0 where no time went by."""
    from pyspark.sql import Window

    order = Window.orderBy("ts")
    gap = F.col("ts") - F.lag("ts").over(order)
    return snapshots.withColumn("pps", F.when(gap > 0, (F.col("frames") - F.lag("frames").over(order)) / gap).otherwise(0.0))
