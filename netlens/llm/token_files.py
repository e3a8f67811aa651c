"""Operator 2: token ids in binary segments with a shared zstandard dictionary.

A file set is a Parquet folder ``segments`` and the dictionary in ``dictionary``. A segment
is one binary value with its own index, so that one short document is read without its
neighbours:

    magic 8 bytes, dictionary hash u64, documents u32,
    keys i64 each, key-is-null u8 each, token counts u32 each, frame ends u32 each, frames

A frame is one document's ids as little-endian unsigned 32-bit integers, compressed alone
with the shared dictionary. The dictionary is trained on the first ``sample_chars`` characters of
``sample`` documents (those with the smallest key hashes): a bounded, documented sample, so that
the driver holds some megabytes however long the texts are; it changes sizes, never results.

Defined results: null and empty texts have only the end id; documents are in ascending key
order, null keys first, equal keys by text; an empty table gives no segments and no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import encoder, slices

MAGIC = b"NLTOK\x00\x01\x00"
HEAD = np.dtype([("magic", "S8"), ("dictionary", "<u8"), ("n", "<u4")])
SEGMENTS = "shard int, segment int, base long, n_docs int, n_tokens long, first_key long, last_key long, data binary"


def trained_dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary; too few samples to train on give an empty one."""
    if len(samples) < 8 or sum(map(len, samples)) < 16 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 8), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_hash(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw)


def _zdict(raw: bytes):
    return zstandard.ZstdCompressionDict(raw) if raw else None


def packed_segment(keys: list[int | None], counts: list[int], frames: list[bytes], dictionary: int) -> bytes:
    head = np.array([(MAGIC, dictionary, len(keys))], HEAD)
    return b"".join(
        [
            head.tobytes(),
            np.array([k or 0 for k in keys], "<i8").tobytes(),
            np.array([k is None for k in keys], "u1").tobytes(),
            np.array(counts, "<u4").tobytes(),
            np.cumsum([len(f) for f in frames], dtype="<u4").astype("<u4").tobytes(),
            *frames,
        ]
    )


class Segment:
    """Random access to the documents of one segment."""

    def __init__(self, data: bytes, dictionary: bytes):
        head = np.frombuffer(data, HEAD, 1)[0]
        if not data.startswith(MAGIC) or int(head["dictionary"]) != dictionary_hash(dictionary):
            raise ValueError("not a token segment of this dictionary")
        n, at = int(head["n"]), HEAD.itemsize
        self.keys = np.frombuffer(data, "<i8", n, at)
        self.is_null = np.frombuffer(data, "u1", n, at + 8 * n)
        self.counts = np.frombuffer(data, "<u4", n, at + 9 * n)
        self.ends = np.frombuffer(data, "<u4", n, at + 13 * n)
        self.data, self.body = data, at + 17 * n
        self.unpacker = zstandard.ZstdDecompressor(dict_data=_zdict(dictionary))

    def ids(self, i: int) -> bytes:
        start = self.body + (int(self.ends[i - 1]) if i else 0)
        return self.unpacker.decompress(self.data[start : self.body + int(self.ends[i])], max_output_size=4 * int(self.counts[i]))

    def find(self, key: int) -> list[int]:
        """The places of a key."""
        nulls = int(self.is_null.sum())
        return [int(i) + nulls for i in range(*np.searchsorted(self.keys[nulls:], [key, key + 1]))]


def write_token_files(df: DataFrame, path: str, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text", keeps_blanks: bool = False, sample: int = 512, sample_chars: int = 16 * 1024, dictionary_bytes: int = 64 * 1024, segment_bytes: int = 4 << 20, level: int = 3) -> None:
    """Encodes all texts and writes the file set under ``path`` (any folder that Spark writes)."""
    spark = df.sparkSession
    docs = df.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("t"))
    end = int(end_id).to_bytes(4, "little")
    chosen = [r.k for r in docs.select("k").where("k is not null").distinct().orderBy(F.xxhash64("k"), "k").limit(sample).collect()]
    texts = [r.t for r in docs.where(F.col("k").isin(chosen)).select(F.substring("t", 1, sample_chars).alias("t")).limit(2 * sample).collect()] if chosen else []
    raw = trained_dictionary([x + end for x in encoder(vocabulary, keeps_blanks).encode(texts)], dictionary_bytes)
    spark.createDataFrame([(dictionary_hash(raw) - (1 << 63), bytearray(raw))], "hash long, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, shard = encoder(vocabulary, keeps_blanks), TaskContext.get().partitionId()
        shared = _zdict(raw)
        if shared:
            shared.precompute_compress(level=level)  # else each frame digests it anew
        packer = zstandard.ZstdCompressor(level=level, dict_data=shared, write_content_size=True)
        own, no, base = dictionary_hash(raw), 0, 0
        keys: list = []
        counts: list[int] = []
        frames: list[bytes] = []
        held = 0

        def row() -> pa.RecordBatch:
            data = packed_segment(keys, counts, frames, own)
            values = ([shard], [no], [base], [len(keys)], [sum(counts)], [keys[0]], [keys[-1]], [data])
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in SEGMENTS.split(", ")])

        for batch in batches:
            for part in slices(batch):
                for k, ids in zip(part.column(0).to_pylist(), code.encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    keys.append(k)
                    counts.append(len(ids) // 4)
                    frames.append(packer.compress(ids))
                    held += len(frames[-1])
                    if held >= segment_bytes:
                        yield row()
                        no, base, held = no + 1, base + sum(counts), 0
                        keys, counts, frames = [], [], []
        if keys:
            yield row()

    ordered = docs.repartitionByRange(F.col("k").asc_nulls_first()).sortWithinPartitions(F.col("k").asc_nulls_first(), F.col("t").asc_nulls_first())
    ordered.mapInArrow(segments, SEGMENTS).write.option("compression", "none").parquet(f"{path}/segments")


def read_dictionary(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.schema("hash long, dictionary binary").parquet(f"{path}/dictionary").first().dictionary)


def read_token_files(spark: SparkSession, path: str, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row a document: key, start, n_tokens, ids_crc32 and, if asked for, the ids."""
    raw = read_dictionary(spark, path)
    files = spark.read.schema(SEGMENTS).parquet(f"{path}/segments")
    # as many rows as tasks wrote files
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    starts = totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                seg = Segment(data, raw)
                counts = seg.counts.astype(np.int64)
                ids = [seg.ids(i) for i in range(len(counts))]
                columns = [
                    pa.array(np.full(len(counts), shard, np.int32)),
                    pa.array(seg.keys, mask=seg.is_null.astype(bool)),
                    pa.array(base + np.cumsum(counts) - counts),
                    pa.array(counts),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                ]
                names = ["shard", "k", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in ids], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = "shard int, k long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    rows = files.select("shard", "base", "data").mapInArrow(documents, kinds).join(starts, "shard")
    return rows.select(F.col("k").alias(key), (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
