"""Session-level helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word separators of the contracts: blank and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a new local one where it is unset (tests)."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("netlens.scratch.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("netlens.scratch.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch while a table is written: each Python task holds a batch on either side.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"
#: Shuffle files go when their query ends, not when the driver happens to collect its garbage.
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The folders of written tables, by DataFrame.
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


@contextmanager
def work_settings(spark: SparkSession) -> Iterator[None]:
    """Small Arrow batches, and no shuffle files that outlive their query: for working tables and counts."""
    own = {BATCH_SETTING: BATCH_BYTES, CLEANUP_SETTING: "true"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def written(df: DataFrame, name: str, *parts: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: a plan cut that survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with work_settings(spark):
        df.write.partitionBy(*parts).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` gave, once all that is made from them is written."""
    for df in tables:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop(df))
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, also where lambdas in ``body`` use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fewer(df: DataFrame, *outputs: str) -> DataFrame:
    """``df`` without columns that an operator is about to add: its own win over clashing names."""
    own = {x.lower() for x in outputs}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in own])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
