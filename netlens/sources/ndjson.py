"""Strict reading of event records, one JSON object a line.

Blank lines are skipped and count as lines. Unknown fields are ignored, absent optional ones
are null; a line that is no object, has an unknown tag, lacks a required field, or holds a
value of another type or out of range is an error: ``path:line: invalid event: reason``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import let
from ..schema import COLUMNS, U16, envelope
from .follow import GrowingLines
from .ranges import SLICE, line_blocks, lines_begun, listed, opened


class InvalidEvent(ValueError):
    """The first bad line, by path and line number."""


def _texts() -> T.StructType:
    """Every column as text, as it stands in the record."""
    return T.StructType([T.StructField(f.name, T.StringType()) for f in envelope().fields])


#: Values that some text columns are bound to.
_WORDS = {("alert", "severity"): ("low", "medium", "high"), ("http", "kind"): ("request", "response")}


def _rules() -> Column:
    """What each kind's columns must be, as one constant: kind -> columns in order."""
    rules = []
    for kind, columns in COLUMNS.items():
        own = []
        for n, t, needed in columns:
            most = 65535 if n in U16 else 255 if n == "rcode" else 2**63 - 1
            words = F.array(*[F.lit(w) for w in _WORDS.get((kind, n), ())]).cast("array<string>")
            own.append(F.struct(F.lit(n).alias("name"), F.lit("whole" if t in ("int", "long") else t).alias("type"), F.lit(needed).alias("needed"), F.lit(most).cast("decimal(38,0)").alias("most"), words.alias("words")))
        rules += [F.lit(kind), F.array(*own)]
    return F.create_map(*rules)


def _fault(fields: Column, rule: Column) -> Column:
    """What is wrong with the column of a rule in a record's fields; null if nothing is."""
    value = F.element_at(fields, rule["name"])
    raw, of = F.to_json(value), lambda t: rule["type"] == t
    words = F.try_variant_get(value, "$", "string")
    good = (
        F.when(of("string"), raw.startswith('"') & ((F.size(rule["words"]) == 0) | F.array_contains(rule["words"], words)))
        .when(of("boolean"), raw.isin("true", "false"))
        .when(of("double"), raw.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"))
        .when(of("whole"), F.when(raw.rlike("^[0-9]{1,38}$"), raw.cast("decimal(38,0)") <= rule["most"]))
        .otherwise(raw.startswith("[") & F.forall(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING"))
    )
    absent = value.isNull() | F.is_variant_null(value)
    return F.when(absent & rule["needed"], F.concat(F.lit("missing field "), rule["name"])).when(~absent & ~F.coalesce(good, F.lit(False)), F.concat(F.lit("bad value of "), rule["name"]))


#: How the schema of a variant shows the values that a column can have.
_SHOWN = {"string": "STRING", "boolean": "BOOLEAN", "double": r"BIGINT|DOUBLE|DECIMAL\(\d+,\d+\)", "int": "BIGINT", "long": "BIGINT", "array<string>": "ARRAY<(?:STRING|VOID)>"}


def _plain(shown: Column, parsed: Column) -> Column:
    """True for good records without unknown fields, as nearly all are; what is not plain goes through the rules.

    One pattern a kind tells the types of all fields by the record's schema (``shown``); ranges, words and nulls in
    arrays are looked at in the parsed columns.
    """
    out: Column | None = None
    for kind, columns in COLUMNS.items():
        fields = sorted([("event", "STRING", True), *[(n, _SHOWN[t], needed) for n, t, needed in columns]])
        pattern = "".join(f"(?:{n}: (?:{t if needed else t + '|VOID'})(?:, |>)){'' if needed else '?'}" for n, t, needed in fields)
        good = shown.rlike(f"^OBJECT<{pattern}$")
        for n, t, needed in columns:
            value = parsed[n]
            if t in ("int", "long"):
                fine = value.between(0, 65535 if n in U16 else 255 if n == "rcode" else 2**63 - 1)
                fine = fine if needed else F.coalesce(fine, ~shown.contains(f" {n}: BIGINT") & ~shown.contains(f"<{n}: BIGINT"))  # null or absent
            elif t == "double":
                fine = F.abs(value) < float("inf")
            elif t == "array<string>":
                fine = F.forall(value, lambda x: x.isNotNull())
            elif (kind, n) in _WORDS:
                fine = value.isin(*_WORDS[kind, n])
            else:
                continue
            good = good & fine
        own = parsed["event"] == kind
        out = F.when(own, good) if out is None else out.when(own, good)
    return F.coalesce(out, F.lit(False))


def _parsed(lines: DataFrame, value: str) -> DataFrame:
    """``lines`` with the record as a variant, its schema, and the envelope's struct."""
    return lines.select("*", F.try_parse_json(value).alias("__v"), F.from_json(value, envelope()).alias("__e")).select("*", F.schema_of_variant("__v").alias("__shown"))


def suspects(lines: DataFrame) -> DataFrame:
    """The lines that are not plain, through a generated row, so that the filter does not parse them again."""
    told = F.inline_outer(F.array(F.struct(_plain(F.col("__shown"), F.col("__e")).alias("__plain"))))
    return _parsed(lines, "value").select(*lines.columns, told).where("not __plain").drop("__plain")


def checked(lines: DataFrame, value: str = "value") -> DataFrame:
    """``lines`` with the envelope columns and ``error`` (null for a good event).

    Plain records are told by their schema. In all others the rules of their kind are data that one small
    expression goes through, so the plan does not grow with the number of columns.
    """
    text = F.col(value)
    own = {f.name for f in envelope().fields}
    rest = [c for c in lines.columns if c not in own]
    parsed = _parsed(lines.select(*rest, text.alias("__text")), "__text").drop("__text")
    tag = F.try_variant_get("__v", "$.event", "string")
    rules = F.element_at(_rules(), tag)
    faults = let(F.try_variant_get("__v", "$", "map<string,variant>"), lambda fields: F.filter(F.transform(rules, lambda r: _fault(fields, r)), lambda x: x.isNotNull()))
    error = F.when(_plain(F.col("__shown"), F.col("__e")), F.lit(None).cast("string"))
    error = error.when(F.col("__v").isNull() | ~F.col("__shown").startswith("OBJECT"), "not a JSON object")
    error = error.when(tag.isNull() | ~tag.isin(*COLUMNS), F.concat(F.lit("unknown event "), F.coalesce(tag, F.lit("(none)")))).otherwise(F.get(faults, F.lit(0)))
    # one generated row, through which no filter moves: a filter by error does not parse again
    told = F.struct(error.alias("error"), *[F.col(f"__e.{f.name}").alias(f.name) for f in envelope().fields])
    return parsed.select(*rest, F.inline_outer(F.array(told)))


def read_lines(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """(path, line_no, seq, value) of all non-blank lines; a folder gives its own *.ndjson files only.

    Files are read in slices of ``size`` bytes (unless given, a task slot's share of all bytes, from
    4 MB to 32 MB). A first job counts the lines that begin in each
    slice, and sums of these give each slice the number of its first line, in its file (``line_no``)
    and over all files by path (``seq``); so any task reads numbered lines on its own.
    """
    fs, root = opened(path)
    if fs.get_file_info(root).type == arrow_fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [(name, n) for name, n in listed(path, ".ndjson") if n]
    size = size or min(SLICE, max(SLICE // 8, sum(n for _, n in files) // spark.sparkContext.defaultParallelism))
    tasks = [(name, at, min(at + size, n), n) for name, n in files for at in range(0, n, size)]
    schema = "path string, at long, end long, size long"
    dealt = spark.createDataFrame(tasks, schema).repartition(max(len(tasks), 1))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(path)
        for batch in batches:
            rows = [r.values() for r in batch.to_pylist()]
            lines = [lines_begun(fs, name, at, end) for name, at, end, _ in rows]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("at"), pa.array(lines, pa.int64())], names=["path", "at", "lines"])

    begun = {(r.path, r.at): r.lines for r in dealt.mapInArrow(counted, "path string, at long, lines long").collect()} if tasks else {}  # a number a slice
    seqs = [0, *accumulate(begun[t[:2]] for t in tasks)]
    heads = {t[0]: seq for t, seq in zip(tasks, seqs, strict=False) if t[1] == 0}
    placed = [(*t, seq - heads[t[0]], seq) for t, seq in zip(tasks, seqs, strict=False)]
    numbered = spark.createDataFrame(placed, f"{schema}, line_no long, seq long").repartition(max(len(tasks), 1))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(path)
        for batch in batches:
            for name, at, end, whole, line_no, seq in (r.values() for r in batch.to_pylist()):
                with fs.open_input_file(name) as file:
                    for part in line_blocks(file, at, end, whole):
                        n = len(part)
                        numbers = [pa.array(range(first + 1, first + n + 1), pa.int64()) for first in (line_no, seq)]
                        line_no, seq = line_no + n, seq + n
                        yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), *numbers, pa.array([x.decode(errors="replace") for x in part], pa.string())], names=["path", "line_no", "seq", "value"])

    return numbered.mapInArrow(lines, "path string, line_no long, seq long, value string").where(F.col("value").rlike(r"\S"))


def read_events(spark: SparkSession, path: str, strict: bool = True, size: int | None = None) -> DataFrame:
    """Events with ``seq``. Strict: the first bad line raises; else bad rows keep their ``error``."""
    lines = read_lines(spark, path, size)
    if not strict:
        return checked(lines)
    bad = checked(suspects(lines)).where("error is not null").orderBy("seq").select("path", "line_no", "error").limit(1).collect()
    if bad:
        raise InvalidEvent(f"{bad[0].path}:{bad[0].line_no}: invalid event: {bad[0].error}")
    return lines.select("seq", F.inline_outer(F.array(F.from_json("value", envelope()))))  # all are good: only their values are left to read


def read_alert_file(spark: SparkSession, path: str) -> DataFrame:
    """The alerts of one file; other kinds are skipped, bad lines raise."""
    return read_events(spark, path).where(F.col("event") == "alert")


def follow_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the whole lines of a folder's growing files as events, with their path and place; bad lines keep their ``error``."""
    spark.dataSource.register(GrowingLines)
    lines = spark.readStream.format("growing_lines").option("path", path).load()
    return checked(lines.where(F.trim("value") != "").withColumnRenamed("start", "place"))


def read_watchlist(spark: SparkSession, path: str) -> list[str]:
    """The domains of a watch list in order: one a line, blank and # lines skipped.

    The rules take the list as a parameter; it is written by hand and small.
    """
    text = spark.read.text(path, wholetext=True).first()
    return [s for line in (text.value.split("\n") if text else []) if (s := line.strip()) and not s.startswith("#")]
