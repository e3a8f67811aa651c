"""Scalar functions of the engine as columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UNITS = {"s": 1, "m": 60, "h": 3600}
_MOST = 2**63 - 1


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def severity_rank(severity: Column) -> Column:
    """low 1, medium 2, high 3."""
    return F.when(severity == "low", 1).when(severity == "medium", 2).when(severity == "high", 3)


def parse_severity(text: Column) -> Column:
    """Trimmed and lower-cased low, medium or high; else null."""
    value = F.lower(F.trim(text))
    return F.when(value.isin("low", "medium", "high"), value)


def parse_duration(text: Column) -> Column:
    """Seconds of ``30s``, ``10m``, ``1H`` or ``90``; null for anything else; saturates."""
    value = F.lower(F.trim(text))
    number = F.regexp_extract(value, "^([0-9]+)([smh]?)$", 1)
    unit = F.regexp_extract(value, "^([0-9]+)([smh]?)$", 2)
    times = F.when(unit == "m", 60).when(unit == "h", 3600).otherwise(1)
    exact = F.expr("null").cast("decimal(38,0)")
    exact = F.when((number != "") & (F.length(number) <= 20), number.cast("decimal(20,0)") * times).otherwise(exact)
    return F.when(number != "", F.least(exact, F.lit(_MOST).cast("decimal(38,0)")).cast("long"))


def duration_seconds(text: str) -> int | None:
    """The same for one text on the driver."""
    found = re.fullmatch(r"([0-9]+)([smh]?)", text.strip().lower())
    return min(int(found[1]) * _UNITS.get(found[2], 1), _MOST) if found else None


def proto_name(number: Column) -> Column:
    return F.when(number == 1, "icmp").when(number == 6, "tcp").when(number == 17, "udp").when(number == 58, "icmpv6").otherwise("other")


def conn_state(proto: Column, syn: Column, fin: Column, rst: Column) -> Column:
    """The state of a flow from its sticky TCP flags; ``-`` for all but TCP."""
    return F.when(proto != "tcp", "-").when(syn & rst, "REJ").when(rst, "RSTO").when(syn & fin, "SF").when(syn, "S0").otherwise("OTH")


def longest_label(query: Column) -> Column:
    """Characters of the longest dot-separated label."""
    return F.array_max(F.transform(F.split(query, r"\."), lambda x: F.length(x)))


def unix_seconds(time: Column) -> Column:
    """Seconds with milliseconds, cut off, not below the epoch."""
    return F.greatest(F.floor(F.unix_micros(time) / 1000), F.lit(0)) / 1000.0


def iso_utc(seconds: Column) -> Column:
    """ISO-8601 text in UTC; the session time zone must be UTC."""
    return F.date_format(F.timestamp_seconds(F.floor(seconds)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def endpoint(ip: Column, port: Column) -> Column:
    return F.concat(ip, F.lit(":"), F.coalesce(port.cast("string"), F.lit("-")))


def push_body(src: Column, dst: Column, message: Column) -> Column:
    return F.concat(src, F.lit(" -> "), F.coalesce(dst, F.lit("-")), F.lit(": "), message)


def push_priority(severity: Column) -> Column:
    return F.when(severity == "low", 1).when(severity == "medium", 3).when(severity == "high", 4)


@F.pandas_udf(T.StringType())
def one_decimal(x: pd.Series) -> pd.Series:
    """One decimal, halves to even on the exact value; JVM formatting rounds halves up."""
    return x.map(lambda v: None if pd.isna(v) else f"{v:.1f}")


def ipv6_text(raw: Column) -> Column:
    """The compressed text of 16 address bytes: the longest run of two or more zero groups, the first among equals, is ``::``.

    Mapped IPv4 addresses (::ffff:0:0/96) show their last four bytes as IPv4 does.
    """
    groups = [F.lower(F.regexp_replace(F.hex(F.substring(raw, i, 2)), "^0{1,3}", "")) for i in range(1, 17, 2)]

    def compressed(full: Column) -> Column:
        out = full
        for n in range(2, 9):  # the longest is looked at last, so it wins
            run = "^((?:[0-9a-f]+:)*?)0(?::0){%d}(?::|$)(.*)$" % (n - 1)
            head = F.regexp_extract(full, run, 1)
            out = F.when(full.rlike(run), F.concat(head, F.when(head == "", "::").otherwise(":"), F.regexp_extract(full, run, 2))).otherwise(out)
        return out

    mapped = F.hex(F.substring(raw, 1, 12)) == "00000000000000000000FFFF"
    text = F.when(mapped, F.concat(F.lit("::ffff:"), ipv4_text(F.substring(raw, 13, 4)))).otherwise(let(F.concat_ws(":", *groups), compressed))
    return F.when(F.length(raw) == 16, text)


def number_text(x: float) -> str:
    """60.0 as 60, 1.5 as 1.5: how limits are shown in messages."""
    return str(int(x)) if float(x).is_integer() else repr(float(x))


def byte_at(data: Column, at: Column | int) -> Column:
    """The byte at a 0-based offset as an int; null beyond the end."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substring(data, at + 1, F.lit(1))), 16, 10).cast("int")


def u16_at(data: Column, at: Column | int) -> Column:
    """Two bytes, big end first; null beyond the end."""
    at = F.lit(at) if isinstance(at, int) else at
    two = F.substring(data, at + 1, F.lit(2))
    return F.when(F.length(two) == 2, F.conv(F.hex(two), 16, 10).cast("int"))


def bytes_at(data: Column, at: Column | int, n: int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    got = F.substring(data, at + 1, F.lit(n))
    return F.when(F.length(got) == n, got)


def number_of(raw: Column) -> Column:
    """Up to seven bytes, big end first, as a long."""
    return F.conv(F.hex(raw), 16, 10).cast("long")


def ipv4_of(number: Column) -> Column:
    """The text of an address that is a number."""
    return F.concat_ws(".", *[F.shiftright(number, down).bitwiseAND(255).cast("string") for down in (24, 16, 8, 0)])


def ipv4_text(raw: Column) -> Column:
    return ipv4_of(number_of(raw))


def mac_text(raw: Column) -> Column:
    return F.lower(F.regexp_replace(F.hex(raw), "(..)(?!$)", "$1:"))
