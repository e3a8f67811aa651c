"""Application payloads: one small parser a protocol, run on Arrow batches.

Names with compression pointers, header blocks and length-prefixed handshakes have no column
form; each parser reads one payload and gives a row or null.
"""

from __future__ import annotations

import ipaddress
import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Limits of what a summary keeps.
ANSWERS, HEADERS, NAME, METHOD, URI, HOST, AGENT, SNI, CIPHERS, EXTENSIONS = 10, 16, 255, 16, 512, 255, 128, 255, 64, 32

DNS = "txid int, is_response boolean, rcode int, query string, qtype int, answers array<string>"
HTTP = "kind string, method string, uri string, host string, user_agent string, status int"
TLS = "version string, sni string, truncated boolean, cipher_suites array<int>, extension_types array<int>"


def cut_bytes(text: str, most: int) -> str:
    """At most so many UTF-8 bytes, whole characters only."""
    raw = text.encode()
    return text if len(raw) <= most else raw[:most].decode("utf-8", "ignore")


def _name(data: bytes, at: int) -> tuple[str, int]:
    """A domain name with its final dot, and where it ends; ValueError if damaged."""
    labels, end, hops = [], None, 0
    while True:
        n = data[at]
        if n & 0xC0 == 0xC0:
            end = at + 2 if end is None else end
            target = struct.unpack_from(">H", data, at)[0] & 0x3FFF
            hops += 1
            if target >= at or hops > 64:
                raise ValueError("pointer")
            at = target
        elif n & 0xC0:
            raise ValueError("label")
        elif n == 0:
            return "".join(f"{x}." for x in labels) or ".", at + 1 if end is None else end
        else:
            raw = data[at + 1 : at + 1 + n]
            if len(raw) < n:
                raise ValueError("short")
            labels.append("".join(chr(b) if 33 <= b < 127 and b not in b".\\" else f"\\{b:03o}" for b in raw))
            at += 1 + n


def _rdata(data: bytes, kind: int, at: int, n: int) -> str:
    raw = data[at : at + n]
    if kind == 1 and n == 4 or kind == 28 and n == 16:
        return str(ipaddress.ip_address(raw))
    if kind in (2, 5, 12):
        return _name(data, at)[0]
    if kind == 15:
        return f"{struct.unpack_from('>H', raw)[0]} {_name(data, at + 2)[0]}"
    if kind == 16:
        parts, i = [], 0
        while i < n:
            parts.append(raw[i + 1 : i + 1 + raw[i]].decode("utf-8", "replace"))
            i += 1 + raw[i]
        return "".join(parts)
    return raw.hex()


def dns_row(data: bytes) -> tuple | None:
    try:
        txid, flags, questions, answers, *_ = struct.unpack_from(">6H", data)
        at, query, qtype, out = 12, None, None, []
        for i in range(questions):
            name, at = _name(data, at)
            kind = struct.unpack_from(">2H", data, at)[0]
            at += 4
            if i == 0:
                query, qtype = cut_bytes(name.lower(), NAME), kind
        for i in range(answers):
            name, at = _name(data, at)
            kind, _, _, n = struct.unpack_from(">2HIH", data, at)
            at += 10
            if at + n > len(data):
                return None
            text = _rdata(data, kind, at, n)
            at += n
            if i < ANSWERS:
                out.append(cut_bytes(f"{name} {text}" if text else name, NAME))
        return txid, bool(flags >> 15), flags & 0x0F, query, qtype, out
    except (ValueError, IndexError, struct.error):
        return None


def http_row(data: bytes) -> tuple | None:
    head, whole, _ = data.partition(b"\r\n\r\n")
    if not whole:
        return None
    first, *lines = head.split(b"\r\n")
    fields = [x.partition(b":") for x in lines]
    if len(fields) > HEADERS or any(not sep or not name or name.strip() != name or b" " in name for name, sep, _ in fields):
        return None
    values: dict[bytes, str] = {}
    for name, _, value in fields:
        values.setdefault(name.lower(), value.strip(b" \t").decode("utf-8", "replace"))
    host, agent = values.get(b"host"), values.get(b"user-agent")
    rest = (None if host is None else cut_bytes(host, HOST), None if agent is None else cut_bytes(agent, AGENT))
    parts = first.split(b" ")
    if len(parts) == 3 and parts[0].isalpha() and parts[1] and parts[2] in (b"HTTP/1.0", b"HTTP/1.1"):
        return "request", cut_bytes(parts[0].decode(), METHOD), cut_bytes(parts[1].decode("utf-8", "replace"), URI), *rest, None
    if len(parts) >= 2 and parts[0] in (b"HTTP/1.0", b"HTTP/1.1") and len(parts[1]) == 3 and parts[1].isdigit():
        return "response", None, None, *rest, int(parts[1])
    return None


class _Short(Exception):
    pass


def tls_row(data: bytes) -> tuple | None:
    """A ClientHello's version, server name, suites and extensions, as far as they go."""
    if len(data) < 9 or data[0] != 22 or data[5] != 1:
        return None
    cut = struct.unpack_from(">H", data, 3)[0] > len(data) - 5 or int.from_bytes(data[6:9], "big") > len(data) - 9
    version, sni, suites, kinds, at = None, None, [], [], 9

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise _Short
        at += n
        return data[at - n : at]

    def number(n: int) -> int:
        return int.from_bytes(take(n), "big")

    try:
        version = f"0x{number(2):04x}"
        take(32)
        take(number(1))
        n = number(2)
        cut |= n > len(data) - at
        raw = data[at : at + n]
        suites = [x[0] for x in struct.iter_unpack(">H", raw[: len(raw) // 2 * 2])][:CIPHERS]
        if n > len(data) - at:
            raise _Short
        at += n
        take(number(1))
        if at < len(data):
            n = number(2)
            cut |= n > len(data) - at
            end = min(at + n, len(data))
            while at + 4 <= end and len(kinds) < EXTENSIONS:
                kind, size = number(2), number(2)
                kinds.append(kind)
                body = data[at : min(at + size, end)]
                if kind == 0 and sni is None:
                    sni = _server_name(body)
                if at + size > end:
                    raise _Short
                at += size
    except _Short:
        cut = True
    return version, sni, bool(cut), suites, kinds


def _server_name(body: bytes) -> str | None:
    """The first host name of a server name extension."""
    at = 2
    while at + 3 <= len(body):
        kind, n = body[at], int.from_bytes(body[at + 1 : at + 3], "big")
        if kind == 0:
            return body[at + 3 : at + 3 + n].decode("utf-8", "replace")[:SNI] if at + 3 + n <= len(body) else None
        at += 3 + n
    return None


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "array<string>": T.ArrayType(T.StringType()), "array<int>": T.ArrayType(T.IntegerType())}


def _parser(row, schema: str):
    fields = [x.split(" ") for x in schema.split(", ")]
    names = [n for n, _ in fields]

    @F.pandas_udf(T.StructType([T.StructField("found", T.BooleanType()), *(T.StructField(n, _TYPES[t]) for n, t in fields)]))
    def parsed(payloads: pd.Series) -> pd.DataFrame:
        rows = [row(bytes(p)) if p is not None else None for p in payloads]
        out = pd.DataFrame([r or (None,) * len(names) for r in rows], columns=names, dtype=object)
        out.insert(0, "found", [r is not None for r in rows])
        return out

    return parsed


dns = _parser(dns_row, DNS)
http = _parser(http_row, HTTP)
tls = _parser(tls_row, TLS)
