"""Link-layer frames to layers, all with column expressions.

Input: frame_no, ts (timestamp), wire_len, data (binary). A layer that is short or damaged is
null; the frame stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import byte_at, ipv4_of, ipv4_text, ipv6_text, mac_text, number_of, proto_name, u16_at

IPV4, IPV6, ARP = 0x0800, 0x86DD, 0x0806
TAGS = (0x8100, 0x88A8)


#: Bytes that can hold headers: two tags, the longest IPv4 header, and TCP up to its flags.
_HEAD = 22 + 60 + 16


def _number(at: Column | int, n: int) -> Column:
    """``n`` bytes of the padded head from a 0-based place, big end first, as a long."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substring("head", at + 1, F.lit(n))), 16, 10).cast("long")


def _bits(c: str, down: int, mask: int = 0xFFFF) -> Column:
    return F.shiftright(F.col(c), down).bitwiseAND(mask).cast("int")


def _link(frames: DataFrame) -> DataFrame:
    """outer and final ethertype (after up to two tags), vlan (the first), and where layer 3 starts (``at3``)."""
    tags = lambda c: F.coalesce(F.col(c).isin(*TAGS), F.lit(False))
    rows = frames.select("*", F.length("data").alias("size"), F.rpad(F.substring("data", 1, _HEAD), _HEAD, F.lit(b"\0")).alias("head"))
    rows = rows.withColumn("w", _number(12, 6))
    rows = rows.withColumns({"outer": F.when(F.col("size") >= 14, _bits("w", 32)), "inner": F.when(F.col("size") >= 18, _bits("w", 0)), "tag": F.when(F.col("size") >= 18, _bits("w", 16, 0x0FFF))})
    rows = rows.withColumn("one", tags("outer")).withColumn("two", F.col("one") & tags("inner"))
    deep = F.when(F.col("size") >= 22, _number(20, 2).cast("int"))
    return rows.withColumns({
        "ethertype": F.when(F.col("two"), deep).when(F.col("one"), F.col("inner")).otherwise(F.col("outer")),
        "vlan": F.when(F.col("one"), F.col("tag")), "at3": F.when(F.col("two"), 22).when(F.col("one"), 18).otherwise(14),
    })


def _network(rows: DataFrame) -> DataFrame:
    """version, protocol, raw addresses and the bounds of layer 4; all null where IP is damaged."""
    at, size = F.col("at3"), F.col("size")
    rows = rows.withColumn("n", _number(at, 7)).withColumn("ihl", _bits("n", 48, 0x0F) * 4)
    of = lambda version: _bits("n", 52, 0x0F) == version
    v4 = (F.col("ethertype") == IPV4) & (size - at >= 20) & of(4) & (F.col("ihl") >= 20) & (F.col("ihl") <= size - at)
    v6 = (F.col("ethertype") == IPV6) & (size - at >= 40) & of(6)
    rows = rows.withColumn("version", F.when(v4, 4).when(v6, 6))
    four, six = F.col("version") == 4, F.col("version") == 6
    part = lambda begin, n: F.substring("data", at + (begin + 1), F.lit(n))
    return rows.withColumns({
        "proto_no": F.when(four, _number(at + 9, 1).cast("int")).when(six, _bits("n", 0, 0xFF)),
        "src_raw": F.when(four, part(12, 4)).when(six, part(8, 16)), "dst_raw": F.when(four, part(16, 4)).when(six, part(24, 16)),
        "at4": F.when(four, at + F.col("ihl")).when(six, at + 40),
        "end": F.when(four, F.least(at + _bits("n", 24), size)).when(six, F.least(at + 40 + _bits("n", 8), size)),
    })


def _transport(rows: DataFrame) -> DataFrame:
    """Ports and TCP flags where the header is whole, and the payload behind it."""
    at, room = F.col("at4"), F.col("room")
    rows = rows.withColumn("room", F.col("end") - at)
    rows = rows.withColumn("kind", F.when((F.col("proto_no") == 6) & (room >= 20), "tcp").when((F.col("proto_no") == 17) & (room >= 8), "udp"))
    rows = rows.withColumns({"ports": F.when(F.col("kind").isNotNull(), _number(at, 4)), "marks": F.when(F.col("kind") == "tcp", _number(at + 12, 2))})
    rows = rows.withColumn("head4", F.when(F.col("kind") == "udp", 8).when(_bits("marks", 12, 0x0F) >= 5, _bits("marks", 12, 0x0F) * 4))
    return rows.withColumns({
        "src_port": _bits("ports", 16), "dst_port": _bits("ports", 0), "tcp_flags": _bits("marks", 0, 0xFF),
        "payload": F.when(F.col("head4") <= room, F.substring("data", at + F.col("head4") + 1, room - F.col("head4"))),
    })


def _arp(data: Column) -> Column:
    """op, addresses and whether it is gratuitous; untagged whole Ethernet/IPv4 ARP only."""
    op = u16_at(data, 20)
    good = (F.col("outer") == ARP) & (F.length(data) >= 42) & (u16_at(data, 14) == 1) & (u16_at(data, 16) == 0x0800) & (byte_at(data, 18) == 6) & (byte_at(data, 19) == 4) & op.isin(1, 2)
    return F.when(good, F.struct(
        F.when(op == 1, "request").otherwise("reply").alias("op"), mac_text(F.substring(data, 23, 6)).alias("sender_mac"), ipv4_text(F.substring(data, 29, 4)).alias("src"),
        mac_text(F.substring(data, 33, 6)).alias("target_mac"), ipv4_text(F.substring(data, 39, 4)).alias("target_ip"), (F.substring(data, 29, 4) == F.substring(data, 39, 4)).alias("is_gratuitous"),
    ))


def layers(frames: DataFrame) -> DataFrame:
    """All layers of all frames, with IP texts, protocol names and the flow key.

    ``a`` is the lesser endpoint by version, address bytes and port (none first), ``forward``
    whether the frame goes from a to b. Each frame is taken apart once, by projections that build
    on one another; the layers are then one generated row, through which no filter moves, so that
    none of it is done again for a filter.
    """
    told = ["outer", "ethertype", "vlan", "version", "proto_no", "src_raw", "dst_raw", "src_port", "dst_port", "tcp_flags", "payload"]
    rows = _transport(_network(_link(frames))).select(*frames.columns, F.struct(*told).alias("layers"))
    rows = rows.select(*frames.columns, F.inline_outer(F.array("layers"))).withColumn("arp", _arp(F.col("data")))
    rows = rows.withColumns({f"{side}_no": F.when(F.col("version") == 4, number_of(F.col(f"{side}_raw"))) for side in ("src", "dst")})
    ip = lambda side: F.when(F.col("version") == 4, ipv4_of(F.col(f"{side}_no"))).when(F.col("version") == 6, ipv6_text(F.col(f"{side}_raw")))
    rows = rows.withColumns({"src": ip("src"), "dst": ip("dst")}).drop("src_no", "dst_no")
    has = F.col("version").isNotNull()
    end = lambda side: F.struct(F.col("version").alias("v"), F.col(f"{side}_raw").alias("raw"), F.coalesce(f"{side}_port", F.lit(-1)).alias("port"), F.col(side).alias("ip"))
    low = lambda side: F.struct("version", f"{side}_raw", F.coalesce(f"{side}_port", F.lit(-1)))
    rows = rows.select("*", F.when(has, proto_name(F.col("proto_no"))).alias("proto"), F.when(has, low("src") <= low("dst")).alias("forward"))
    return rows.select("*", F.when(has, F.when(F.col("forward"), end("src")).otherwise(end("dst"))).alias("a"), F.when(has, F.when(F.col("forward"), end("dst")).otherwise(end("src"))).alias("b"))


def link_counters(frames: DataFrame) -> DataFrame:
    """Frames, captured bytes and frames by outer ethertype; frames below 14 bytes are other."""
    kind = F.when(F.length("data") >= 14, u16_at(F.col("data"), 12))
    other = ~F.coalesce(kind.isin(IPV4, IPV6, ARP), F.lit(False))
    return frames.agg(
        F.count("*").alias("frames"), F.coalesce(F.sum(F.length("data")), F.lit(0)).alias("bytes"),
        F.count_if(kind == IPV4).alias("ipv4"), F.count_if(kind == IPV6).alias("ipv6"), F.count_if(kind == ARP).alias("arp"), F.count_if(other).alias("other"),
    )
