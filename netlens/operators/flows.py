"""Frames to flows and events.

Flows are folded by their normalised key. ``first`` is the first frame's time in arrival order
(frame_no), ``last`` the greatest time. Without ticks every flow lasts to the end of input;
with ticks, flows end only at those times, as a running sensor would end them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import payloads
from ..functions.scalars import conn_state, unix_seconds
from ..plans.chains import shared_folder
from ..schema import as_envelope
from .frames import layers

KEY = ["proto", "a", "b"]
FIN, SYN, RST = 0x01, 0x02, 0x04


def _folded(rows: DataFrame, *extra: str) -> DataFrame:
    flag = lambda bit: F.coalesce(F.bool_or(F.col("tcp_flags").bitwiseAND(bit) != 0), F.lit(False))
    count = lambda c: F.count_if(c)
    size = F.col("wire_len").cast("long")
    return rows.where("version is not null").groupBy(*KEY, *extra).agg(
        F.min_by("ts", "frame_no").alias("first"), F.max("ts").alias("last"), F.min("frame_no").alias("frame_no"),
        count(F.col("forward")).alias("pkts_a_to_b"), F.coalesce(F.sum(F.when(F.col("forward"), size)), F.lit(0)).alias("bytes_a_to_b"),
        count(~F.col("forward")).alias("pkts_b_to_a"), F.coalesce(F.sum(F.when(~F.col("forward"), size)), F.lit(0)).alias("bytes_b_to_a"),
        flag(SYN).alias("syn"), flag(FIN).alias("fin"), flag(RST).alias("rst"),
    )


def open_flows(rows: DataFrame) -> DataFrame:
    """One flow a key, without an end."""
    return _folded(rows)


def fold_flows(rows: DataFrame) -> DataFrame:
    """One flow a key over the whole input; all end with it (reason eof)."""
    return _folded(rows).withColumn("end_reason", F.lit("eof"))


class Ticks:
    """Times (microseconds) at which flows are looked at. A tick has a number; ``next`` is that of the first tick after a time."""

    def __init__(self, times: list[int]):
        self.times = sorted(times)

    def next_of(self, us: Column) -> Column:
        times = np.array(self.times, np.int64)

        @F.pandas_udf("long")
        def found(x: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(times, x.to_numpy(), side="right"))

        return found(us)

    def from_(self, us: np.ndarray) -> np.ndarray:
        """The first tick at a time or after it."""
        return np.searchsorted(np.array(self.times, np.int64), us, side="left")

    def time(self, no: int) -> int | None:
        """When a tick is; none beyond the last."""
        return self.times[no] if no < len(self.times) else None


class Every(Ticks):
    """The multiples of a number of microseconds up to a last one, by arithmetic: no list of them is anywhere."""

    def __init__(self, width: int, last: int | None = None):
        self.width, self.last = width, last

    def next_of(self, us: Column) -> Column:
        return ((us - F.pmod(us, F.lit(self.width))) / self.width).cast("long") + 1

    def from_(self, us: np.ndarray) -> np.ndarray:
        return -(-us // self.width)

    def time(self, no: int) -> int | None:
        return no * self.width if no <= self.last else None


def tick_slots(rows: DataFrame, ticks: Ticks) -> DataFrame:
    """What each key did between two ticks, folded: no flow can end inside such a slot.

    A row's slot is the next tick after it or after an earlier row of its key: clocks only go
    forward in arrival order.
    """
    have = rows.where("version is not null").select(
        "proto", F.struct("a.v", "a.ip", "a.port").alias("a"), F.struct("b.v", "b.ip", "b.port").alias("b"), "frame_no", "ts", "tcp_flags", "wire_len", "forward", "version", ticks.next_of(F.unix_micros("ts")).alias("own")
    )
    arrived = Window.partitionBy(*KEY).orderBy("frame_no").rowsBetween(Window.unboundedPreceding, 0)
    return _folded(have.withColumn("slot", F.max("own").over(arrived)), "slot")


def flows_of_slots(slots: DataFrame, ticks: Ticks, idle: float = 60.0, active: float = 3600.0) -> DataFrame:
    """The flows of ``tick_slots``.

    The slots of a key are streamed in order, so a flow is a run of rows, and a task holds one open flow
    besides its batch. A later slot has a later ``last``, so whether a flow ends of silence or a flag lies between two
    slots and is told for a batch at once; only flows older than ``active`` are walked. The tick that ends a flow is
    found by bisection or arithmetic, so the number of ticks costs nothing.
    """
    silence, life = (min(round(x * 1e6), 1 << 60) for x in (idle, active))

    def starts(fresh: np.ndarray, slot: np.ndarray, first: np.ndarray, last: np.ndarray, flag: np.ndarray) -> np.ndarray:
        """Where flows begin."""
        until = np.where(flag, slot, np.maximum(slot, ticks.from_(last + silence)))
        new = fresh.copy()
        new[1:] |= until[:-1] < slot[1:]
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        old = np.zeros(len(new), bool)
        old[1:] = ~new[1:] & (np.maximum(slot[:-1], ticks.from_(first[head[1:]] + life)) < slot[1:])
        done = 0
        for i in np.flatnonzero(old).tolist():
            if i < done:
                continue
            of, own = head[i], head[i]
            while i < len(new) and head[i] == of:
                if max(slot[i - 1], ticks.from_(first[own] + life)) < slot[i]:
                    new[i], own = True, i
                i += 1
            done = i
        return new

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the open flow, as one slot
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows]).combine_chunks()
            names = ("fresh", "slot", "first_us", "last_us", "rst", "fin")
            fresh, slot, first, last, rst, fin = (rows.column(c).to_numpy() for c in names)
            begin = np.flatnonzero(starts(fresh, slot, first, last, rst | fin))
            end = np.append(begin[1:], rows.num_rows) - 1
            own = rows.take(pa.array(begin))
            for c in ("slot", "last", "last_us"):
                own = own.set_column(own.schema.get_field_index(c), own.schema.field(c), rows.column(c).take(pa.array(end)))
            for c in _COUNTS:
                own = own.set_column(own.schema.get_field_index(c), own.schema.field(c), pa.array(np.add.reduceat(rows.column(c).to_numpy(), begin)))
            for c in ("syn", "fin", "rst"):
                own = own.set_column(own.schema.get_field_index(c), own.schema.field(c), pa.array(np.logical_or.reduceat(rows.column(c).to_numpy(), begin)))
            held = own.slice(len(begin) - 1)
            held = held.set_column(held.schema.get_field_index("fresh"), held.schema.field("fresh"), pa.array([True]))
            yield from ended(own.slice(0, len(begin) - 1))
        if held is not None:
            yield from ended(held)

    def ended(flows: pa.Table) -> list[pa.RecordBatch]:
        """Flows with the reason and time of their end."""
        slot, first, last, rst, fin = (flows.column(c).to_numpy() for c in ("slot", "first_us", "last_us", "rst", "fin"))
        no = np.where(rst | fin, slot, np.maximum(slot, ticks.from_(np.minimum(last + silence, first + life))))
        at = [ticks.time(x) for x in no.tolist()]
        why = [
            "eof" if a is None else "rst" if r else "fin" if f else "idle" if a - x >= silence else "active" for a, x, r, f in zip(at, last.tolist(), rst.tolist(), fin.tolist(), strict=True)
        ]
        own = flows.select([*KEY, *_FLOW]).append_column("end_reason", pa.array(why, pa.string())).append_column("end_us", pa.array(at, pa.int64()))
        return own.to_batches()

    # the window leaves each key's slots together and in order
    fresh = F.lag("slot").over(Window.partitionBy(*KEY).orderBy("slot")).isNull()
    dealt = slots.withColumns({"fresh": fresh, "first_us": F.unix_micros("first"), "last_us": F.unix_micros("last")})
    added = [T.StructField("end_reason", T.StringType()), T.StructField("end_us", T.LongType())]
    return dealt.mapInArrow(folded, T.StructType([*[dealt.schema[c] for c in (*KEY, *_FLOW)], *added]))


def flows_with_ticks(rows: DataFrame, ticks: list[float] | Ticks, idle: float = 60.0, active: float = 3600.0) -> DataFrame:
    """Flows that end at the first tick after a reset, a FIN, ``idle`` seconds of silence or ``active`` seconds of life.

    A frame lies after every tick whose time is at or before its own; ticks are in seconds, or
    ``Every``, which without a last tick goes on to the first one after all frames. ``end_us`` is
    the tick that ended a flow, null for the end of input. The frames are read once: what keys did
    between ticks is a checkpoint.
    """
    if not isinstance(ticks, Ticks):
        ticks = Ticks([round(t * 1e6) for t in ticks])
    slots = tick_slots(rows, ticks)
    if isinstance(ticks, Every) and ticks.last is None:
        shared_folder(rows.sparkSession)
        slots = slots.checkpoint()
        most = slots.agg(F.max(F.unix_micros("last"))).first()[0] or 0
        ticks = Every(ticks.width, most // ticks.width + 1)
    return flows_of_slots(slots, ticks, idle, active)


_COUNTS = ["pkts_a_to_b", "bytes_a_to_b", "pkts_b_to_a", "bytes_b_to_a"]
_FLOW = ["first", "last", "frame_no", *_COUNTS, "syn", "fin", "rst"]


def _merged() -> list[Column]:
    """What several stretches of one flow are together, as aggregates."""
    return [
        F.min_by("first", "frame_no").alias("first"), F.max("last").alias("last"), F.min("frame_no").alias("frame_no"),
        *[F.sum(c).alias(c) for c in _COUNTS], *[F.bool_or(c).alias(c) for c in ("syn", "fin", "rst")],
    ]


def merged_flows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Flows that were open and those of newer frames as one flow a key; neither has an end yet."""
    return old.unionByName(new).groupBy(*KEY).agg(*_merged())


def end_at(now: Column, idle: float = 60.0, active: float = 3600.0) -> Column:
    """Why a flow ends at the tick ``now`` (a timestamp), null where it goes on."""
    since = lambda c: F.unix_micros(now) - F.unix_micros(F.col(c))
    return F.when(F.col("rst"), "rst").when(F.col("fin"), "fin").when(since("last") >= round(idle * 1e6), "idle").when(since("first") >= round(active * 1e6), "active")


def conn_events(flows: DataFrame) -> DataFrame:
    """Flows as conn events; a is the source."""
    port = lambda side: F.when(F.col(f"{side}.port") >= 0, F.col(f"{side}.port"))
    return flows.select(
        unix_seconds(F.col("first")).alias("ts"),
        ((F.unix_micros("last") - F.unix_micros("first")) / 1e6).alias("duration"), "proto",
        conn_state(F.col("proto"), F.col("syn"), F.col("fin"), F.col("rst")).alias("conn_state"), "end_reason",
        F.col("a.ip").alias("src"), F.col("b.ip").alias("dst"), port("a").alias("src_port"), port("b").alias("dst_port"),
        "pkts_a_to_b", "bytes_a_to_b", "pkts_b_to_a", "bytes_b_to_a", "frame_no",
    )


def routed(rows: DataFrame) -> DataFrame:
    """``route``: dns, http or tls by protocol and either port; the first that fits, whatever its parser then says."""
    either = lambda p: (F.col("src_port") == p) | (F.col("dst_port") == p)
    udp, tcp = F.col("proto_no") == 17, F.col("proto_no") == 6
    route: Column = F.when(udp & either(53), "dns").when(tcp & either(80), "http").when(tcp & either(443), "tls")
    return rows.withColumn("route", F.when(F.col("payload").isNotNull(), route))


#: What ``frame_events`` needs of a frame.
_CARRIED = ["frame_no", "ts", "route", "payload", "arp", "src", "dst", "src_port", "dst_port"]


def frame_events(rows: DataFrame) -> DataFrame:
    """The events that routed rows carry themselves, at most one a frame; ``seq`` is their order.

    Parsers run only on the frames routed to them.
    """
    common = ["frame_no", unix_seconds(F.col("ts")).alias("ts"), "src", "dst", "src_port", "dst_port"]

    def parsed(route: str, parser) -> DataFrame:
        own = rows.where(F.col("route") == route).select(*common, parser("payload").alias("p"))
        return own.where("p.found").select(*[c for c in own.columns if c != "p"], "p.*").drop("found")

    parts = {
        "dns": parsed("dns", payloads.dns),
        "http": parsed("http", payloads.http),
        "ssl": parsed("tls", payloads.tls).drop("cipher_suites", "extension_types"),
        "arp": rows.where("arp is not null").select("frame_no", unix_seconds(F.col("ts")).alias("ts"), "arp.*"),
    }
    out = None
    for kind, part in parts.items():
        own = _placed(part, kind)
        out = own if out is None else out.unionByName(own)
    return out


def _placed(part: DataFrame, kind: str) -> DataFrame:
    place = F.struct(F.lit(kind == "conn").alias("late"), F.col("frame_no"), F.lit(kind).alias("kind"))
    return as_envelope(part.withColumn("seq", place), kind)


def flow_events(flows: DataFrame) -> DataFrame:
    """Ended flows as events that come after those of frames."""
    return _placed(conn_events(flows), "conn")


def numbered(events: DataFrame, after: int = 0, slot: int = 1 << 16) -> DataFrame:
    """``events`` with ``seq`` and uids as one sequence, which goes on from ``after``.

    A slot of frame numbers is one sort; the slots before it are counted, a row each.
    """
    dealt = events.withColumn("__slot", F.struct("seq.late", F.floor(F.col("seq.frame_no") / slot).alias("no")))
    counts = dealt.groupBy("__slot").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__slot", (before + F.lit(after)).alias("__start"))
    place = F.row_number().over(Window.partitionBy("__slot").orderBy("seq"))
    out = dealt.withColumn("__place", place).join(starts, "__slot").withColumn("seq", (F.col("__start") + F.col("__place")).cast("long"))
    return out.withColumn("uid", F.concat("event", "seq")).drop("__slot", "__place", "__start")


def events_of_frames(frames: DataFrame, ticks: list[float] | None = None, idle: float = 60.0, active: float = 3600.0, heartbeat: bool = False) -> DataFrame:
    """All events of a capture in a fixed order: per frame, then flows by start and frame number.

    With ``heartbeat`` a last event counts frames, bytes on the wire, flows and events, itself
    included; ``heartbeats`` gives one a tick. All frames are taken apart twice, for the flows and
    for the few that carry events; those frames, and the events before they are numbered, are checkpoints.
    """
    shared_folder(frames.sparkSession)
    rows = routed(layers(frames))
    flows = fold_flows(rows) if ticks is None else flows_with_ticks(rows, ticks, idle, active)
    own = rows.where("route is not null or arp is not null").select(*_CARRIED).checkpoint()
    out = numbered(frame_events(own).unionByName(flow_events(flows)).checkpoint())
    if not heartbeat:
        return out
    totals = frames.agg(F.coalesce(F.max(unix_seconds(F.col("ts"))), F.lit(0.0)).alias("ts"), F.count("*").alias("total_frames"), F.coalesce(F.sum(F.col("wire_len").cast("long")), F.lit(0)).alias("bytes"))
    counted = out.agg((F.count("*") + 1).alias("events_emitted"))
    beat = totals.crossJoin(counted).withColumn("active_flows", F.lit(0)).withColumn("seq", F.col("events_emitted"))  # one row each
    return out.unionByName(as_envelope(beat, "heartbeat"))


def heartbeats(rows: DataFrame, every: float, idle: float = 60.0, active: float = 3600.0, parsed: bool = True) -> DataFrame:
    """A heartbeat at each multiple of ``every`` seconds after a frame, up to the first one after the last.

    It counts what came before the tick: frames, bytes, open flows once the tick has ended some,
    and events, earlier heartbeats and itself included (with ``parsed`` those of frames too).
    What happens between two ticks is summed first, so one row a tick is ordered globally. Frames
    are taken apart once: what is needed of them, payloads of parsed protocols only, is a checkpoint.
    """
    ticks = Every(round(every * 1e6))
    shared_folder(rows.sparkSession)
    needed = ["frame_no", "ts", "wire_len", "version", "proto", "tcp_flags", "forward", "a", "b", *["route", "payload", "arp", "src", "dst", "src_port", "dst_port"] * parsed]
    kept = routed(rows).withColumn("payload", F.when(F.col("route").isNotNull(), F.col("payload"))) if parsed else rows
    kept = kept.select(*needed).checkpoint()
    first, last = kept.agg(*[f(ticks.next_of(F.unix_micros("ts"))) for f in (F.min, F.max)]).first()
    first, ticks.last = (first, last) if first is not None else (1, 0)
    flows = flows_of_slots(tick_slots(kept, ticks), ticks, idle, active)
    names = ("frames", "wire", "flows", "events")
    delta = lambda at, **c: F.struct(at.cast("long").alias("tick"), *[c.get(n, F.lit(0)).cast("long").alias(n) for n in names])
    one = F.lit(1)
    begin = delta(ticks.next_of(F.unix_micros("first")), flows=one)
    end = F.when(F.col("end_us").isNotNull(), delta(F.round(F.col("end_us") / ticks.width), flows=-one, events=one))
    parts = [
        kept.select(delta(ticks.next_of(F.unix_micros("ts")), frames=one, wire=F.col("wire_len")).alias("d")),
        flows.select(F.explode(F.filter(F.array(begin, end), lambda d: d.isNotNull())).alias("d")),
        rows.sparkSession.range(first, last + 1).select(delta(F.col("id"), events=one).alias("d")),
    ]
    if parsed:
        own = kept.where("route is not null or arp is not null").select(*_CARRIED).checkpoint()  # read once, not once a kind
        parts.append(frame_events(own).select(delta(ticks.next_of(F.round(F.col("ts") * 1e6).cast("long")), events=one).alias("d")))
    both = parts[0]
    for p in parts[1:]:
        both = both.union(p)
    sums = both.select("d.*").groupBy("tick").agg(*[F.sum(c).alias(c) for c in names])
    upto = Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)  # one row a tick
    named = dict(zip(names, ("total_frames", "bytes", "active_flows", "events_emitted"), strict=True))
    return sums.select((F.col("tick") * F.lit(ticks.width) / 1e6).alias("ts"), *[F.sum(c).over(upto).alias(n) for c, n in named.items()])
