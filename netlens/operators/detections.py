"""The five detections and the rule engine.

A detection maps events to alert rows with the columns of ALERT plus sort keys; the engine
runs its rules in order and numbers all alerts. Event rows need the envelope columns and
``seq``, their unique place in the stream.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import longest_label, number_text, one_decimal
from ..plans.slots import in_slot, merged_firsts, rows_before, slot_firsts, slotted
from ..plans.windows import densest, first_uids
from ..schema import micros

ALERT = ["ts", "name", "severity", "src", "dst", "message", "evidence"]
#: What orders the alerts of one rule.
KEYS = ["sub", "k1", "k2", "kn"]
EVIDENCE = 10


class Detection(Protocol):
    name: str
    severity: str

    def detect(self, events: DataFrame) -> DataFrame: ...


def timed(events: DataFrame) -> DataFrame:
    return events if "ts_us" in events.columns else events.withColumn("ts_us", micros(F.col("ts")))


def with_ports(events: DataFrame) -> DataFrame:
    """TCP and UDP flows that have a destination port."""
    return timed(events).where((F.col("event") == "conn") & F.col("proto").isin("tcp", "udp") & F.col("dst_port").isNotNull())


def _alert(name: str, severity: str, ts_us: Column, src: Column, dst: Column, message: Column, evidence: Column, sub: int = 0, k1=None, k2=None, kn=None) -> list[Column]:
    blank = F.lit("")
    return [
        (ts_us / 1_000_000).alias("ts"), F.lit(name).alias("name"), F.lit(severity).alias("severity"), src.alias("src"), dst.cast("string").alias("dst"), message.alias("message"), evidence.alias("evidence"),
        F.lit(sub).alias("sub"), (blank if k1 is None else k1).alias("k1"), (blank if k2 is None else k2).alias("k2"), (F.lit(0) if kn is None else kn).cast("long").alias("kn"),
    ]



@dataclass
class PortScan:
    """Many ports of one host (vertical) or many hosts on one port (horizontal) in a window."""

    window: float = 60.0
    ports: int = 15
    hosts: int = 30
    name: str = "port-scan"
    severity: str = "medium"

    def vertical(self, events: DataFrame) -> DataFrame:
        found = densest(with_ports(events), ["src", "dst"], int(self.window * 1e6), "dst_port", at_least=self.ports)
        text = F.concat(F.col("n"), F.lit(" distinct ports on "), F.col("dst"), F.lit(f" within {number_text(self.window)}s"))
        return found.select(*_alert(self.name, self.severity, F.col("end_us"), F.col("src"), F.col("dst"), text, F.col("evidence"), 0, F.col("src"), F.col("dst")))

    def horizontal(self, events: DataFrame) -> DataFrame:
        found = densest(with_ports(events), ["src", "dst_port"], int(self.window * 1e6), "dst", at_least=self.hosts)
        text = F.concat(F.col("n"), F.lit(" hosts contacted on port "), F.col("dst_port"), F.lit(f" within {number_text(self.window)}s"))
        return found.select(*_alert(self.name, self.severity, F.col("end_us"), F.col("src"), F.lit(None), text, F.col("evidence"), 1, F.col("src"), None, F.col("dst_port")))

    def detect(self, events: DataFrame) -> DataFrame:
        return self.vertical(events).unionByName(self.horizontal(events))


@dataclass
class Beaconing:
    """Flows to one endpoint at nearly equal intervals over the whole batch."""

    least: int = 5
    shortest: float = 10.0
    longest: float = 3600.0
    jitter: float = 0.2
    name: str = "beaconing"
    severity: str = "high"

    def groups(self, events: DataFrame) -> DataFrame:
        """Each (src, dst, dst_port) with count, mean interval in seconds, and whether it fires."""
        key = ["src", "dst", "dst_port"]
        gap = F.col("ts_us") - F.lag("ts_us").over(in_slot(key))
        slots = slotted(with_ports(events).select(*key, "uid", "ts_us", "seq")).withColumn("gap", gap).withColumn("i", F.row_number().over(in_slot(key)))
        parts = slots.groupBy(*key, "slot").agg(
            F.count("*").alias("n"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("end_us"), F.min("gap").alias("low"), F.max("gap").alias("high"), slot_firsts(EVIDENCE).alias("firsts")
        )
        # a row a slot: what lies between a slot and the one before is one more gap
        between = F.col("first_us") - F.lag("end_us").over(Window.partitionBy(*key).orderBy("slot"))
        parts = parts.withColumn("between", between).withColumn("before", rows_before(key))
        all_ = parts.groupBy(*key).agg(
            F.sum("n").alias("n"), F.min("first_us").alias("first_us"), F.max("end_us").alias("end_us"), F.min(F.least("low", "between")).alias("low"), F.max(F.greatest("high", "between")).alias("high"), merged_firsts(EVIDENCE).alias("evidence")
        )
        mean = (F.col("end_us") - F.col("first_us")) / (F.col("n") - 1) / 1e6
        all_ = all_.where(F.col("n") >= self.least).withColumn("mean", mean)
        steady = (F.col("high") / 1e6 - F.col("mean") <= self.jitter * F.col("mean")) & (F.col("mean") - F.col("low") / 1e6 <= self.jitter * F.col("mean"))
        return all_.where(F.col("mean").between(self.shortest, self.longest) & steady)

    def detect(self, events: DataFrame) -> DataFrame:
        found = self.groups(events)
        text = F.concat(F.col("n"), F.lit(" flows to "), F.col("dst"), F.lit(":"), F.col("dst_port"), F.lit(" at ~"), one_decimal(F.col("mean")), F.lit("s intervals"))
        return found.select(*_alert(self.name, self.severity, F.col("end_us"), F.col("src"), F.col("dst"), text, F.col("evidence"), 0, F.col("src"), F.col("dst"), F.col("dst_port")))


@dataclass
class DnsTunnel:
    """Oversized labels, or many different TXT queries in a window.

    Answers count for the host that sent them, and a TXT name counts at its first occurrence only.
    """

    longest: int = 45
    window: float = 60.0
    queries: int = 20
    name: str = "dns-tunnel"
    severity: str = "high"

    def long_labels(self, events: DataFrame) -> DataFrame:
        rows = timed(events).where((F.col("event") == "dns") & F.col("query").isNotNull()).withColumn("label", longest_label(F.col("query"))).where(F.col("label") > self.longest)
        slots = slotted(rows.select("src", "dst", "uid", "ts_us", "seq", "label")).withColumn("i", F.row_number().over(in_slot(["src"])))
        last = F.max_by(F.struct("ts_us", "dst"), F.struct("ts_us", "seq")).alias("t")
        parts = slots.groupBy("src", "slot").agg(F.count("*").alias("n"), F.max("label").alias("label"), last, slot_firsts(EVIDENCE).alias("firsts")).withColumn("before", rows_before(["src"]))
        found = parts.groupBy("src").agg(F.max("label").alias("n"), F.max_by("t", "slot").alias("t"), merged_firsts(EVIDENCE).alias("evidence"))
        text = F.concat(F.lit("dns label of "), F.col("n"), F.lit(" chars from "), F.col("src"))
        return found.select(*_alert(self.name, self.severity, F.col("t.ts_us"), F.col("src"), F.col("t.dst"), text, F.col("evidence"), 0, F.col("src"), None, F.lit(0)))

    def txt_flood(self, events: DataFrame) -> DataFrame:
        rows = timed(events).where((F.col("event") == "dns") & (F.col("qtype") == 16) & F.col("query").isNotNull())
        first = rows.groupBy("src", "query").agg(F.min(F.struct("ts_us", "seq", "uid", "dst")).alias("f")).select("src", "query", "f.*")
        found = densest(first, ["src"], int(self.window * 1e6), None, {"dst": F.col("dst")}, at_least=self.queries)
        text = F.concat(F.col("n"), F.lit(f" txt queries within {number_text(self.window)}s"))
        return found.select(*_alert(self.name, self.severity, F.col("end_us"), F.col("src"), F.col("dst"), text, F.col("evidence"), 0, F.col("src"), None, F.lit(1)))

    def detect(self, events: DataFrame) -> DataFrame:
        return self.long_labels(events).unionByName(self.txt_flood(events))


@dataclass
class ArpSpoof:
    """One address claimed by several MACs, or a storm of gratuitous announcements."""

    window: float = 300.0
    storm_window: float = 10.0
    storm: int = 10
    macs: int = 2
    name: str = "arp-spoof"
    severity: str = "high"

    def conflicts(self, events: DataFrame) -> DataFrame:
        rows = timed(events).where(F.col("event") == "arp")
        found = densest(rows, ["src"], int(self.window * 1e6), "sender_mac", at_least=self.macs)
        text = F.concat(F.col("src"), F.lit(" claimed by "), F.col("n"), F.lit(f" macs within {number_text(self.window)}s"))
        return found.select(*_alert(self.name, self.severity, F.col("end_us"), F.col("src"), F.lit(None), text, F.col("evidence"), 0, F.col("src")))

    def storms(self, events: DataFrame) -> DataFrame:
        rows = timed(events).where((F.col("event") == "arp") & F.col("is_gratuitous"))
        found = densest(rows, ["sender_mac"], int(self.storm_window * 1e6), None, {"src": F.col("src")}, at_least=self.storm)
        text = F.concat(F.col("n"), F.lit(" gratuitous arps from "), F.col("sender_mac"), F.lit(f" within {number_text(self.storm_window)}s"))
        return found.select(*_alert(self.name, self.severity, F.col("end_us"), F.col("src"), F.lit(None), text, F.col("evidence"), 1, F.col("sender_mac")))

    def detect(self, events: DataFrame) -> DataFrame:
        return self.conflicts(events).unionByName(self.storms(events))


def watched(spark: SparkSession, domains: list[str]) -> DataFrame:
    """A watch list as rows (domain, no) in list order; repeated domains count once."""
    return spark.createDataFrame([(d.lower(), i) for i, d in reversed(list(enumerate(domains)))], "domain string, no int").groupBy("domain").agg(F.min("no").alias("no"))


def suffixes(name: Column) -> Column:
    """A name and all its parents: a.b.c, b.c, c."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def match_watchlist(rows: DataFrame, name: str, watch: DataFrame, key: str = "seq") -> DataFrame:
    """``rows`` with the first watched domain (by list order) that ``name`` is or lies under.

    Names are taken apart into their parents, so that the match is an equi-join whatever the
    length of the list; Spark broadcasts the list where its size allows.
    """
    own = rows.select("*", F.explode(suffixes(F.lower(F.col(name)))).alias("domain")).join(watch, "domain")
    best = own.groupBy(key).agg(F.min_by("domain", "no").alias("domain"))
    return rows.join(best, key)


@dataclass
class SniWatch:
    """TLS server names on a watch list."""

    domains: list[str] = field(default_factory=list)
    name: str = "sni-watchlist"
    severity: str = "medium"

    def detect(self, events: DataFrame) -> DataFrame:
        rows = timed(events).where((F.col("event") == "ssl") & F.col("sni").isNotNull()).select("seq", "uid", "ts_us", "src", "dst", "sni")
        hits = match_watchlist(rows, "sni", watched(events.sparkSession, self.domains) if self.domains else events.sparkSession.createDataFrame([], "domain string, no int"))
        order = Window.partitionBy("src", "domain").orderBy("seq")
        found = hits.withColumn("i", F.row_number().over(order)).groupBy("src", "domain").agg(
            F.min_by(F.struct("ts_us", "dst"), "seq").alias("f"), first_uids(F.col("i"), most=EVIDENCE).alias("evidence")
        )
        text = F.concat(F.col("src"), F.lit(" connected to watched domain "), F.col("domain"))
        return found.select(*_alert(self.name, self.severity, F.col("f.ts_us"), F.col("src"), F.col("f.dst"), text, F.col("evidence"), 0, F.col("src"), F.col("domain")))


def default_rules() -> list:
    return [PortScan(), Beaconing(), DnsTunnel(), ArpSpoof(), SniWatch()]


class RuleEngine:
    """Rules in order; alerts of all runs are numbered on from ``alert1``."""

    def __init__(self, rules: list | None = None, first: int = 1):
        self.rules = default_rules() if rules is None else list(rules)
        self.next = first

    def register(self, rule: Detection) -> RuleEngine:
        self.rules.append(rule)
        return self

    def alerts(self, events: DataFrame) -> DataFrame:
        """All alerts, numbered from this engine's next number; plans only."""
        out = None
        rows = timed(events)
        for i, rule in enumerate(self.rules):
            own = rule.detect(rows).withColumn("rule", F.lit(i))
            out = own if out is None else out.unionByName(own)
        if out is None:
            raise ValueError("no rules")
        # alerts are few: one a firing group
        number = F.row_number().over(Window.orderBy("rule", *KEYS)) + F.lit(self.next - 1)
        return out.select(F.concat(F.lit("alert"), number).alias("uid"), *ALERT, number.alias("no"))

    def run(self, events: DataFrame) -> DataFrame:
        """As ``alerts``; the next run's numbers follow on."""
        out = self.alerts(events).persist()
        self.next += out.count()
        return out


def with_evidence(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Alerts joined to the events that they name: (alert_uid, event columns)."""
    named = alerts.select(F.col("uid").alias("alert_uid"), F.explode("evidence").alias("uid"))
    return named.join(events, "uid")
