"""Operator 4: secret scan with a random forest for false-positive removal.

One pattern finds candidates; built-in functions measure each (length, changes of character
class, dictionary coverage, path and neighbouring words); a random forest, trained from
labelled findings with Spark ML when the query is built, is compiled into one SQL expression.
All work on texts is one projection of built-in functions: no user function, no shuffle.

Defined results: null and empty texts have no findings; each occurrence is a finding, also of
a repeated value; a null path is an empty one; input columns named like an output give way.
A value after a key word wins over a random one. A quoted value ends at its closing quote on the
line (a backslash hides the next character); without one it is read like an unquoted value.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fewer, let
from .findings import labelled_findings

_PEM = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]+?-----END [A-Z ]{0,20}PRIVATE KEY-----"
# A key name starts where a random value could, so that at each such place the keyed match is tried first.
_NAME = r"(?:(?<![A-Za-z0-9_+/-])|\G)[A-Za-z0-9_+/-]*?"
_KEY = _NAME + r"(?i:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?[ \t]*+[:=][ \t]*+"
_QUOTED = r"\"(?:[^\"\\\r\n]|\\.){6,}+(?=\")|'(?:[^'\\\r\n]|\\.){6,}+(?=')"
_KEYED = _KEY + rf"(?:[\"']?{_PEM}|{_QUOTED}|[\"']?[^\s\"'<>,;]{{6,}}+)"
_HEAD = "^" + _KEY + r"[\"']?(?=[\s\S]{6})"
_RANDOM = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{12,}+={0,2}"
CANDIDATE = f"{_PEM}|{_KEYED}|{_RANDOM}"
# Characters of text before a candidate that are looked at, and candidates that can lie in them (of 10 characters at least).
NEAR, NEAR_FOUND = 60, 6

# Words that make a candidate an ordinary identifier.
DICTIONARY = """
the and for you your with that this from not are was have here test user name file image data table page title article section header window
size version beta alpha release notes backup final main local lib usr python site packages profile part src home thing example sample dummy
placeholder insert change changeme value key token secret password api article order number words before que der die und les des para nicht
auch dans pour avec con then it was so as on is la de of it
"""
_WORDS = "|".join(sorted({w for w in DICTIONARY.split() if len(w) >= 3}, key=lambda w: (-len(w), w)))
_CLASSES = ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "a" * 26 + "A" * 26 + "0" * 10)

FEATURES = ["length", "changes", "digits", "uppers", "hex", "covered", "distinct", "keyword", "harmless", "assigned", "in_path", "test_path", "known_prefix", "longest_digits"]


def features(value: Column, before: Column, after: Column, path: Column) -> list[Column]:
    """The measures of FEATURES as doubles; ``before`` and ``after`` are the neighbouring text."""
    n = F.greatest(F.length(value), F.lit(1))
    near = F.lower(F.right(F.regexp_replace(before, "[ \t]+", " "), F.lit(40)))
    share = lambda kept: (F.length(F.regexp_replace(value, kept, "")) / n)
    flag = lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
    runs = F.length(F.regexp_replace(F.translate(value, *_CLASSES), r"(.)\1*", "x"))
    return [
        F.length(value).cast("double"),
        (runs - 1) / n,
        share("[^0-9]"),
        share("[^A-Z]"),
        flag(value.rlike("^[0-9a-f]+$")),
        (n - F.length(F.regexp_replace(F.lower(value), _WORDS, ""))) / n,
        F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(64)),
        flag(near.rlike("token|secret|passw|passphrase|pwd|api.?key|access.?key|auth|credential|bearer|private")),
        flag(near.rlike("commit|sha|md5|checksum|digest|revision|hash|etag|build|integrity|fingerprint|changeset|uuid|order|invoice|phone|isbn|serial")),
        flag(before.rlike("[:=][ \t]*[\"']?$")),
        flag(before.rlike("/$|://[^ ]*$") | (F.length(value) - F.length(F.replace(value, F.lit("/"), F.lit(""))) >= 2)),
        flag(F.lower(path).rlike("test|example|sample|fixture|docs|mock")),
        flag(value.rlike("^(AKIA|ASIA|ghp_|gho_|sk-|xox[a-z]-|AIza|eyJ|glpat-|-----BEGIN)")),
        F.array_max(F.transform(F.split(value, "[^0-9]+"), lambda x: F.length(x))) / n,
    ]


def _parsed(lines: list[str]) -> Column:
    """A tree of Spark ML's debug text as an expression over the struct ``f``."""
    head = lines.pop(0).strip()
    if found := re.match(r"Predict: ([\d.]+)", head):
        return lambda f: F.lit(float(found[1]))
    kind, no, op, bound = re.match(r"(If|Else) \(feature (\d+) (<=|>) ([-\d.E]+)\)", head).groups()
    assert kind == "If" and op == "<="
    low = _parsed(lines)
    lines.pop(0)  # the matching Else
    high = _parsed(lines)
    return lambda f: F.when(f[int(no)] <= float(bound), low(f)).otherwise(high(f))


def trained_forest(spark: SparkSession, findings: list[dict] | None = None, trees: int = 20, depth: int = 6, seed: int = 7):
    """A function from feature columns to the share of trees that call a candidate a secret."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    kind = "array<struct<before:string,value:string,after:string,path:string,label:double>>"
    rows = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(findings or labelled_findings())), kind)))
    measured = rows.select("label", *[c.alias(n) for c, n in zip(features(F.col("value"), F.col("before"), F.col("after"), F.col("path")), FEATURES, strict=True)])
    x = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(measured).select("label", "x").coalesce(1)
    model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(x)
    parsed = [_parsed([s for s in t.toDebugString.splitlines()[1:] if s.strip()]) for t in model.trees]
    return lambda f: sum((p(f) for p in parsed[1:]), parsed[0](f)) / len(parsed)


def found(text: Column, path: Column, forest) -> Column:
    """All candidates of a text with their place, votes and verdict, and the text between them."""
    whole = F.coalesce(text, F.lit(""))
    matches = F.regexp_extract_all(whole, F.lit(CANDIDATE), F.lit(0))

    def judged(m: Column) -> Column:
        def of_parts(parts: Column) -> Column:
            ends = F.aggregate(
                m,
                F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
                lambda s, x: F.struct(
                    (s["i"] + 1).alias("i"),
                    (s["at"] + F.length(F.get(parts, s["i"])) + F.length(x)).alias("at"),
                    F.array_append(s["starts"], s["at"] + F.length(F.get(parts, s["i"]))).alias("starts"),
                ),
            )["starts"]

            # the text from one candidate's end to the next one's, as far as it is looked at
            tails = F.transform(m, lambda x, i: F.right(F.concat(F.right(F.get(parts, i), F.lit(NEAR)), x), F.lit(NEAR)))

            def of_starts(starts: Column, tails: Column) -> Column:
                def one(x: Column, i: Column) -> Column:
                    value = F.regexp_replace(x, _HEAD, "")
                    head = F.left(x, F.length(x) - F.length(value))
                    earlier = [F.coalesce(F.get(tails, i - k), F.lit("")) for k in range(NEAR_FOUND, 0, -1)]
                    before = F.concat(F.right(F.concat(*earlier, F.right(F.get(parts, i), F.lit(NEAR))), F.lit(NEAR)), head)
                    after = F.left(F.get(parts, i + 1), F.lit(40))
                    measures = F.array(*features(value, before, after, F.coalesce(path, F.lit(""))))
                    return let(
                        measures,
                        lambda f: F.struct(
                            (F.get(starts, i) + F.length(head)).cast("long").alias("start"),
                            F.length(value).cast("long").alias("length"),
                            value.alias("value"),
                            head.alias("head"),
                            F.when(value.startswith("-----BEGIN"), F.lit("private_key")).when(value.startswith("AKIA"), F.lit("access_key")).when(F.length(head) > 0, F.lit("keyed")).otherwise(F.lit("random")).alias("kind"),
                            forest(f).alias("votes"),
                        ),
                    )

                return F.transform(m, one)

            return F.struct(parts.alias("parts"), let(F.struct(ends.alias("starts"), tails.alias("tails")), lambda t: of_starts(t["starts"], t["tails"])).alias("found"))

        return F.when(F.size(m) > 0, let(F.split(whole, CANDIDATE), of_parts))

    return let(matches, judged)


def secret_scan(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = "source", least_votes: float = 0.5, forest=None) -> DataFrame:
    """One row a candidate: key, start, length, kind, votes, value and whether it is a secret."""
    forest = forest or trained_forest(df.sparkSession)
    at = F.col(f"`{path}`") if path else F.lit("")
    # one generated row, through which the filter does not move: a text is scanned once
    scanned = F.inline(F.array(F.struct(found(F.col(f"`{text}`"), at, forest).alias("__f"))))
    rows = df.select(F.col(f"`{key}`").alias(key), scanned).where("__f is not null")
    out = rows.select(key, F.inline("__f.found"))
    return out.select(key, "start", "length", "kind", "votes", "value", (F.col("votes") >= least_votes).alias("is_secret"))


def redact_secrets(df: DataFrame, text: str = "text", path: str | None = "source", least_votes: float = 0.5, mark: str = "[secret]", forest=None) -> DataFrame:
    """``df`` with each secret in the text replaced by ``mark``, and ``n_secrets``; no row is dropped."""
    forest = forest or trained_forest(df.sparkSession)
    at = F.col(f"`{path}`") if path else F.lit("")
    rest = fewer(df, "n_secrets")

    def rebuilt(f: Column) -> Column:
        secret = lambda x: x["votes"] >= least_votes
        pieces = F.transform(f["found"], lambda x, i: F.concat(F.get(f["parts"], i), x["head"], F.when(secret(x), F.lit(mark)).otherwise(x["value"])))
        n = F.size(F.filter(f["found"], secret))
        return F.struct(n.alias("n"), F.when(n > 0, F.concat(F.array_join(pieces, ""), F.element_at(f["parts"], -1))).alias("t"))

    marked = rest.select("*", let(found(F.col(f"`{text}`"), at, forest), rebuilt).alias("__r"))
    columns = [F.coalesce("__r.t", F.col(f"`{text}`")).alias(text) if c == text else F.col(f"`{c}`") for c in rest.columns]
    return marked.select(*columns, F.coalesce("__r.n", F.lit(0)).cast("long").alias("n_secrets"))
