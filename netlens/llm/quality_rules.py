"""Operator 1: quality rules.

A table of thresholds is compiled into one projection of built-in functions: lengths,
symbols, stop words and line ratios of each text, then a verdict. No user function, no
shuffle: a text never leaves its task.

Defined results: a null text counts as an empty one; a text without words has all counts 0
and fails the base rule; input columns that share a name with an output column give way;
other columns are kept; rows are never merged, so repeated rows stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, fewer, let

# Common function words of the four languages of the corpus.
STOP_WORDS = {
    "en": "the of and to in is that on it for was as with be this by are or at from not an he they have",
    "de": "der die das und in zu den von mit ist im des für auf dem nicht ein eine als auch sich es an wird aus",
    "fr": "le la les de des et en un une du est que qui dans pour par sur au il ne pas avec ce se sont dans elle",
    "es": "el la los las de y en que un una es del por con para su al lo como se no más este sus",
}

#: (rule, measure, least, most); None: no bound. The order is that of the reasons.
THRESHOLDS: list[tuple[str, str, float | None, float | None]] = [
    ("words", "n_words", 50, None),
    ("mean_word_length", "mean_word_length", 2.0, 14.0),
    ("symbols_per_word", "symbol_ratio", None, 0.10),
    ("exclamations_per_word", "exclaim_ratio", None, 0.20),
    ("stop_words", "stop_ratio", 0.04, None),
    ("duplicate_lines", "dup_line_ratio", None, 0.50),
    ("ellipsis_lines", "ellipsis_line_ratio", None, 0.30),
    ("bullet_lines", "bullet_line_ratio", None, 0.90),
    ("repeated_windows", "repeat_ratio", None, 0.50),
]

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
OUTPUTS = (*BASE, "n_lines", "n_stop_words", "n_exclaims", "base_failed", "failed_rules", "kept")


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.array_remove(F.split(F.translate(text, SPACES[1:], " " * 5), " "), "")


def repeat_words(words: Column) -> Column:
    """How many words lie in a 3-word window that the text has twice or more, in n log n.

    Windows are sorted by a 64-bit hash, neighbours with equal hash and words are the
    repeated ones, and the sorted starts of those give the number of words covered.
    """

    def starts(w: Column) -> Column:
        windows = F.transform(
            F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
            lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
        )

        def same(a: Column, b: Column) -> Column:
            return F.coalesce(
                (a["h"] == b["h"]) & (F.get(w, a["i"]) == F.get(w, b["i"])) & (F.get(w, a["i"] + 1) == F.get(w, b["i"] + 1)) & (F.get(w, a["i"] + 2) == F.get(w, b["i"] + 2)),
                F.lit(False),
            )

        repeated = lambda s: F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
        return F.sort_array(F.transform(let(F.sort_array(windows), repeated), lambda x: x["i"]))

    def covered(d: Column) -> Column:
        steps = F.transform(d, lambda p, k: F.least(F.coalesce(F.get(d, k + 1) - p, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(let(words, starts), covered)


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the counts that the thresholds use."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    count = lambda chars: (F.length(whole) - F.length(F.translate(whole, chars, ""))).cast("long")
    stops = sorted({w for x in STOP_WORDS.values() for w in x.split()})

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(stops))).cast("long").alias("n_stop_words"),
            repeat_words(w).alias("n_repeat_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(x, lambda y: F.rtrim(y).endswith("...") | F.rtrim(y).endswith("…"))).cast("long").alias("n_ellipsis_lines"),
            F.size(F.filter(x, lambda y: F.substring(F.ltrim(y), 1, 1).isin("-", "*", "•"))).cast("long").alias("n_bullet_lines"),
        )

    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    rest = fewer(df, *OUTPUTS)
    counts = F.struct(
        F.length(F.translate(whole, SPACES, "")).cast("long").alias("word_chars"),
        count("#*$%&|<>").alias("n_symbols"),
        count("!").alias("n_exclaims"),
        let(words_of(whole), of_words).alias("__w"),
        let(lines, of_lines).alias("__l"),
    )
    # one generated row, through which no filter moves: a filter on the verdict counts once, too
    return rest.select("*", F.inline(F.array(counts))).select(*[F.col(f"`{c}`") for c in rest.columns], "word_chars", "n_symbols", "n_exclaims", "__w.*", "__l.*")


def compiled(thresholds=THRESHOLDS) -> Column:
    """The names of the rules that a measured row breaks, as one expression."""
    over = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    measures = {
        "n_words": F.col("n_words"),
        "mean_word_length": over("word_chars", "n_words"),
        "symbol_ratio": over("n_symbols", "n_words"),
        "exclaim_ratio": over("n_exclaims", "n_words"),
        "stop_ratio": over("n_stop_words", "n_words"),
        "dup_line_ratio": over("n_dup_lines", "n_lines"),
        "ellipsis_line_ratio": over("n_ellipsis_lines", "n_lines"),
        "bullet_line_ratio": over("n_bullet_lines", "n_lines"),
        "repeat_ratio": over("n_repeat_words", "n_words"),
    }
    broken = []
    for rule, measure, least, most in thresholds:
        x = measures[measure]
        bad = F.lit(False)
        if least is not None:
            bad = bad | (x < F.lit(least))
        if most is not None:
            bad = bad | (x > F.lit(most))
        broken.append(F.when(bad, F.lit(rule)))
    return F.array_compact(F.array(*broken))


def quality_rules(df: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """``df`` with counts, ``base_failed``, ``failed_rules`` and ``kept``."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = measured(df, text).select("*", base.alias("base_failed"), compiled(thresholds).alias("failed_rules"))
    return out.select("*", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"))
