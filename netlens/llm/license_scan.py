"""Operator 9: license scan by the Dice coefficient of word bigrams.

Each line, each block of lines between blank lines and each whole text is a unit. A unit's
words (lower case letters and digits) give a bigram multiset; it matches the template with the
highest Dice coefficient of at least ``least``. A template of b bigrams can only reach
``least`` for units of between b * least / (2 - least) and b * (2 - least) / least bigrams, so
sizes prune templates (and all of them for most units) before any bigram is compared.

A notice inside a longer unit is found by windows: each run of as many words as a template has,
anywhere in the text, is compared with it. A window that reaches ``least`` has a bigram of any
set that holds more than (1 - least) of the template's bigrams, so only windows over the rare
bigrams of the template are counted; none that matches is lost.

Of overlapping units that match one template the best stays (then the smaller). Windows add rows
where no unit is: the one with most common bigrams stays (then the better, the earlier). Places
are the same where more than 1 - ``least`` of the words are, of the shorter one for one license
and of the longer one for two, so that a short notice of another license in a long one stays.

Defined results: null and empty texts have no rows; each occurrence is a row; equal
coefficients go to the template that is first by name.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_templates import TEMPLATES
from .tokens import slices

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:]))


class Matcher:
    def __init__(self, templates: dict[str, list[str]], least: float):
        self.least = least
        self.templates = sorted((name, bigrams(words_of(t))) for name, texts in templates.items() for t in texts)
        self.sized = [(name, t, sum(t.values())) for name, t in self.templates]
        self.bounds = [(n * least / (2 - least), n * (2 - least) / least) for _, _, n in self.sized]
        self.fewest, self.most = min(b[0] for b in self.bounds), max(b[1] for b in self.bounds)
        self.known = {g for _, t in self.templates for g in t}
        #: rare bigram -> the templates (by number) of which no window can match without any such
        self.rare = defaultdict(list)
        for k, (_, t, n) in enumerate(self.sized):
            left = n
            # long words are rare
            for g in sorted(t, key=lambda g: (-len(g[0]) - len(g[1]), g)):
                if left / n < least:
                    break
                self.rare[g].append(k)
                left -= t[g]

    def best(self, words: list[str]) -> tuple[str, float] | None:
        n = len(words) - 1
        if not self.fewest <= n <= self.most:
            return None
        fits = [x for x, (low, high) in zip(self.sized, self.bounds, strict=True) if low <= n <= high]
        if not fits or self.known.isdisjoint(zip(words, words[1:])):
            return None
        own, found = bigrams(words), None
        for name, t, m in fits:
            dice = 2 * sum(min(c, own[g]) for g, c in t.items() if g in own) / (n + m)
            if dice >= self.least and (found is None or dice > found[1]):
                found = (name, dice)
        return found

    def windows(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(common bigrams, template number, first word) of all windows of a template's length that reach ``least``."""
        if self.rare.keys().isdisjoint(zip(words, words[1:])):
            return []
        grams, near = list(zip(words, words[1:])), defaultdict(list)
        for i, g in enumerate(grams):
            for k in self.rare.get(g, ()):
                n, spans = self.sized[k][2], near[k]
                low, high = max(i - n + 1, 0), min(i, len(grams) - n)
                if spans and low <= spans[-1][1] + 1:
                    spans[-1][1] = max(spans[-1][1], high)
                elif low <= high:
                    spans.append([low, high])
        out = []
        for k, spans in near.items():
            _, t, n = self.sized[k]
            for low, high in spans:
                own = Counter(g for g in grams[low : low + n] if g in t)
                common = sum(min(c, t[g]) for g, c in own.items())
                for i in range(low, high + 1):
                    if i > low:
                        if (g := grams[i - 1]) in t:
                            own[g] -= 1
                            common -= own[g] < t[g]
                        if (g := grams[i + n - 1]) in t:
                            common += own[g] < t[g]
                            own[g] += 1
                    if common / n >= self.least:
                        out.append((common, k, i))
        return out

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license, dice, first line, lines) of the units and windows that match."""
        lines = (text or "").split("\n")
        # a word never spans lines
        words = [words_of(x) if x else [] for x in lines]
        units = [(i, i + 1) for i, w in enumerate(words) if w]
        start = None
        for i in range(len(lines) + 1):
            if i < len(lines) and lines[i].strip():
                start = i if start is None else start
            elif start is not None:
                units.append((start, i))
                start = None
        units.append((0, len(lines)))
        hits, done = [], set()
        for a, b in units:
            if (a, b) in done:
                continue
            done.add((a, b))
            n = sum(map(len, words[a:b])) - 1
            if self.fewest <= n <= self.most and (m := self.best([w for x in words[a:b] for w in x])):
                hits.append((*m, a, b - a))
        kept: list = []
        taken: dict[str, list[tuple[int, int]]] = defaultdict(list)  # of each license the lines that are kept, in order and apart
        for h in sorted(hits, key=lambda h: (-h[1], h[3], h[2])):
            own, span = taken[h[0]], (h[2], h[2] + h[3])
            at = bisect_left(own, span)
            if (at == len(own) or span[1] <= own[at][0]) and (at == 0 or own[at - 1][1] <= span[0]):
                own.insert(at, span)
                kept.append(h)
        if found := self.windows([w for x in words for w in x]):
            kept += self._added(found, kept, words)
        return sorted(kept, key=lambda h: (h[2], h[3], h[0]))

    def _added(self, found: list, kept: list, words: list[list[str]]) -> list[tuple[str, float, int, int]]:
        """The rows of the windows that stay beside the units that stay."""
        ends = list(accumulate(map(len, words)))
        line_of = lambda i: bisect_right(ends, i)
        # (license, first word, end); listed under each stretch of text that they touch
        places, longest = defaultdict(list), max((n for _, _, n in self.sized), default=0) + 1

        def same(name: str, a: int, b: int, place: tuple) -> bool:
            common = min(b, place[2]) - max(a, place[1])
            sizes = (b - a, place[2] - place[1])
            return common > (1 - self.least) * (min(sizes) if name == place[0] else max(sizes))

        def put(name: str, a: int, b: int) -> None:
            for x in range(a // longest, (b - 1) // longest + 1):
                places[x].append((name, a, b))

        for name, _, first, n in kept:
            put(name, ends[first] - len(words[first]), ends[first + n - 1])
        out = []
        for common, k, a in sorted(found, key=lambda w: (-w[0], -w[0] / self.sized[w[1]][2], w[2], w[1])):
            name, _, n = self.sized[k]
            b = a + n + 1
            if any(same(name, a, b, p) for x in range(a // longest, (b - 1) // longest + 1) for p in places[x]):
                continue
            put(name, a, b)
            out.append((name, common / n, line_of(a), line_of(b - 1) - line_of(a) + 1))
        return out


def license_scan(df: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, least: float = 0.8) -> DataFrame:
    """(key, license, dice, first_line, n_lines): one row a match."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, least)
        for batch in batches:
            for part in slices(batch):
                rows = [(k, *h) for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for h in matcher.scan(t)]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[key, "license", "dice", "first_line", "n_lines"])

    docs = df.select(F.col(f"`{key}`").cast("long").alias(key), F.col(f"`{text}`"))
    return docs.mapInArrow(scanned, f"`{key}` long, license string, dice double, first_line long, n_lines long")
