"""Operator 7: best-fit packing of token pieces with a swap-based local search.

Documents are encoded and cut in map tasks; only piece rows (no text, no ids) are shuffled.
Pieces are dealt at random in groups of about ``group_rows``, each packed in one task: best fit
in decreasing order, then a local search that empties the least filled bin by moves and by
one-for-one, two-for-one and one-for-two exchanges, each of which raises the sum of squared
fills. Exchanges are looked for between lengths, not pieces, and a bin is tried once for all bins
of the same lengths. What lies in clearly underfull bins of all groups is packed again, until one
group is left or no bin is saved, so that the waste does not grow with the number of groups.

Defined results: null and empty texts are one piece with the end id; a document longer than a
sequence is cut in full pieces, its first piece has the rest; repeated rows are packed each;
an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .tokens import encoder, slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECE_COLUMNS = [x.split()[0] for x in PIECES.split(", ")]


def cuts(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n % most or min(n, most)
    return [(0, first)] + [(s, most) for s in range(first, n, most)]


def token_pieces(df: DataFrame, vocabulary: str, end_id: int, most: int, key: str = "doc_id", text: str = "text", keeps_blanks: bool = True, with_ids: bool = False) -> DataFrame:
    """One row a piece, and its ids if asked for."""
    end = int(end_id).to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(vocabulary, keeps_blanks)
        for batch in batches:
            for part in slices(batch, 4096, 4 << 20):  # the more at once, the fewer words are looked up
                rows = []
                for k, ids in zip(part.column(0).to_pylist(), code.encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    for no, (s, n) in enumerate(cuts(len(ids) // 4, most)):
                        own = ids[4 * s : 4 * (s + n)]
                        rows.append((k, no, s, n, zlib.crc32(own), own))
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                n = 6 if with_ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:n], kinds[:n], strict=True)], names=names[:n])

    docs = df.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("t"))
    return docs.mapInArrow(pieces, PIECES + ", ids binary" * with_ids)


def best_fit(lengths: list[int], most: int) -> list[list[int]]:
    """Bins of piece numbers: longest piece first, each in the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(most + 1)]
    rooms = 0  # bit r: some bin has room r
    for p in sorted(range(len(lengths)), key=lambda p: (-lengths[p], p)):
        n = lengths[p]
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = most, len(bins)
            bins.append([])
        bins[b].append(p)
        by_room[room - n].append(b)
        rooms |= 1 << (room - n)
    return bins


def _sums(counts: Counter) -> list[tuple[int, tuple]]:
    """(tokens, lengths) of no, one or two pieces of a bin, each choice of lengths once."""
    kinds = sorted(counts)
    two = [(a + b, (a, b)) for i, a in enumerate(kinds) for b in kinds[i:] if a != b or counts[a] > 1]
    return [(0, ())] + [(a, (a,)) for a in kinds] + two


def _exchange(donor: Counter, other: Counter, room: int, surplus: int) -> tuple[int, tuple, tuple]:
    """The exchange that moves most tokens from donor to other: (gain, out of donor, out of other).

    It fits in ``room`` and leaves the sum of squared fills higher: with ``surplus`` more tokens
    in other than in donor, a gain of x raises it where x > -surplus. One for none, one for one, two
    for none, two for one and one for two are tried.
    """
    best = (0, (), ())
    backs = _sums(other)
    by_size = [[x for x in backs if len(x[1]) == k] for k in range(3)]
    for n, out in _sums(donor)[1:]:
        for back in by_size[: 4 - len(out)]:
            # the most that fits: the least that comes back for n - m <= room
            at = bisect_left(back, (n - room,))
            if at < len(back) and best[0] < (gain := n - back[at][0]) and gain > -surplus:
                best = (gain, out, back[at][1])
    return best


def local_search(bins: list[list[int]], lengths: list[int], most: int) -> list[list[int]]:
    """Empties the least filled bin again and again, while each step raises the sum of squared fills."""
    fill = [sum(lengths[p] for p in b) for b in bins]
    held = [Counter(lengths[p] for p in b) for b in bins]
    pieces: list[dict[int, list[int]]] = []
    for b in bins:
        own: dict[int, list[int]] = {}
        for p in b:
            own.setdefault(lengths[p], []).append(p)
        pieces.append(own)

    def move(a: int, b: int, out: tuple) -> None:
        for n in out:
            pieces[b].setdefault(n, []).append(pieces[a][n].pop())
            held[b][n] += 1
            held[a][n] -= 1
            if not held[a][n]:
                del held[a][n]
            fill[a] -= n
            fill[b] += n

    open_bins = [(f, b) for b, f in enumerate(fill) if 0 < f < most]
    heapify(open_bins)
    left = -(-sum(fill) // most)
    used = sum(f > 0 for f in fill)
    while used > left and len(open_bins) > 1:
        donor = heappop(open_bins)[1]
        others = sorted(open_bins, reverse=True)
        moved, failed = set(), set()
        for _, b in others:
            kind = (fill[b], tuple(sorted(held[b].items())))
            if kind in failed:
                continue
            stuck = True
            while fill[donor] and fill[b] < most:
                gain, out, back = _exchange(held[donor], held[b], most - fill[b], fill[b] - fill[donor])
                if not gain:
                    break
                move(donor, b, out)
                move(b, donor, back)
                moved.add(b)
                stuck = False
                failed = set()
            if stuck:
                failed.add(kind)
            if not fill[donor]:
                break
        if not fill[donor]:
            used -= 1
        elif not moved:
            break
        else:
            moved.add(donor)
        if moved:
            open_bins = [(fill[b], b) for b in {x[1] for x in open_bins} | {donor} if 0 < fill[b] < most]
            heapify(open_bins)
    return [[p for ps in own.values() for p in ps] for own in pieces if any(own.values())]


def packed_group(rows: pa.Table, most: int, open_below: float) -> pa.Table:
    """The rows of one group with their bin, place and whether the bin is clearly underfull."""
    rows = rows.sort_by([(c, "ascending") for c in ("doc_id", "piece", "ids_crc32", "start")])
    lengths = rows.column("length").to_pylist()
    part = [p for p, n in enumerate(lengths) if n < most]
    bins = [[p] for p, n in enumerate(lengths) if n >= most]
    own = [lengths[p] for p in part]
    bins += [[part[p] for p in b] for b in local_search(best_fit(own, most), own, most)]
    no, place, loose = (np.zeros(len(lengths), t) for t in (np.int64, np.int64, bool))
    for b, ps in enumerate(bins):
        at = 0
        for p in ps:
            no[p], place[p] = b, at
            at += lengths[p]
        loose[ps] = at < open_below * most
    for name, values in (("bin", no), ("offset", place), ("loose", loose)):
        rows = rows.append_column(name, pa.array(values))
    return rows


def pack(pieces: DataFrame, most: int, group_rows: int = 8192, open_below: float = 0.97) -> DataFrame:
    """Piece rows with ``sequence_id`` and ``offset``."""
    # a random place in the table, kept with it: equal rows and null keys are dealt as all others
    todo = written(pieces.withColumn("place", F.rand(7)), "pieces")
    closed, level, before = [], 0, None
    out_schema = PIECES + ", place double, grp long, bin long, offset long, loose boolean"
    n = todo.count()
    while True:
        groups = max(1, round(n / group_rows))
        dealt = todo.withColumn("grp", F.floor(F.pmod(F.col("place") * F.lit(7919.0**level), F.lit(1.0)) * groups))
        done = written(dealt.groupBy("grp").applyInArrow(lambda x: packed_group(x, most, open_below), out_schema), "packed")
        number = (F.lit(level) * F.lit(1 << 56) + F.col("grp") * F.lit(1 << 24) + F.col("bin")).alias("sequence_id")
        columns = ["doc_id", "piece", "start", "length", "ids_crc32", number, "offset"]
        loose = done.where("loose")
        rows, bins, tokens = loose.agg(F.count("*"), F.count_distinct("grp", "bin"), F.sum("length")).first()
        # over when one group holds all, when full bins could not be fewer, or when the last round saved none
        if groups == 1 or not rows or bins <= -(-tokens // most) or (before is not None and bins >= before):
            closed.append(done.select(*columns))
            break
        closed.append(done.where("not loose").select(*columns))
        todo, n, level, before = loose.select(*PIECE_COLUMNS, "place"), rows, level + 1, bins
    out = closed[0]
    for x in closed[1:]:
        out = out.unionByName(x)
    return out


def best_fit_packing(df: DataFrame, vocabulary: str, end_id: int = 0, most: int = 2048, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """All texts of ``df`` as pieces placed in sequences of at most ``most`` tokens."""
    return pack(token_pieces(df, vocabulary, end_id, most, key, text), most, **options)
