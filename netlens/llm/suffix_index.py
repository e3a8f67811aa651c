"""Sparse suffix arrays of texts, as rows: what operator 11 keeps in its index levels.

Only suffixes that start at an anchor are kept. The anchor of a window (``WINDOW`` bytes) is the
place of the least fingerprint among its substrings of ``GRAM`` bytes, the leftmost among equals.
It depends on the window's bytes alone, so two equal windows have their anchors at the same
offset: every match of ``WINDOW`` bytes is seen at a pair of anchors, and no suffix between
anchors is needed. Consecutive windows with one anchor are a run.

A row is (gram, run, text, at): the fingerprint of the ``GRAM`` bytes at the anchor, that of all
bytes of the run with the anchor's offset, the text's id, and the place packed as anchor, offset
of the run's first window before it, and number of windows. Rows in order of (gram, run) are a
suffix array in which suffixes that agree for ``GRAM`` bytes are neighbours, and those whose whole
run agrees stand side by side. ``gram`` and ``run`` are 64 bits each and of different sums; both
must agree for a match, so 128 bits stand for the bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

WINDOW, GRAM = 200, 72
#: Windows that can share an anchor, and bytes of text that are worked on at a time (longer texts in overlapping pieces).
SPAN, PIECE = WINDOW - GRAM + 1, 1 << 20
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_PLACE_BITS = 24
_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, _U)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * _U(pow(base, have, 1 << 64))
        have += more
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class Sums:
    """Prefix sums of a byte string, from which the fingerprint of any substring is one product."""

    _tables: list = []

    def __init__(self, raw: np.ndarray, which: int):
        if not Sums._tables:
            draw = np.random.default_rng(200)
            for base in _BASES:
                inverse = pow(base, -1, 1 << 64)
                Sums._tables.append((draw.integers(1, 1 << 63, 256, dtype=_U) | _U(1), _powers(base, PIECE + 2 * WINDOW), _powers(inverse, PIECE + 2 * WINDOW)))
        values, up, self.down = Sums._tables[which]
        self.sums = np.zeros(len(raw) + 1, _U)
        np.cumsum(values[raw] * up[: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Fingerprints of raw[start:end]."""
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def grams(self, size: int) -> np.ndarray:
        """Fingerprints of all substrings of a size."""
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:n]) * self.down[:n]


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        keys = np.minimum(keys[:-have], keys[have:])
        have *= 2
    return np.minimum(keys[: len(keys) - (width - have)], keys[width - have :]) if have < width else keys


def packed(anchor: np.ndarray, before: np.ndarray, windows: np.ndarray) -> np.ndarray:
    return (anchor << 16) | (before << 8) | windows


def unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window's start, offset of the anchor in it, windows)."""
    before = (at >> 8) & 0xFF
    return (at >> 16) - before, before, at & 0xFF


def rows_of(raw: np.ndarray, ends: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gram, run, no, at) of texts that stand one after another in ``raw``; windows stay inside a text.

    ``ends``: where each text ends; ``base``: what its first byte's place counts as.
    """
    if len(raw) < WINDOW:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    sums = Sums(raw, 0)
    grams = _mixed(sums.grams(GRAM))
    low = _U((1 << _PLACE_BITS) - 1)
    keys = (grams & ~low) | np.arange(len(grams), dtype=_U)
    anchor = (_least(keys, SPAN) & low).astype(np.int64)  # of each window
    starts = np.concatenate([[0], ends[:-1]])
    no = np.repeat(np.arange(len(ends)), ends - starts)[: len(anchor)]
    inside = np.arange(len(anchor)) + WINDOW <= ends[no]
    fresh = np.ones(len(anchor), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (no[1:] != no[:-1])
    first = np.flatnonzero(fresh & inside)
    stops = np.flatnonzero(np.append(fresh[1:] | ~inside[1:], True) & inside)
    count, place = stops - first + 1, anchor[first]
    before = place - first
    other = Sums(raw, 1)
    run = _mixed(other.of(first, stops + WINDOW) + (before * 256 + count).astype(_U) * _U(0xA24BAED4963EE407))
    own = no[first]
    return grams[place].view(np.int64), run.view(np.int64), own, packed(place - starts[own] + base[own], before, count)


def pieces(texts: Iterable[tuple[int, bytes]], size: int = PIECE) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of (id, bytes) gathered to about ``size`` bytes (``PIECE`` at most), longer ones cut with an overlap: (ids, raw, ends, base)."""
    ids: list[int] = []
    parts: list[bytes] = []
    base: list[int] = []
    held = 0
    for name, text in texts:
        for at in range(0, max(len(text) - WINDOW + 1, 0), size):
            part = text[at : at + size + WINDOW - 1]
            if held + len(part) > size + WINDOW:
                yield ids, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), np.array(base, np.int64)
                ids, parts, base, held = [], [], [], 0
            ids.append(name)
            parts.append(part)
            base.append(at)
            held += len(part)
    if parts:
        yield ids, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), np.array(base, np.int64)


def window_prints(raw: np.ndarray, start: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Fingerprints of the windows that begin at start, start + 1, ... of each run, one after another."""
    which = np.repeat(start, windows) + (np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows))
    return _mixed(Sums(raw, 1).of(which, which + WINDOW))
