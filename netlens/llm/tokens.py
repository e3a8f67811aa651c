"""Whole texts to token ids with the tokenizers library, inside Arrow batches.

Words repeat far more often than texts, so a text is cut at blanks where the tokenizer
starts a new pre-token anyway and each distinct piece is encoded once a worker. Pieces of Latin
letters, digits and signs are cut in pre-tokens here and given to the tokenizer's model, all
others to the whole tokenizer. A byte-level vocabulary's texts are split and put together again
as Arrow columns, many at once: Python sees each distinct word once a part. The vocabulary's
added tokens (``<|endoftext|>``) have their own ids wherever their strings stand in a text, as
the library has it by default. The ids are exactly those of encoding the whole text at once.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from codecs import charmap_decode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Entries of a generation of each of a worker's memories and characters of a key that one takes:
#: about 200 bytes an entry, so 30 MB a generation at most (speed only).
REMEMBERED, LONGEST = 150_000, 64
#: White space by any of the definitions in use; a cut has none of it on either side.
_BLANK = r"\s\x1c-\x1f\x85\u180e\u200b\ufeff"
_CUT = re.compile(rf"(?<=[^{_BLANK}])(?= [^{_BLANK}])")
_EDGE = re.compile(rf"[{_BLANK}]")
#: Texts with one of these are not cut at line ends.
_PART_OF_A_RUN = ("\n\n", "\n\t", "\r")
_LATIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\u024f]+")
# The pre-token patterns of the two kinds of tokenizers.
_WITH_BLANKS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_WITHOUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = sorted(set(range(256)) - set(_PRINTED))
#: Bytes to the byte-level alphabet: printed bytes stay, the others follow from 256 on.
_ALPHABET = "".join(chr(b) if b in _PRINTED else chr(256 + _OTHERS.index(b)) for b in range(256))

_encoders: dict[tuple[str, bool], WordEncoder] = {}


class Remembered(dict):
    """A value for each key, made when it is first asked for; long keys are not kept.

    When it is full a new generation begins: keys that are asked for again move over from the
    one before, all others go with it.
    """

    def __init__(self, make, most: int = REMEMBERED):
        super().__init__()
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if not isinstance(key, str) or len(key) <= LONGEST:
            if len(self) >= self.most:
                self.before = dict(self)
                self.clear()
            self[key] = value
        return value


class WordEncoder:
    """Texts to little-endian unsigned 32-bit ids.

    ``keeps_blanks``: the tokenizer's pre-tokens carry the blank before them (byte-level);
    else white space is dropped, case is lowered and each blank is a cut. ``specials_as_text``:
    the strings of added tokens are ordinary text, not tokens.
    """

    def __init__(self, path: str, keeps_blanks: bool, specials_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError("an added token takes what stands beside it: texts cannot be cut there")
        self.specials = {} if specials_as_text else {t.content: _packed([i]) for i, t in added.items()}
        self.special = re.compile("|".join(re.escape(t) for t in sorted(self.specials, key=len, reverse=True)))
        self.tokenizer.encode_special_tokens = True  # texts are cut at them before
        self.tokenize = self.tokenizer.model.tokenize
        self.keeps_blanks = keeps_blanks
        # three generations' worth either way: words after a blank are most of what is asked for
        few = REMEMBERED // 2 if keeps_blanks else REMEMBERED
        self.pre_tokens = Remembered(self._pre_token, few)
        self.pieces = Remembered(self._piece, few if keeps_blanks else 2 * REMEMBERED)
        #: what follows a blank, or a line end and what follows it; None where that may be no cut
        self.later = Remembered(self._after_blank, 2 * REMEMBERED) if keeps_blanks else self.pieces

    def _pre_token(self, text: str) -> bytes:
        return _packed([t.id for t in self.tokenize(charmap_decode(text.encode(), "strict", _ALPHABET)[0])])

    def _piece(self, piece: str) -> bytes:
        if piece and _LATIN.fullmatch(piece):
            if self.keeps_blanks:
                return b"".join([self.pre_tokens[x] for x in _WITH_BLANKS.findall(piece)])
            low = piece.lower()
            if low.isascii() or _LATIN.fullmatch(low):
                if low.isalpha():
                    return self.pre_tokens[piece if low == piece else low]
                if low[:-1].isalpha() and low[-1] in ",.!?;:":
                    return self.pre_tokens[low[:-1]] + self.pre_tokens[low[-1]]
                return b"".join([self.pre_tokens[x] for x in _WITHOUT.findall(low)])
        return _packed(self.tokenizer.encode_batch_fast([piece], add_special_tokens=False)[0].ids)

    def _after_blank(self, piece: str) -> bytes | None:
        if piece[:1] == "\n":
            return None if piece == "\n" or _EDGE.match(piece[1]) or _EDGE.match(piece[-1]) else self.pre_tokens["\n"] + self.pieces[piece[1:]]
        if piece.isascii() or _LATIN.fullmatch(piece):
            if piece.isalpha():
                return self._pre_token(" " + piece)
            if piece[:-1].isalpha() and piece[-1] in ",.!?;:":
                return self.later[piece[:-1]] + self.pre_tokens[piece[-1]]
        if not piece or _EDGE.match(piece[0]) or _EDGE.match(piece[-1]):
            return None
        if _LATIN.fullmatch(piece):
            first, *others = _WITH_BLANKS.findall(" " + piece)
            return b"".join([self.later[first[1:]] if first[1:].isalpha() else self.pre_tokens[first], *[self.pre_tokens[x] for x in others]])
        return self._piece(" " + piece)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [self._between_specials(t or "") for t in texts]
        codes = iter((self._in_columns if self.keeps_blanks else self._by_words)([x for plain, _ in cut for x in plain]))
        return [b"".join([x for b in (b"", *found) for x in (b, next(codes))]) for _, found in cut]

    def _between_specials(self, text: str) -> tuple[list[str], list[bytes]]:
        if not any(map(text.__contains__, self.specials)):
            return [text], []
        return self.special.split(text), [self.specials[x] for x in self.special.findall(text)]

    def _by_words(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            head, *rest = text.split(" ")
            yield self.pieces[head] + b"".join(map(self.later.__getitem__, rest))

    def _in_columns(self, texts: list[str]) -> list[bytes]:
        """Texts are split at blanks and line ends in one Arrow column; those where one of them may be no cut, one by one."""
        parts, plain = [], []
        for t in texts:
            lines = t if any(map(t.__contains__, _PART_OF_A_RUN)) else t.replace("\n", " \n")
            parts.append(lines.partition(" "))
            head = parts[-1][0]
            # in ``later`` a line end at the beginning of a word is one that was cut off there
            plain.append(bool(head) and not _EDGE.match(head[-1]) and " \n" not in t)
        words = pc.split_pattern(pa.array([rest if ok and blank else None for ok, (_, blank, rest) in zip(plain, parts, strict=True)], pa.large_string()), " ")
        begins, coded = words.offsets.to_numpy(), words.values.dictionary_encode()
        codes = list(map(self.later.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)))
        if None in codes:
            places = np.flatnonzero(np.array([x is None for x in codes])[coded.indices.to_numpy()])
            for i in np.unique(np.searchsorted(begins, places, "right") - 1).tolist():
                plain[i] = False
        _, ends, data = pa.array(codes, pa.large_binary()).take(coded.indices).buffers()
        at = np.frombuffer(ends, np.int64)[begins].tolist() if len(coded) else [0] * len(begins)
        data = memoryview(data or b"")
        return [
            self.pieces[head] + bytes(data[s:e]) if ok else b"".join([self.pieces[x] for x in _CUT.split(t)])
            for t, ok, (head, _, _), s, e in zip(texts, plain, parts, at, at[1:], strict=False)
        ]


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def encoder(path: str, keeps_blanks: bool) -> WordEncoder:
    """The worker's own encoder for a vocabulary file; it lives as long as the worker, in bounded memory."""
    if (path, keeps_blanks) not in _encoders:
        _encoders[path, keeps_blanks] = WordEncoder(path, keeps_blanks)
    return _encoders[path, keeps_blanks]


def slices(batch, rows: int = 256, most: int = 1 << 20) -> Iterator:
    """An Arrow batch in parts of so many rows, and of so many bytes where it has more than one row."""
    rows = max(1, min(rows, batch.num_rows * most // max(1, batch.nbytes)))
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)
