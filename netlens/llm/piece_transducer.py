"""Operator 5: SentencePiece encoding and decoding by a weighted transducer.

Compiled from a model file into one machine: the normaliser (an arc that reads nothing and tells
the ▁ before the text; blank and ▁ lead to the same state), the lexicon (a trie over the pieces,
its final states tell a piece) and byte fallback (an arc for any character that no piece has). An
input is composed with it place by place, arcs are relaxed in topological order (from left to
right) and the shortest path of the tropical semiring is read backwards. Arcs weigh 1, and an arc
that follows another piece weighs infinity unless the model, which merges pairs by score (BPE),
would keep just this pair apart. With that constraint one path to each place is finite, and it is
the model's own encoding; a plain sum of piece scores would give other ids than the model.

Texts are cut where no piece reaches over: before blanks that follow something else, and between
two characters that no piece has side by side. A worker remembers the parts that it has encoded
(speed only).

Defined results: null and empty texts have no ids; any text encodes, unknown characters as
bytes; decoding gives the text again with ▁ as a blank.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fewer
from .tokens import Remembered, slices

BLANK = "▁"
#: Blanks with the word after them: what is encoded apart.
CHUNK = re.compile("[ ▁]+[^ ▁]*|[^ ▁]+")
#: Chunks, parts of chunks and pairs of pieces in a generation of a worker's memories (speed only).
CHUNKS, PARTS, PAIRS = 400_000, 300_000, 500_000
#: What lies before the first arc, and a character told as bytes; pieces have ids from 0.
NOTHING, BYTES = -1, -2
OUTPUTS = ("n_pieces", "n_byte_pieces", "ids_crc32", "round_trip")


class PieceTransducer:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.text = {i: model.id_to_piece(i) for i in plain}
        score = {self.text[i]: model.get_score(i) for i in plain}
        self.id = {p: i for i, p in self.text.items()}
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(BLANK in p.lstrip(BLANK) or (p.startswith(BLANK * 2) and p.strip(BLANK)) for p in self.id):
            raise ValueError("a piece reaches over a blank: words cannot be encoded alone")
        runs = {p for p in self.id if len(p) > 1 and not p.strip(BLANK)}
        if runs and (len({score[p] for p in runs}) > 1 or score[min(runs)] >= min([score[p] for p in self.id if len(p) > 1 and p not in runs], default=0)):
            raise ValueError("runs of blanks are not merged last and from the left")
        self.arcs: list[dict[str, int]] = [{}]  # of each state: what is read, the next state
        self.output = [NOTHING]
        for p, i in self.id.items():
            self.output[self._state(p)] = i
        self.arcs[0][""] = self._state(BLANK)
        #: neighbours inside pieces; all other pairs of characters are cuts
        self.inner = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        #: the order in which merges happen; single characters come first
        multi = sorted((p for p in self.id if len(p) > 1), key=lambda p: -score[p])
        self.rank = {p: 0 for p in self.id if len(p) == 1} | {p: r for r, p in enumerate(multi, 1)}
        self.halves: dict[str, tuple[str, str]] = {}
        self.raw = [b""] * n
        for i, p in self.text.items():
            self.raw[i] = p.replace(BLANK, " ").encode()
        for b, i in enumerate(self.byte):
            self.raw[i] = bytes((b,))
        self.is_byte = np.zeros(n, bool)
        self.is_byte[self.byte] = True
        self.chunks = Remembered(self._chunk, CHUNKS)
        self.parts = Remembered(self._part, PARTS)
        self.weights = Remembered(self._weight, PAIRS)

    def _state(self, piece: str) -> int:
        """The state after a piece was read, with new ones where there was none; ▁ is read as a blank too."""
        state = 0
        for c in piece:
            if c not in self.arcs[state]:
                self.arcs[state] |= dict.fromkeys((BLANK, " ") if c == BLANK else c, len(self.arcs))
                self.arcs.append({})
                self.output.append(NOTHING)
            state = self.arcs[state][c]
        return state

    def _halves(self, piece: str) -> tuple[str, str]:
        """The two pieces whose merge makes a piece when it is encoded alone."""
        if piece not in self.halves:
            parts = list(piece)
            while len(parts) > 2:
                at = min((i for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in self.rank), key=lambda i: (self.rank[parts[i] + parts[i + 1]], i))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[piece] = (parts[0], parts[1])
        return self.halves[piece]

    def _weight(self, pair: tuple[int, int]) -> float:
        """1, or infinity where the model would not keep the two pieces side by side.

        The merges that made the two are undone from the last to the first. If what then lies
        at the seam makes a piece that comes before the merge just undone, the model would have
        taken that piece instead. Runs of blanks are merged last and from the left: the left run
        is complete before the right one grows, blank by blank, and takes it as soon as both make
        a piece; of a run before a word only its last blank meets the word.
        """
        left, right, rank = self.text[pair[0]], self.text[pair[1]], self.rank
        if not left.strip(BLANK):
            if not right.strip(BLANK):
                grown = (right[:n] for n in range(1, len(right) + 1))
                return float("inf") if any(r in rank and left + r in rank for r in grown) else 1.0
            left = BLANK
        bound = len(rank) + 1
        while True:
            if rank.get(left + right, bound) < bound:
                return float("inf")
            if len(left) == 1 and len(right) == 1:
                return 1.0
            if len(right) == 1 or (len(left) > 1 and rank[left] > rank[right]):
                bound, left = rank[left], self._halves(left)[1]
            else:
                bound, right = rank[right] + 1, self._halves(right)[0]

    def shortest_path(self, text: str, begins: bool = False) -> list[tuple[int, str]]:
        """(id or BYTES, what was read) along the shortest path of the machine composed with a text.

        A state of the composition is a place and the piece that ends there; the weights leave one
        finite state a place, so its cost, its piece and where that began are three numbers.
        ``begins``: the text's first place comes after the normaliser's own ▁.
        """
        tape = ["", *text] if begins else text
        size, arcs, output, weights = len(tape), self.arcs, self.output, self.weights
        endless = size + 1
        cost, piece, start = array("q", [0]) + array("q", [endless]) * size, array("i", [NOTHING]) * (size + 1), array("q", [0]) * (size + 1)
        for at in range(size):
            here, last, state = cost[at], piece[at], 0
            if here == endless:
                continue
            for end in range(at, size):
                state = arcs[state].get(tape[end])
                if state is None:
                    break
                i = output[state]
                if i >= 0 and here + 1 < cost[end + 1] and (last < 0 or weights[last, i] == 1.0):
                    cost[end + 1], piece[end + 1], start[end + 1] = here + 1, i, at
            first = arcs[0].get(tape[at])
            if (first is None or output[first] < 0) and here + 1 < cost[at + 1]:
                cost[at + 1], piece[at + 1], start[at + 1] = here + 1, BYTES, at
        path, at = [], size
        while at:
            path.append((piece[at], "".join(tape[start[at] : at])))
            at = start[at]
        return path[::-1]

    def _part(self, part: str, begins: bool = False) -> bytes:
        ids = array("I")
        for i, read in self.shortest_path(part, begins):
            ids.extend([i] if i >= 0 else [self.byte[b] for b in read.encode("utf-8", "surrogatepass")])
        return ids.tobytes()

    def _chunk(self, chunk: str, begins: bool = False) -> bytes:
        plain, inner = chunk.replace(" ", BLANK), self.inner
        cuts = [i for i in range(1, len(plain)) if plain[i - 1 : i + 1] not in inner]
        first, *more = [chunk[a:b] for a, b in zip([0, *cuts], [*cuts, len(chunk)], strict=True)]
        return b"".join([self._part(first, True) if begins else self.parts[first], *[self.parts[p] for p in more]])

    def encode(self, text: str | None) -> bytes:
        """The ids as unsigned 32-bit integers."""
        if not text:
            return b""
        first, *rest = CHUNK.findall(text)
        return b"".join([self._chunk(first, True), *map(self.chunks.__getitem__, rest)])

    def decode(self, ids: bytes) -> str:
        whole = b"".join(map(self.raw.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")
        return whole[1:] if whole.startswith(" ") else whole


_loaded: dict[str, PieceTransducer] = {}


def transducer(path: str) -> PieceTransducer:
    if path not in _loaded:
        _loaded[path] = PieceTransducer(path)
    return _loaded[path]


def encode_pieces(df: DataFrame, model: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """``df`` without its text, with n_pieces, n_byte_pieces, ids_crc32, round_trip and, if asked for, ids."""
    rest = [c for c in fewer(df, *OUTPUTS, "ids").columns if c != text]
    kinds = [f for f in df.schema.fields if f.name in rest]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = transducer(model)
        for batch in batches:
            for part in slices(batch):
                rows: list[list] = [[] for _ in range(5)]
                for t in part.column(part.num_columns - 1).to_pylist():
                    raw = code.encode(t)
                    ids = np.frombuffer(raw, np.uint32)
                    lone = int(code.is_byte[ids].sum())
                    for to, x in zip(rows, (len(ids), lone, zlib.crc32(raw), code.decode(raw) == (t or "").replace(BLANK, " "), ids.tolist() if with_ids else None), strict=True):
                        to.append(x)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()))
                n = 5 if with_ids else 4
                columns = part.columns[:-1] + [pa.array(x, k) for x, k in zip(rows[:n], types[:n], strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[*rest, *OUTPUTS, "ids"][: len(columns)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), "n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean"]) + ", ids array<long>" * with_ids
    return df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`")).mapInArrow(encoded, schema)


def decode_pieces(df: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``df`` with the texts of its id lists."""

    @F.pandas_udf("string")
    def decoded(lists):
        code = transducer(model)
        return lists.map(lambda x: None if x is None else code.decode(array("I", list(x)).tobytes()))

    return fewer(df, text).select("*", decoded(F.col(f"`{ids}`")).alias(text))
