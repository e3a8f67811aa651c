import collections
import itertools
import math
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from netlens.llm.packing import best_fit, best_fit_packing, cuts, local_search, token_pieces, pack
from netlens.llm.piece_transducer import PieceTransducer, decode_pieces, encode_pieces
from netlens.llm.token_files import Segment, packed_segment, read_dictionary, read_token_files, write_token_files
from netlens.llm.tokens import Remembered, WordEncoder

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
ALPHABET = ["a", "B", "é", "  ", " ", "\n", "\t", " \n", "\x1c", "\x85", "\u180e", " ", " ", "1", "23", "'s", "'", "###", "日本", "é", "e\u0301", "\u0301", "<|endoftext|>", " <|endoftext|>", "<|startoftext|>", "<|endoftext", "|>", "ΑΣ", "\u200b", "İ", "\ufeff", "\r\n", "x_y", "🙂", "the", "word,", "aaa", "▁", "<0x0A>", "    "]


def texts(n=1500, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 25))) for _ in range(n)]


def ids_of(name, values, end):
    t = tokenizers.Tokenizer.from_file(P.path(name))
    return [[*e.ids, end] for e in t.encode_batch(values, add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name,keeps", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_word_encoder_equals_the_library(name, keeps):
    own = WordEncoder(P.path(name), keeps).encode(texts())
    assert own == [np.array(x[:-1], "<u4").tobytes() for x in ids_of(name, texts(), 0)]


@pytest.mark.parametrize("name,keeps", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_special_tokens(name, keeps):
    values = ["x <|endoftext|> y", "<|endoftext|>", "<|endoftext|><|endoftext|>", "a<|startoftext|>b <|endoftext|>", "<|<|endoftext|>|>", "E\u0301<|endoftext|>\u0301"]
    library = tokenizers.Tokenizer.from_file(P.path(name))
    own = WordEncoder(P.path(name), keeps)
    assert [list(memoryview(x).cast("I")) for x in own.encode(values)] == [library.encode(v, add_special_tokens=False).ids for v in values]
    library.encode_special_tokens = True
    plain = WordEncoder(P.path(name), keeps, specials_as_text=True)
    assert [list(memoryview(x).cast("I")) for x in plain.encode(values)] == [library.encode(v, add_special_tokens=False).ids for v in values]


def test_memories_are_bounded():
    own = WordEncoder(P.path("byte_bpe_50k.json"), True)
    own.later.most = own.pre_tokens.most = 100
    r = random.Random(4)
    values = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.choice((3, 7, 200)))) for _ in range(60)) for _ in range(60)]
    assert own.encode(values) == [np.array(x[:-1], "<u4").tobytes() for x in ids_of("byte_bpe_50k.json", values, 0)]
    assert len(own.later) <= 100 and len(own.later.before) <= 100 and len(own.pre_tokens) <= 100 and max(map(len, own.later)) <= 64


class Asked(Remembered):
    times = 0

    def __getitem__(self, key):
        self.times += 1
        return super().__getitem__(key)


def test_a_word_is_looked_up_once_for_all_texts_and_lines_are_cut():
    own = WordEncoder(P.path("byte_bpe_50k.json"), True)
    own.later = Asked(own.later.make, own.later.most)
    words = [a + b for a in "abcdefgh" for b in ("one", "two", "trois", "été")]
    values = [f"The {x}.\nThen {y}, {x}" for x in words for y in words]
    assert own.encode(values) == [np.array(x[:-1], "<u4").tobytes() for x in ids_of("byte_bpe_50k.json", values, 0)]
    assert own.later.times < 10 * len(words) and len(own.later) < 5 * len(words)


def test_blanks_and_line_ends_in_columns_equal_the_library():
    bits = ["a", "The", "é", "日本", "x,", "12", "'s", "$$", "\n", "\n", "\n\n", " ", " ", " \n", "\n ", "\r\n", "\t", "\u3000", "\x1c", "\u200b", "<|endoftext|>"]
    r = random.Random(9)
    values = ["", None, "\n", " ", "\na", "a\n", "\nb c", "a \nb", "a\n\nb \nc", "x" * 100 + "\ny z"] + ["".join(r.choices(bits, k=r.randint(1, 9))) for _ in range(6000)]
    for most in (len(values), 7, 1):
        own = WordEncoder(P.path("byte_bpe_50k.json"), True)
        got = [x for i in range(0, len(values), most) for x in own.encode(values[i : i + most])]
        assert got == [np.array(x[:-1], "<u4").tobytes() for x in ids_of("byte_bpe_50k.json", [v or "" for v in values], 0)]
    assert own.encode([]) == []


def test_token_files_round_trip(spark, tmp_path):
    values = texts(400) + ["long text " * 3000, "", "same", "same"]
    rows = [(i * 7 % 4001 - 50, t, i) for i, t in enumerate(values)]
    rows += [(None, None, 0), (rows[5][0], "again", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    path = f"file://{tmp_path}/t"
    write_token_files(df, path, P.path("word_bpe_49k.json"), end_id=2, segment_bytes=4000)
    out = read_token_files(spark, path, with_ids=True).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    expected, at = [], 0
    for (k, _, _), ids in zip(order, ids_of("word_bpe_49k.json", [r[1] or "" for r in order], 2), strict=True):
        expected.append((k, at, len(ids), crc(ids)))
        at += len(ids)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in out), key=lambda r: r[1])
    assert got == expected
    assert all(crc(r.ids) == r.ids_crc32 for r in out)


def test_one_document_is_read_through_the_index(spark, tmp_path):
    df = spark.createDataFrame([(i, f"document number {i} " * 30) for i in range(300)], "doc_id long, text string")
    path = f"file://{tmp_path}/t"
    write_token_files(df, path, P.path("word_bpe_49k.json"), end_id=2)
    raw = read_dictionary(spark, path)
    row = spark.read.parquet(f"{path}/segments").where("first_key <= 77 and last_key >= 77").first()
    seg = Segment(bytes(row.data), raw)
    (at,) = seg.find(77)
    assert seg.ids(at) == np.array(ids_of("word_bpe_49k.json", ["document number 77 " * 30], 2)[0], "<u4").tobytes()
    with pytest.raises(ValueError):
        Segment(packed_segment([1], [1], [b""], 5), raw)


def test_token_files_of_an_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    write_token_files(spark.createDataFrame([], "doc_id long, text string"), path, P.path("word_bpe_49k.json"), end_id=2)
    assert read_token_files(spark, path).count() == 0


def test_cuts():
    assert cuts(5, 4) == [(0, 1), (1, 4)] and cuts(4, 4) == [(0, 4)] and cuts(3, 4) == [(0, 3)] and cuts(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_local_search_only_helps():
    r = random.Random(3)
    for _ in range(60):
        lengths = [r.randint(1, 60) for _ in range(r.randint(1, 60))]
        bins = best_fit(lengths, 100)
        better = local_search([list(b) for b in bins], lengths, 100)
        assert sorted(p for b in better for p in b) == list(range(len(lengths)))
        assert all(sum(lengths[p] for p in b) <= 100 for b in better)
        assert -(-sum(lengths) // 100) <= len(better) <= len(bins)


def test_local_search_empties_a_bin():
    lengths = [60, 30, 50, 40, 10, 10]
    bins = [[0, 1], [2, 3], [4, 5]]
    assert len(local_search(bins, lengths, 100)) == 2


@pytest.mark.parametrize("length", [3, 13, 700])
def test_equal_pieces_are_searched_at_once(length):
    lengths = [length] * 8192
    bins = best_fit(lengths, 2048)
    began = time.process_time()
    better = local_search([list(b) for b in bins], lengths, 2048)
    assert time.process_time() - began < 2
    assert len(better) == -(-8192 // (2048 // length)) and sorted(p for b in better for p in b) == list(range(8192))


def test_repeated_rows_and_null_ids_are_dealt_over_groups(spark):
    rows = spark.range(4000).selectExpr("cast(null as long) doc_id", "0 piece", "cast(0 as long) start", "cast(9 as long) length", "cast(7 as long) ids_crc32").withColumn("piece", F.col("piece").cast("int"))
    out = pack(rows, 100, group_rows=500)
    assert placed(out.collect(), 100) <= 4000 // 11 + 10
    assert out.groupBy((F.col("sequence_id") / (1 << 24)).cast("long")).count().agg(F.max("count")).first()[0] < 700


def placed(rows, most):
    seq = collections.defaultdict(list)
    for r in rows:
        seq[r.sequence_id].append((r.offset, r.length))
    for parts in seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= most
    return len(seq)


@pytest.mark.parametrize("group_rows", [8192, 60])
def test_packing(spark, group_rows):
    values = texts(500) + ["long text " * 900, "", None]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(values)] + [(3, values[3], "x"), (None, "no id", "x")], "doc_id long, text string, piece string")
    pieces = token_pieces(df, P.path("byte_bpe_50k.json"), 0, 64)
    rows = pack(pieces, 64, group_rows=group_rows).collect()
    got = collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    expected = collections.Counter()
    for (k, _, _), ids in zip(df.collect(), ids_of("byte_bpe_50k.json", [r.text or "" for r in df.collect()], 0), strict=True):
        for no, (s, n) in enumerate(cuts(len(ids), 64)):
            expected[k, no, s, n, crc(ids[s : s + n])] += 1
    assert got == expected
    assert placed(rows, 64) <= math.ceil(sum(r.length for r in rows) / 64) * 1.01 + 2


def test_packing_of_an_empty_table(spark):
    assert best_fit_packing(spark.createDataFrame([], "doc_id long, text string"), P.path("byte_bpe_50k.json")).count() == 0


def test_transducer_equals_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = P.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), PieceTransducer(path)
    values = texts(1200, 2)
    assert [list(memoryview(own.encode(t)).cast("I")) for t in values] == library.encode(values)
    assert [own.decode(own.encode(t)) for t in values] == library.decode(library.encode(values))
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(values[:200])] + [(900, None, 1)], "doc_id long, text string, n_pieces int")
    out = encode_pieces(df, path, with_ids=True)
    assert out.where("not round_trip").count() == 0 and out.count() == 201
    back = {r.doc_id: r.text for r in decode_pieces(out, path).collect()}
    assert all(back[i] == t.replace("▁", " ") for i, t in enumerate(values[:200])) and back[900] == ""
    assert encode_pieces(df.limit(0), path).count() == 0


def test_long_runs_of_blanks_in_linear_time():
    sentencepiece = pytest.importorskip("sentencepiece")
    path = P.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), PieceTransducer(path)
    values = ["a" + " " * n + "b" for n in (1, 2, 3, 15, 16, 17, 31, 300, 1000)] + [" " * 100_000, " " * 5000 + "end"]
    began = time.process_time()
    got = [list(memoryview(own.encode(t)).cast("I")) for t in values]
    assert time.process_time() - began < 3
    assert got == library.encode(values)


def test_normaliser_runs_and_bytes_are_arcs_of_one_machine():
    sentencepiece = pytest.importorskip("sentencepiece")
    path = P.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), PieceTransducer(path)
    for before, after in itertools.product(("", "the", "日"), ("", "the", "▁", "￿")):
        values = [before + " " * n + after for n in range(70)]
        assert [list(memoryview(own.encode(t)).cast("I")) for t in values] == library.encode(values)
    r = random.Random(4)
    bits = ["the", "and", " ", "  ", "▁", "\n", "ab", "1", "é", "日本", "🙂", "\u200b", "ing", "'s", "<s>", "<0x41>", "a" * 40]
    values = ["".join(r.choices(bits, k=r.randint(0, 25))) for _ in range(3000)]
    assert [list(memoryview(own.encode(t)).cast("I")) for t in values] == library.encode(values)
    assert all("".join(read for _, read in own.shortest_path(t, begins=True)) == t for t in values)


def test_a_dictionary_of_the_beginnings_reads_whole_texts(spark, tmp_path):
    """Long texts reach the driver cut; the files hold them whole."""
    rows = [(i, f"document {i} " * 400) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path, vocabulary = f"file://{tmp_path}/t", P.path("word_bpe_49k.json")
    write_token_files(df, path, vocabulary, end_id=2, sample_chars=300)
    assert len(read_dictionary(spark, path)) < 40 * 300
    got = {r.doc_id: r.ids for r in read_token_files(spark, path, with_ids=True).collect()}
    own = tokenizers.Tokenizer.from_file(vocabulary)
    assert got == {i: [*own.encode(t, add_special_tokens=False).ids, 2] for i, t in rows}
