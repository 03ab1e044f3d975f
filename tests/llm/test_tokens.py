"""Token ids, token files, packing and byte-level BPE against the libraries themselves."""
import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewright.llm import byte_bpe, packing, token_files
from tracewright.llm.tokens import LibraryEncoder, TextEncoder, WordCache, arrow_slices, split_words

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "  a", "a ", "\n \n b", "<|endoftext|> x", "\x00a \x00b", "é's it's  'll", "a\u2028 b\xa0c", "漢字 🙂", "x" * 3000, "#" * 2500 + " y" * 700, "ab" * 900]


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(1)
    letters = "ab é'sß  \n\t.,!12#\x1c\x85\xa0漢🙂$<|\\\0ıſ "
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(1500)]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(VOCAB)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (None, "no id"), (5, "again"), (5, "again")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("own")).withColumn("length", F.lit(1)).repartition(3)


def test_words_are_joined_without_loss(odd_texts):
    assert all(" ".join(split_words(t)) == t for t in odd_texts)


@pytest.mark.parametrize("limit", [1_000_000, 50])
def test_cached_ids_are_those_of_the_library(odd_texts, library, limit):
    cache = WordCache(LibraryEncoder(VOCAB, "<u2"), limit)
    for a in range(0, len(odd_texts), 100):
        for text, ids in zip(odd_texts[a:a + 100], cache(odd_texts[a:a + 100])):
            assert np.frombuffer(ids, "<u2").tolist() == library(text), repr(text[:80])


MARKED = ["<|endoftext|>", "a <|endoftext|> x", "a  <|endoftext|><|endoftext|>  b", "<|endoftext", "x<|endoftext|>'s y", " <|endoftext|> ", "é<|endoftext|>é <|endoftext|"]


@pytest.mark.parametrize("as_loaded", [False, True])
@pytest.mark.parametrize("limit", [1_000_000, 50])
def test_gathered_ids_are_those_of_the_library(odd_texts, as_loaded, limit):
    t = Tokenizer.from_file(VOCAB)
    t.encode_special_tokens = not as_loaded
    encode, texts = TextEncoder(VOCAB, "<u2", as_loaded, limit), [*MARKED, *odd_texts, *MARKED]
    assert any(50256 in t.encode(x, add_special_tokens=False).ids for x in texts) == as_loaded
    for a in range(0, len(texts), 97):
        for text, ids in zip(texts[a:a + 97], encode(texts[a:a + 97]), strict=True):
            assert np.frombuffer(ids, "<u2").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text[:80])
    assert encode([]) == [] and len(encode.young) <= max(limit, 200)


def test_arrow_slices_cover_all_rows():
    import pyarrow as pa
    texts = pa.array(["", "x" * 10, "é" * 30, "", "a", "b" * 5, ""], pa.string())
    for size in (1, 7, 12, 1000):
        cuts = list(arrow_slices(texts.slice(1), size))
        assert [i for a, b in cuts for i in range(a, b)] == list(range(6))
    assert list(arrow_slices(texts.slice(0, 0))) == []


def test_queries_follow_the_library_on_added_tokens(spark, tmp_path):
    t = Tokenizer.from_file(VOCAB)
    docs = spark.createDataFrame(list(enumerate([*MARKED, None])), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    from tracewright.llm.queries import QUERIES
    want = {i: t.encode(x, add_special_tokens=False).ids for i, x in enumerate([*MARKED, ""])}
    files = {r.doc_id: r.ids_crc32 for r in QUERIES["op8_token_files"](spark, str(tmp_path)).collect()}
    packed = {r.doc_id: r.ids_crc32 for r in QUERIES["op7_best_fit_packing"](spark, str(tmp_path)).collect()}
    assert files == {i: zlib.crc32(np.array([*x, 0], "<u4").tobytes()) for i, x in want.items()}
    assert packed == {i: zlib.crc32(np.array([*x, 2], "<u4").tobytes()) for i, x in want.items()}


def test_token_files_hold_all_ids_in_order(spark, table, library, tmp_path):
    folder, manifest = token_files.write_tokens(table, VOCAB, 0, str(tmp_path / "tokens"))
    got = token_files.read_tokens(folder, manifest).orderBy("start").collect()
    rows = sorted(table.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for r, (doc_id, text) in zip(got, rows, strict=True):
        ids = np.array([*library(text or ""), 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (doc_id, start, len(ids), ids.tobytes())
        start += len(ids)
    tokens, offsets, _, _ = token_files.read_shard(folder, manifest.first()["shard"])
    assert isinstance(tokens, np.memmap) and offsets.dtype == np.int64 and tokens.dtype == np.dtype("<u2")


def test_token_files_of_nothing(spark, table, tmp_path):
    folder, manifest = token_files.write_tokens(table.limit(0), VOCAB, 0, str(tmp_path / "none"))
    assert token_files.read_tokens(folder, manifest).count() == 0


def test_cut():
    assert packing.cut(3, 4) == [(0, 3)] and packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)]


def naive_sum_of_squares(lengths, size):
    """Tries every place and counts the squares anew."""
    gaps, out = [], []

    def squares(g):
        return sum(g.count(x) ** 2 for x in set(g) if 0 < x < size)
    for s in lengths:
        options = sorted({g for g in gaps if g >= s} | {size})
        best = min(options, key=lambda g: (squares(gaps[:gaps.index(g)] + gaps[gaps.index(g) + 1:] + [g - s]) if g in gaps and g < size else squares(gaps + [size - s]), g))
        if best < size:
            gaps[gaps.index(best)] = best - s
        else:
            gaps.append(size - s)
        out.append(sorted(gaps))
    return out


def test_sum_of_squares_is_the_least_at_each_step():
    rng = random.Random(4)
    for _ in range(20):
        lengths = [rng.randrange(1, 11) for _ in range(30)]
        wanted = naive_sum_of_squares(lengths, 10)
        for k in range(1, len(lengths) + 1):
            assert sorted(packing.sum_of_squares(np.array(lengths[:k]), 10)[2].tolist()) == wanted[k - 1]


def packed_rightly(rows, size):
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values(), default=0) <= size
    return at


@pytest.mark.parametrize("group", [1000, 2])
def test_packing(spark, table, library, group):
    found = packing.pieces(table, VOCAB, 2, size=64, with_ids=True)
    packed = packing.pack(found.drop("ids"), 64, group).collect()
    packed_rightly(packed, 64)
    wanted = {}
    for doc_id, text in table.select("doc_id", "text").collect():
        ids = np.array([*library(text or ""), 2], "<u4")
        for i, (s, n) in enumerate(packing.cut(len(ids), 64)):
            wanted.setdefault((doc_id, i, s, n, zlib.crc32(ids[s:s + n].tobytes())), []).append(1)
    got = {}
    for r in packed:
        got.setdefault((r.doc_id, r.piece, r.start, r.length, r.ids_crc32), []).append(1)
    assert got == wanted


def test_packed_sequences_hold_the_ids(spark, table):
    docs = table.filter("doc_id != 5")
    found = packing.pieces(docs, VOCAB, 2, size=64, with_ids=True)
    packed = packing.pack(found.drop("ids"), 64)
    parts = {(r.doc_id, r.piece): bytes(r.ids) for r in found.collect()}
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed, found).collect()}
    for r in packed.collect():
        assert whole[r.sequence_id][4 * r.offset:4 * (r.offset + r.length)] == parts[r.doc_id, r.piece]


def test_packing_of_nothing(spark, table):
    assert packing.pack(packing.pieces(table.limit(0), VOCAB)).count() == 0


def test_bpe_merges_like_the_library(odd_texts):
    bpe = byte_bpe.ByteBpe.of(RANKS, public_tokenizers.PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text, ids in zip(odd_texts, bpe.cache(odd_texts)):
        ids = np.frombuffer(ids, bpe.dtype)
        assert ids.tolist() == library.encode_ordinary(text), repr(text[:80])
        assert bpe.decode(ids.astype(int)).tobytes() == text.encode()


def test_rounds_and_walk_agree():
    bpe = byte_bpe.ByteBpe.of(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(2)
    pieces = ["".join(rng.choice("abeit nr") for _ in range(rng.randrange(2, 300))).encode() for _ in range(60)]
    assert [np.frombuffer(x, bpe.dtype).tolist() for x in bpe.rounds(pieces)] == [bpe.walk(p).tolist() for p in pieces]


def test_bpe_round_trip_of_a_table(spark, table):
    docs = table.withColumnRenamed("ids", "own")
    vocab = RANKS, public_tokenizers.PATTERN
    out = byte_bpe.decode(byte_bpe.encode(docs, *vocab), *vocab).collect()
    assert len(out) == docs.count() and {r.own for r in out} == {"own"}
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in out)
    assert byte_bpe.encode(docs.limit(0), *vocab).count() == 0
    with pytest.raises(ValueError, match="already has a column"):
        byte_bpe.encode(table, *vocab)


def test_unknown_ids_decode_to_nothing(spark):
    rows = spark.createDataFrame([([0, -4, 10**7],), (None,), ([],)], "ids array<int>")
    out = [bytes(r.decoded) for r in byte_bpe.decode(rows, RANKS, public_tokenizers.PATTERN).collect()]
    assert [len(x) for x in out] == [1, 0, 0]


def test_queries_over_the_smallest_tables(spark, library):
    from tracewright.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op3_byte_bpe"](spark, sf).collect():
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    got = {r.doc_id: r for r in QUERIES["op8_token_files"](spark, sf).collect()}
    start = 0
    for k in sorted(docs):
        ids = np.array([*library(docs[k]), 0], "<u4")
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    at = packed_rightly(QUERIES["op7_best_fit_packing"](spark, sf).collect(), 1024)
    assert len(at) <= 1.05 * -(-sum(at.values()) // 1024)
