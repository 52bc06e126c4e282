"""Operators 2 and 4: exact round trips, and queries against a brute force by row."""

import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ddlspark.llm import packing, range_coder, registry, token_files, tokens
from ddlspark.llm.tokens import ByteLevelIds, WordIds, ids_of

from .corpus import frame, rows

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXT = st.text(st.sampled_from("aZé ß  \n\t\r'.,|<0１日é　\x85ªx"), max_size=40)


@pytest.mark.parametrize(("kind", "path"), [(ByteLevelIds, BYTE), (WordIds, WORD)])
def test_memo_equals_the_tokenizer(kind, path):
    whole, memo = Tokenizer.from_file(path), ids_of(kind, path)

    @settings(max_examples=300, deadline=None)
    @given(TEXT)
    def same(text):
        assert memo.encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    same()
    for text in ["it's a<|endoftext|> b", "Ab.\nC 12,3. | x | y |\nZ%%% é.", "a\n \nb", " a  b ", "idiot's <|ENDOFTEXT|>"]:
        assert memo.encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class Counted:
    def __init__(self, model):
        self.model, self.calls = model, 0

    def tokenize(self, word):
        self.calls += 1
        return self.model.tokenize(word)


def test_many_new_words_leave_most_others_known():
    """450,000 new words do not drive out all of a thousand earlier ones, as they did from two halves of 200,000."""
    memo = ByteLevelIds(BYTE)
    letters = np.array(list("abcdefghijklmnopqrst"))
    words = ["".join(w) for w in letters[np.stack([np.arange(451_000) // 20**k % 20 for k in range(5)], axis=1)]]
    early = " ".join(words[:1000])
    want = memo.encode(early)
    list(memo.encoded([" ".join(words[k : k + 50_000]) for k in range(1000, 451_000, 50_000)]))
    memo.model = Counted(memo.model)
    assert memo.encode(early) == want and 0 < memo.model.calls < 600
    again = memo.model.calls
    assert memo.encode(early) == want and memo.model.calls - again < again / 10


@pytest.mark.parametrize("kind", [ByteLevelIds, WordIds])
def test_parts_that_share_a_row_keep_their_own_ids(kind, monkeypatch):
    monkeypatch.setattr(tokens, "ROW_BITS", 2)
    path = BYTE if kind is ByteLevelIds else WORD
    whole, memo = Tokenizer.from_file(path), kind(path)
    texts = ["ab", "abc ab a\0", "a\0\0 a\0", "the cat sat on the mat", "x" * 24 + " " + "x" * 25 + " " + "qzx" * 7, "Straße é è, 12 ... 345", "", "the the cat"]
    for _ in range(2):
        got = list(memo.encoded(texts))
        assert got == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_carries_run_through_written_words():
    """A carry into a word of all ones goes on to the word before it."""
    out = range_coder.Writer(2, 8)
    out.words[:3, 0], out.at[0], out.low[0], out.size[0] = [5, 2**32 - 1, 2**32 - 1], 3, 2**64 - 2**20, 2**40
    out.narrow(np.array([0]), np.uint64(16), np.array([2**15], np.uint64), np.array([2**15], np.uint64))
    words, sizes = out.done()
    assert words[:3].tolist() == [6, 0, 0] and sizes[0] == 4


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 30), st.integers(0, 50_256), st.integers(0, 2**18 - 1)), max_size=3000))
def test_units_round_trip(ids):
    assert range_coder.decode_unit(range_coder.encode_unit(np.array(ids, np.int64))).tolist() == ids


def test_large_units_round_trip():
    rng = np.random.default_rng(3)
    for ids in (np.zeros(600_000, np.int64), rng.zipf(1.3, 300_001) % 70_000, np.arange(200_000) % 7 + 100_000):
        assert (range_coder.decode_unit(range_coder.encode_unit(ids)) == ids).all()
    with pytest.raises(ValueError, match="ids"):
        range_coder.encode_unit(np.array([1 << 18]))


def test_coder_learns():
    ids = np.tile(np.array([7, 9, 40_000, 3, 9, 2]), 400)
    assert len(range_coder.encode_unit(ids)) < len(ids) * 0.4


def test_fewer_bits_than_zlib():
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY doc_id").fetchall()]
    encode = ids_of(ByteLevelIds, BYTE).encode
    ids = np.frombuffer(b"".join(encode(t or "") + bytes(4) for t in texts), "<u4").astype(np.int64)
    coded = len(range_coder.encode_unit(ids))
    assert coded < 0.9 * len(zlib.compress(ids.astype("<u2").tobytes(), 9))
    share = np.bincount(ids) / len(ids)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    assert 8 * coded < entropy * len(ids)


def test_damage_is_found():
    segment = bytearray(token_files.pack([1, None], np.array([3, 2]), np.array([5, 6, 0, 9, 0])))
    ids, counts, tokens = token_files.unpack(bytes(segment))
    assert ids == [1, None] and counts.tolist() == [3, 2] and tokens.tolist() == [5, 6, 0, 9, 0]
    segment[-6] ^= 255
    with pytest.raises(ValueError, match="checksum"):
        token_files.unpack(bytes(segment))
    with pytest.raises(ValueError, match="segment"):
        token_files.unpack(b"nothing")


def test_files(spark):
    path = token_files.new_path(spark)
    token_files.write(frame(spark), path, BYTE)
    got = token_files.read(spark, path, with_ids=True).orderBy("start").collect()
    whole = Tokenizer.from_file(BYTE)
    want = sorted((i is not None, i or 0, np.array(whole.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for i, t in rows())
    assert sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.ids)) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        at += r.n_tokens
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(i for i, _ in rows() if i is not None)


def test_packing(spark):
    got = packing.pack_documents(frame(spark), WORD, capacity=256, with_ids=True).collect()
    whole = Tokenizer.from_file(WORD)
    want = sum(len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows())
    assert sum(r.length for r in got) == want
    bins = {}
    for r in got:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= 1.1 * want / 256 + 1


def test_packing_query_by_row(spark):
    """The registered query: pieces, starts, lengths and checksums by row, and as few sequences as best-fit-decreasing needs."""
    got = registry.queries()["op4_best_fit_packing"](spark, "/root/testdata/sf0.001").collect()
    whole = Tokenizer.from_file(WORD)
    want = set()
    for i, t in duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall():
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want |= {(i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())) for k in range(0, len(ids), 4096)}
    assert len(got) == len(want) and {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want
    rooms = []
    for n in sorted((x[3] for x in want), reverse=True):
        fit = [k for k, room in enumerate(rooms) if room >= n]
        if fit:
            rooms[min(fit, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(4096 - n)
    assert len({r.sequence_id for r in got}) <= len(rooms)


def test_token_query_by_row(spark):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in registry.queries()["op2_token_ids"](spark, "/root/testdata/sf0.001").collect()}
    whole, at = Tokenizer.from_file(BYTE), 0
    for i, t in duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY doc_id").fetchall():
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert got.pop(i) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert not got


def test_repeated_ids_spread_over_groups(spark):
    items = spark.range(3 * packing.GROUP_PIECES).select(F.lit(7).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (F.col("id") % 99 + 1).alias("length"), F.lit(1).cast("long").alias("ids_crc32"))
    sequences = packing.best_two_fit(items).select((F.col("sequence_id").bitwiseAND(0) + F.shiftright("sequence_id", 32)).alias("g")).groupBy("g").count().collect()
    assert len(sequences) == 3


def test_two_fit_replaces_the_smallest():
    sequences = packing.two_fit(np.array([60, 30, 22, 17]), 100)
    assert sorted(map(sorted, sequences)) == [[0, 2, 3], [1]]


def test_empty_tables(spark):
    path = token_files.new_path(spark)
    token_files.write(frame(spark, []), path, BYTE)
    assert token_files.read(spark, path).count() == 0
    assert packing.pack_documents(frame(spark, []), WORD).count() == 0
