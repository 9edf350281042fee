"""Token ids equal the library's, the file format is an exact round trip."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from gatecast.llm import boundary_bpe as B
from gatecast.llm import fragments as G
from gatecast.llm import token_files as T

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")

BITS = [
    "a", "b", "A", "K", ".", " .", ".,", "Is", "'S", " ", "  ", "\n", "\t", "'s", "'", "!", "'re", "é", "É", "ß", "0", "12", " ", "　",
    "<|endoftext|>", "<|", "<|STARTOFTEXT|>", "|>", "漢字", "😀", "́", "ing", " the", "-", "_", "\x1c", "\x85", " ", "ll", "\r\n", "Σ", "İ", "K",
]


def texts(count):
    random.seed(3)
    return ["".join(random.choice(BITS) for _ in range(random.randint(0, 30))) for _ in range(count)]


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_fragments_join_to_the_text_and_ids_equal_the_library():
    model, cut = library(BYTE), B.forced(BYTE)
    for text in texts(4000):
        raw = text.encode()
        assert b"".join(B.fragments(raw, cut)) == raw
        want = model.encode(text, add_special_tokens=False).ids
        got = B.encode(text, BYTE)
        assert got.tolist() == want
        assert B.decode(got, BYTE) == model.decode(want, skip_special_tokens=False)


def test_ids_that_are_no_text_decode_like_the_library():
    model = library(BYTE)
    random.seed(5)
    for _ in range(300):
        ids = [random.randrange(50257) for _ in range(20)]
        assert B.decode(np.array(ids), BYTE) == model.decode(ids, skip_special_tokens=False)


def test_no_cut_pair_occurs_in_a_token():
    cut = B.forced(BYTE)
    assert cut[ord("e"), ord(" ")] and not cut[ord(" "), ord("t")] and not cut[ord("t"), ord("h")]
    for token in B.token_bytes(BYTE):
        assert not any(cut[a, b] for a, b in zip(token, token[1:]))


def test_word_ids_equal_the_library():
    model = library(WORD)
    for text in texts(4000):
        assert T.token_ids(text, WORD, 1).tolist() == [*model.encode(text, add_special_tokens=False).ids, 1]


def test_a_full_table_changes_nothing(monkeypatch):
    monkeypatch.setattr(G, "MOST_KNOWN", 20)
    known = G.Known(WORD)
    model = library(WORD)
    for text in texts(400):
        want = np.array(model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert known.encode(T.word_fragments(text.encode())) == want
    assert len(known) < 100


def test_pack_and_unpack_round_trip():
    random.seed(8)
    for _ in range(200):
        ids = np.array([random.getrandbits(random.choice([1, 1, 1, 3, 8, 16, 20, 21, 40, 60])) for _ in range(random.randint(0, 300))], np.uint64)
        assert (T.unpack(T.pack(ids), len(ids)) == ids).all()
    assert len(T.pack(np.zeros(120, np.uint64))) == 2  # sixty one-bit ids in a word
    with pytest.raises(ValueError):
        T.pack(np.array([1 << 60], np.uint64))


def test_shards_hold_documents_across_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 7)
    documents = [(1, np.arange(20, dtype="<u4")), (None, np.empty(0, "<u4")), (-3, np.array([2**19, 5], "<u4")), (4, np.arange(7, dtype="<u4"))]
    for place in (str(tmp_path / "a" / "x.s8b"), f"file://{tmp_path}/b/x.s8b", f"file:{tmp_path}/c/x.s8b"):
        assert T.write_shard(place, iter(documents)) == (4, 29)
        got = [(i, [int(v) for piece in pieces for v in piece]) for i, pieces, _ in T.read_shard(place)]
        assert got == [(i, ids.tolist()) for i, ids in documents]


def test_token_files_of_documents(spark):
    rows = [(k, t) for k, t in enumerate(texts(150))] + [(7, "again"), (7, None), (None, "no id"), (None, "a"), (500, "long " * 30_000)]
    random.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 1, "p") for i, t in rows], "doc_id long, text string, id int, path string").repartition(4)
    got = [tuple(r) for r in T.read_token_files(T.write_token_files(docs, WORD, 1)).collect()]
    model, start, want = library(WORD), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    empty = T.read_token_files(T.write_token_files(docs.where("doc_id < 0"), WORD, 1))
    assert empty.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and empty.count() == 0


def test_round_trip_of_documents(spark):
    rows = [(1, None), (2, ""), (None, "the the"), (3, "é" * 5000), (3, "é" * 5000), (4, "<|endoftext|>")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in docs.select("doc_id", B.round_trip(docs["text"], BYTE).alias("r")).select("doc_id", "r.*").collect()), key=str)
    model, want = library(BYTE), []
    for i, t in rows:
        ids = model.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert [r[0] for r in docs.where("doc_id = 4").select(B.encoded(docs["text"], BYTE)).collect()] == [[50256]]
    assert docs.where("doc_id < 0").select(B.round_trip(docs["text"], BYTE)).count() == 0
