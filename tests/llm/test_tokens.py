"""Pieces, token files and shards."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from seriesmill.llm.pieces import Decoder, Encoder, decode_pieces, encode_pieces, merged, read_model, round_trip
from seriesmill.llm.sharding import histogram_shards
from seriesmill.llm.token_files import IdFile, WordEncoder, id_checksums, pack_ids, write_ids

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
PIECES = read_model(MODEL)
ENCODER, DECODER = Encoder(PIECES), Decoder(PIECES)
TOKENIZER = tokenizers.Tokenizer.from_file(WORDS)

PARTS = ["the", "in", "er", " ", "  ", "ing", "!!", "***", "\n", "\t", "Thanks", "    ", "::", "é", "日本", "▁", "😀", "<s>",
         " ", "1234", "==", "\x00"]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(PARTS), max_size=20).map("".join)))
def test_pieces_of_any_text(text):
    ids = [1, *LIBRARY.encode(text), 2]
    encoded = ENCODER.encode(text)
    assert np.frombuffer(encoded, "<u4").tolist() == ids
    assert DECODER.decode(encoded) == LIBRARY.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31999)), max_size=15))
def test_any_ids_decode_as_the_library_decodes(ids):
    assert DECODER.decode(np.array(ids, "<u4").tobytes()) == LIBRARY.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(sorted(PIECES.whole)), min_size=2, max_size=2))
def test_pair_test_is_merging_the_pair(pair):
    assert ENCODER.fits(*pair) == (merged("".join(pair), PIECES.scores) == pair)


def test_pieces_of_tables(odd_docs, no_docs, tables):
    for docs in (odd_docs, tables("documents"), no_docs):
        got = decode_pieces(encode_pieces(docs, MODEL), MODEL).collect()
        expected = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert len(got) == len(expected)
        ours = sorted((str(r["doc_id"]), bytes(r["ids"]), r["decoded"]) for r in got)
        theirs = []
        for i, t in expected:
            ids = [1, *LIBRARY.encode(t or ""), 2]
            theirs.append((str(i), np.array(ids, "<u4").tobytes(), LIBRARY.decode(ids)))
        assert ours == sorted(theirs)
        both = round_trip(docs, MODEL).collect()
        assert sorted((str(r["doc_id"]), bytes(r["ids"]), r["decoded"]) for r in both) == ours


def test_other_models_are_refused(tmp_path):
    path = tmp_path / "unigram.model"
    path.write_bytes(b"\x12\x02\x18\x01")
    with pytest.raises(ValueError):
        read_model(str(path))


@pytest.mark.parametrize("high", [1, 256, 70_000, 1 << 31])
def test_directly_addressable(high):
    rng = np.random.default_rng(high)
    ids = rng.integers(0, high, 3000).astype("<u4")
    ids[::3] %= 200
    ends = np.array([0, 5, 5, 1024, 3000])
    file = IdFile(pack_ids(ids, ends))
    assert [file[k] for k in range(3000)] == ids.tolist()
    assert [len(file.document(k)) for k in range(5)] == [0, 5, 0, 1019, 1976]
    for a, b in ((0, 3000), (511, 513), (17, 18), (2048, 3000), (9, 9)):
        assert file.span(a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(IndexError):
        file[3000]
    assert IdFile(pack_ids(ids[:0], np.array([0]))).document(0).tolist() == []


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(
    [*PARTS, "'s", "'RE", "Σς", "É", "é", "\x1c", "\x85", "<|endoftext|>", " "]), max_size=20).map("".join)))
def test_words_of_any_text(text):
    encoder = WordEncoder(TOKENIZER.to_str())
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_id_files(spark, odd_docs, no_docs, tables, tmp_path):
    for k, docs in enumerate((odd_docs, tables("documents"), no_docs)):
        path = str(tmp_path / f"ids{k}")
        write_ids(docs, path, WORDS, end_id=2, file_ids=5000)
        got = sorted(map(tuple, id_checksums(spark, path).collect()), key=lambda r: r[1])
        expected = []
        for r in docs.collect():
            ids = np.array([*TOKENIZER.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
            expected.append((r["doc_id"], len(ids), zlib.crc32(ids.tobytes())))
        assert sorted(((i, n, c) for i, _, n, c in got), key=str) == sorted(expected, key=str)
        keys = [i for i, *_ in got]
        assert [i for i in keys if i is not None] == sorted(i for i in keys if i is not None)
        assert all(i is None for i in keys[:keys.count(None)])
        starts = np.cumsum([0, *(n for _, _, n, _ in got)])
        assert [s for _, s, _, _ in got] == starts[:-1].tolist()


def law_holds(docs, shards, tolerance=1e-4):
    rows = histogram_shards(docs, shards, tolerance=tolerance).collect()
    source = docs.collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=str) == sorted(
        ((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in source), key=str)
    assert {(r["law"], r["grown_shard"]) for r in rows} <= {("bytes", None)}
    sizes = [0] * shards
    slots = [[] for _ in range(shards)]
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    largest = max((r["size"] for r in rows), default=0)
    return rows, sizes, largest


def test_shards_of_documents(tables):
    docs = tables("documents")
    _, sizes, largest = law_holds(docs, 24)
    assert max(sizes) - min(sizes) <= 2 * largest
    rows, sizes, largest = law_holds(docs, 3)
    assert max(sizes) - min(sizes) <= 2 * largest
    # equal texts are neighbours: a group lies in one shard or in a row of them
    where = {}
    for r in rows:
        where.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert sum(len(s) > 1 for s in where.values()) <= 2


def test_a_group_larger_than_a_shard_is_cut(spark):
    rng = random.Random(1)
    texts = ["copy " * 10] * 900 + [f"text {rng.random()}" for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, sizes, largest = law_holds(docs, 8)
    assert max(sizes) - min(sizes) <= 2 * largest


def test_odd_shards(odd_docs, no_docs, spark):
    law_holds(odd_docs, 4)
    law_holds(no_docs, 4)
    law_holds(spark.createDataFrame([(1, "x")], "doc_id long, text string"), 24)


def test_other_vocabularies_are_encoded_whole():
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    from seriesmill.llm.token_files import WordEncoder

    texts = ["It's  a test, isn't it?\tYes: 10.5%...", "Ärger, ÉTÉ naïve ß ﬁ", "<|endoftext|>Mixed CASE<x>", None, "a\x1cb", "日本語 x"]
    spec = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    changed = json.loads(spec)
    changed["normalizer"]["normalizers"] = [n for n in changed["normalizer"]["normalizers"] if n["type"] != "Lowercase"]
    specs = [spec, open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read(), json.dumps(changed)]
    assert [WordEncoder(s).by_parts for s in specs] == [True, False, False]
    for s in specs:
        library = Tokenizer.from_str(s)
        for ids, text in zip(WordEncoder(s).encode_all(texts), texts, strict=True):
            want = library.encode(text, add_special_tokens=False).ids if text else []
            assert np.frombuffer(ids, "<u4").tolist() == want
