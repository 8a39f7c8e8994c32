import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trackloom.llm import queries, token_store
from trackloom.llm.common import new_path
from trackloom.llm.tokenizer import Encoder
from trackloom.llm.token_store import PerfectHash

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = ["a  b\n\n c", "\n a", " a ", "a \n b", "\ta\tb  ", "don't  stop\n'll", "　x  y", "é é İΣ ς ΑΣ", "<|endoftext|> hi<|endoftext|>",
       "a\x1c b\x85c", "x" * 200 + " y", "\x00 a\x00", "\r\na\r\n b", "12 3456 7,8", " ", "\n", "", "a\n", "\nb", "  ", "ß ÿ ÷ × Ÿ", "So... well?! 1.2,3"]


def library(path):
    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


def test_chunks_encode_like_whole_texts(texts):
    for path in (WORD, BYTE):
        whole, encoder = library(path), Encoder(path)
        assert encoder.short
        for text in [*ODD, *list(texts.values())[:100]]:
            assert np.frombuffer(encoder.encode_one(text), "<u4").tolist() == whole(text), text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aB éß.,'!\n\t 1 ́  <|>中")), max_size=40))
def test_any_text_encodes_alike(text):
    for path in (WORD, BYTE):
        assert np.frombuffer(_encoder(path).encode_one(text), "<u4").tolist() == _whole(path)(text)


_KEPT = {}


def _encoder(path):
    return _KEPT.setdefault(("e", path), Encoder(path))


def _whole(path):
    return _KEPT.setdefault(("w", path), library(path))


def test_generations_change_nothing(texts, monkeypatch):
    from trackloom.llm import tokenizer

    monkeypatch.setattr(tokenizer, "CHUNKS", 50)
    small, whole = Encoder(WORD), library(WORD)
    for text in list(texts.values())[:40]:
        assert np.frombuffer(small.encode_one(text), "<u4").tolist() == whole(text)


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(-2**62, 2**62, 5000)
    made = PerfectHash.of(np.unique(keys))
    assert sorted(made.slots(np.unique(keys))) == list(range(len(np.unique(keys))))


def test_query_equals_sequential_encoding(spark, sf_dir, texts):
    got = {r.doc_id: r for r in queries.op1_token_store(spark, sf_dir).collect()}
    whole, start = library(WORD), 0
    for doc_id in sorted(texts):
        ids = [*whole(texts[doc_id]), 2]
        row = got.pop(doc_id)
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not got


def test_odd_rows_and_missing_keys(spark):
    from tests_llm import odd_documents

    docs = odd_documents(spark, [(7, "one two"), (7, "one two"), (9, "three")])
    path = new_path(spark, "store")
    token_store.write(docs, path, WORD, 2, shards=3, block_bytes=16)
    rows = token_store.read(spark, path, docs, with_ids=True).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in rows) == [
        (False, 5, 1), (False, 5, 1), (False, 7, 3), (False, 7, 3), (False, 9, 2), (True, 0, 1), (True, 0, 1)]
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in ordered] == [0, 1, 2, 3, 4, 7, 10]
    assert all(r.ids_crc32 == zlib.crc32(r.ids) for r in rows)
    assert token_store.read(spark, path, spark.createDataFrame([(8,), (10**12,)], "doc_id long")).count() == 0
    empty = new_path(spark, "store")
    token_store.write(docs.limit(0), empty, WORD, 2)
    assert token_store.read(spark, empty, docs).count() == 0


def test_added_tokens_in_a_text_are_what_the_library_makes_of_them(spark):
    from pyspark.sql import functions as F

    from trackloom.llm import packing
    from trackloom.llm.tokenizer import encoder

    odd = [*ODD, "end <|endoftext|> of text", "<|startoftext|>a b  c<|endoftext|>", "<|ENDOFTEXT|> x", "<|endoftext|>", "a <|endoftext |> b", "plain words"]
    for path in (WORD, BYTE):
        plain = Tokenizer.from_file(path)
        for text in odd:
            assert np.frombuffer(encoder(path).encode_one(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").repartition(1)
    packed = {r.doc_id: r for r in packing.pack(docs, BYTE, end_id=0, capacity=2048).collect()}
    store = new_path(spark, "added")
    token_store.write(docs, store, WORD, end_id=2)
    kept = {r.doc_id: r for r in token_store.read(spark, store, docs.select("doc_id", F.col("text"))).collect()}
    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    for i, text in enumerate(odd):
        ids = np.array(byte.encode(text, add_special_tokens=False).ids + [0], "<u4")
        assert packed[i].length == len(ids) and packed[i].ids_crc32 == zlib.crc32(ids.tobytes())
        ids = np.array(word.encode(text, add_special_tokens=False).ids + [2], "<u4")
        assert kept[i].n_tokens == len(ids) and kept[i].ids_crc32 == zlib.crc32(ids.tobytes())


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_closed_words_go_the_short_way(path, monkeypatch):
    text = "Some words*** (in brackets), a_b$$ or naïve%%% ones;\nend... words*** and words*** it's Größe#"
    encoder = Encoder(path, added=True)
    whole, met = encoder._whole, []
    monkeypatch.setattr(encoder, "_whole", lambda chunks: met.extend(chunks) or whole(chunks))
    got = [encoder.encode_one(text) for _ in range(3)]
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert got == [np.asarray(want, "<u4").tobytes()] * 3
    assert [m.strip() for m in met] == ["(in", "a_b", "it's"]


def test_an_idle_worker_gives_its_chunks_back(monkeypatch):
    from trackloom.llm import tokenizer

    monkeypatch.setattr(tokenizer, "IDLE", 0.05)
    encoder = Encoder(BYTE)
    first = encoder.encode_one("some words, and more\nwords")
    assert encoder.known and encoder.spaced
    for _ in range(100):
        if not encoder.known and not encoder.spaced:
            break
        time.sleep(0.05)
    assert not encoder.known and not encoder.spaced
    assert encoder.encode_one("some words, and more\nwords") == first
