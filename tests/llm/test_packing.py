import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tests_llm import odd_documents
from tokenizers import Tokenizer

from trackloom.llm import packing, queries

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def best_fit_one_by_one(lengths, capacity):
    spaces = []
    for n in sorted(lengths, reverse=True):
        fit = min((i for i, s in enumerate(spaces) if s >= n), key=lambda i: spaces[i], default=None)
        if fit is None:
            spaces.append(capacity - n)
        else:
            spaces[fit] -= n
    return len(spaces)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_a_plan_uses_every_length_and_no_more_room(lengths):
    made = packing.plan(dict(Counter(lengths)), 64)
    used = Counter()
    for pattern, repeats in made:
        assert sum(pattern) <= 64 and repeats > 0
        for n in pattern:
            used[n] += repeats
    assert used == Counter(lengths)


def test_plans_are_close_to_the_bound():
    rng = np.random.default_rng(4)
    for draw in (rng.integers(1, 513, 4000), np.clip(rng.lognormal(4.5, 0.8, 4000).astype(int), 1, 512), rng.integers(150, 200, 3000)):
        made = sum(r for _, r in packing.plan(dict(Counter(draw.tolist())), 512))
        assert made <= 1.01 * best_fit_one_by_one(draw.tolist(), 512) + 1


def test_query_places_every_piece(spark, sf_dir, texts):
    rows = queries.op3_packing(spark, sf_dir).collect()
    library = Tokenizer.from_file(BYTE)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    total = 0
    for doc_id, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids + [0]
        total += len(ids)
        mine = sorted(pieces.pop(doc_id), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine)))
        assert all(r.length == 2048 for r in mine[1:]) and len(mine) == -(-len(ids) // 2048)
        at = 0
        for r in mine:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert not pieces
    for placed in sequences.values():
        at = 0
        for r in sorted(placed, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    lengths = [r.length for r in rows]
    assert len(sequences) <= best_fit_one_by_one(lengths, 2048) + 1 and len(sequences) <= 1.02 * total / 2048 + 2


def test_odd_rows_and_sequences(spark):
    docs = odd_documents(spark, [(1, "a b c " * 50)] * 3)
    packed = packing.pack(docs, BYTE, 0, capacity=64, with_ids=True)
    rows = packed.collect()
    assert sum(r.length == 1 for r in rows) >= 4 and len({(r.row, r.piece) for r in rows}) == len(rows)
    for s in packing.sequences(packed).collect():
        assert len(s.ids) == 4 * sum(s.lengths) <= 256
    assert packing.pack(docs.limit(0), BYTE, 0).count() == 0


def test_most_pieces_come_from_fitted_patterns(spark, docs):
    """Of the documents' own histogram, and of ten times as many; sequences stay at the bound."""
    found = packing.pack(docs, BYTE, 0).groupBy("length").count().collect()
    for times in (1, 10, 100):
        counts = np.zeros(2049, np.int64)
        for r in found:
            counts[r["length"]] = r["count"] * times
        bound = -(-int((counts * np.arange(2049)).sum()) // 2048)
        made = packing.plan({n: int(c) for n, c in enumerate(counts) if c}, 2048)
        exact = sum(len(p) * r for p, r in made if sum(p) == 2048)
        assert sum(r for _, r in made) <= 1.01 * bound + 1
        if times > 1:
            assert exact > 0.5 * counts.sum()


def test_added_tokens_as_the_library_has_them(spark):
    texts = ["end <|endoftext|> of text", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>"]
    library = Tokenizer.from_file(BYTE)
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), BYTE, 0).collect()
    assert {r.doc_id: r.ids_crc32 for r in rows} == {
        i: zlib.crc32(np.array(library.encode(t, add_special_tokens=False).ids + [0], "<u4").tobytes()) for i, t in enumerate(texts)}
