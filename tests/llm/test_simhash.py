import itertools
import random
import re

import numpy as np
from tests_llm import odd_documents
from xxhash import xxh64_intdigest

from trackloom.llm import queries, simhash
from trackloom.llm.components import components


def plain(text, words=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[i:i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, radius=4):
    root = {i: i for i in prints}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in prints}


def test_covering_meets_every_pair_at_every_level():
    rng = random.Random(3)
    for _ in range(300):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        fixed = 0
        while 64 - fixed.bit_count() > simhash.LAST_FREE:
            masks = [m for m in simhash.covering(4, fixed) if not m & diff]
            assert masks and all(64 - m.bit_count() <= (64 - fixed.bit_count()) * 2 / 3 for m in simhash.covering(4, fixed))
            fixed = masks[0]


def test_query_equals_brute_force(spark, sf_dir, texts):
    got = {r.doc_id: r for r in queries.op2_simhash(spark, sf_dir).collect()}
    prints = {i: plain(t) for i, t in texts.items()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in got.items()} == classes(prints)


def test_full_buckets_are_dealt_again_without_loss(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in rng.sample(range(20), rng.randint(0, 9))) for _ in range(150)}
    prints |= {rng.getrandbits(64) for _ in range(100)}
    frame = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    want = classes({p: p for p in prints})
    groups = {}
    for p, g in want.items():
        groups.setdefault(g, set()).add(p)
    for bucket in (3, 20, 4096):
        links = [(r.u & (2**64 - 1), r.v & (2**64 - 1)) for r in simhash.links(frame, 4, bucket).collect()]
        assert all((a ^ b).bit_count() <= 4 for a, b in links)
        root = {r.node & (2**64 - 1): r.component & (2**64 - 1) for r in components(
            spark.createDataFrame([(simhash._signed(a), simhash._signed(b)) for a, b in links], "u long, v long")).collect()}
        found = {}
        for p in prints:
            found.setdefault(root.get(p, p), set()).add(p)
        assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups.values()))


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    rows = chain + star + [(7, 7), (1, 0), (500, 400)]
    random.Random(1).shuffle(rows)
    got = {r.node: r.component for r in components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 500: 400, 400: 400}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_odd_rows(spark):
    text = "The quick brown fox jumps over the lazy dog again and again"
    docs = odd_documents(spark, [(8, text), (3, text.upper()), (3, text), (11, "else entirely is what this one says to us")])
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == 8
    assert {(r.doc_id, r.component_id) for r in got if r.fp} == {(8, 3), (3, 3), (11, 11)}
    assert {(r.doc_id, r.component_id) for r in got if not r.fp} == {(None, 5), (5, 5)}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    path = simhash.materialize(docs, "odd")
    kept = simhash.one_of_each(path)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 5, 11]


def test_a_long_text_is_read_whole(spark):
    rng = np.random.default_rng(0)
    text = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 70_000))
    assert simhash.fingerprint(text.encode(), 4) == plain(text)
