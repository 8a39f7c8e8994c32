import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from tests_llm import odd_documents

from trackloom.llm import decontaminate as D
from trackloom.llm import queries


def least_edits(item, text):
    """Plain dynamic programming: edits between the item and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=12), st.text("abcd", max_size=40))
def test_bit_parallel_distance(item, text):
    assert D.nearest(D.letters(item), len(item), text)[0] == least_edits(item, text)


def spoil(text, edits, rng):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice("abcdefgh ")
        elif kind == 1:
            out.insert(at, rng.choice("abcdefgh"))
        else:
            del out[at]
    return "".join(out)


def test_every_pair_within_the_budget_and_no_other(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, prose(rng.randint(8, 20))) for i in range(12)]
    docs = []
    for i in range(120):
        _, item = rng.choice(items)
        copy = spoil(item, rng.randint(0, int(0.14 * len(item))), rng)
        docs.append((i, prose(rng.randint(0, 30)) + " " + copy + " " + prose(rng.randint(0, 30))))
    got = {(r.doc_id, r.item_id): r for r in D.pairs(spark.createDataFrame(docs, "doc_id long, text string"),
                                                     spark.createDataFrame(items, "item_id long, text string"), block_chars=400).collect()}
    want = {}
    for i, text in docs:
        for k, item in items:
            a, b = D.normal(item), D.normal(text)
            d = least_edits(a, b)
            if d <= int(D.RATE * len(a)):
                want[i, k] = d
    assert {k: r.distance for k, r in got.items()} == want and len(want) > 30
    texts = dict(docs)
    for (i, k), r in got.items():
        assert least_edits(D.normal(dict(items)[k]), D.normal(texts[i])[r.start:r.end]) == r.distance


def test_query_finds_the_verbatim_passages(spark, sf_dir, texts):
    bench = {r.item_id: D.normal(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r.distance for r in queries.op5_decontamination(spark, sf_dir).collect()}
    whole = {(i, k) for i, t in texts.items() for k, b in bench.items() if b in D.normal(t)}
    assert whole and {p for p, d in got.items() if d == 0} == whole


def test_odd_rows(spark):
    item = "A passage that nobody would write twice by chance, or so we hope."
    docs = odd_documents(spark, [(1, "x " + item.upper().replace(" ", "\n\t ")), (1, "x " + item), (2, "clean")])
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "clean"), (None, item)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id or 0, r.distance) for r in D.pairs(docs, bench).collect()) == [(1, 0, 0)] * 2 + [(1, 1, 0)] * 4
    kept = D.without_leaks(docs, bench)
    assert kept.schema == docs.schema and sorted(map(str, (r.doc_id for r in kept.collect()))) == ["2", "5", "5", "None", "None"]
    assert D.pairs(docs, bench.limit(0)).count() == 0 and D.pairs(docs.limit(0), bench).count() == 0
    assert D.without_leaks(docs, bench.limit(0)).count() == 7


def test_short_items_letter_for_letter(spark):
    rng = random.Random(5)
    docs = [(i, "".join(rng.choice("ab c.") for _ in range(rng.randint(0, 40)))) for i in range(200)] + [(900, None), (901, ""), (902, "AB\n C")]
    items = [(1, "ab c"), (2, "a"), (3, "."), (4, "  "), (5, None), (6, "b.b"), (7, "a passage longer than twenty letters")]
    alone = {k: re.compile((r"(?<![^\W_])" if b[0].isalnum() else "") + re.escape(b) + (r"(?![^\W_])" if b[-1].isalnum() else ""))
             for k, b in ((k, D.normal(t)) for k, t in items) if b}
    want = {(i, k, m.start(), m.end()) for i, t in docs for k, p in alone.items() if (m := p.search(D.normal(t)))}
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = D.pairs(frame, bench, short_exact=True).collect()
    assert {(r.doc_id, r.item_id, r.start, r.end) for r in got} == want and len(got) == len(want) > 50 and (902, 1, 0, 4) in want
    assert {r.doc_id for r in D.without_leaks(frame, bench, short_exact=True).collect()} == {i for i, _ in docs} - {w[0] for w in want}
    assert D.pairs(frame, bench).count() == 0 and D.without_leaks(frame, bench).count() == len(docs)
