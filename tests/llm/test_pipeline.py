"""Each stage on its own input against a plain version."""

import re

import corpus_pipeline as P
import pytest
from test_simhash import classes, plain as fingerprint
from tests_llm import odd_documents

from trackloom.llm import decontaminate, pii, toxicity
from trackloom.llm.common import materialize

SF = "/root/testdata/sf0.001"


def test_contract():
    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash", "decontamination", "pii", "packing"]


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.columns == out[0].columns and docs.schema == out[0].schema
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_toxicity(spark, steps):
    before, after = rows(steps[0]), rows(steps[1])
    model = toxicity._tables(toxicity.fit(steps[0], spark.read.parquet(f"{SF}/labels.parquet")))
    want = {i for i, r in before.items() if not len(model[1]) or toxicity.score_text(r.text, *model) < 0.5}
    assert after.keys() == want and all(before[i] == r for i, r in after.items())


def test_simhash(steps):
    before, after = rows(steps[1]), rows(steps[2])
    groups = classes({i: fingerprint(r.text) for i, r in before.items()})
    assert after.keys() == set(groups.values()) and all(before[i] == r for i, r in after.items())


def test_decontamination(spark, steps):
    before, after = rows(steps[2]), rows(steps[3])
    leaks = {r.doc_id for r in decontaminate.pairs(steps[2], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    bench = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert leaks >= {i for i, r in before.items() if any(b in decontaminate.normal(r.text) for b in bench)}
    assert after.keys() == before.keys() - leaks


def test_pii(steps):
    before, after = rows(steps[3]), rows(steps[4])
    spans = {r.doc_id: r.spans for r in pii.find(steps[3]).collect()}
    assert before.keys() == after.keys()
    for i, r in before.items():
        text, end, out = r.text, 0, ""
        merged = []
        for s in spans[i]:
            if merged and s.start < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], s.end)
            else:
                merged.append([s.start, s.end, s.kind])
        for a, b, kind in merged:
            out += text[end:a] + f"[{kind.upper()}]"
            end = b
        assert after[i].text == out + text[end:]
        assert not re.search(r"\w@\w+\.", after[i].text)


def test_run_packs_what_the_stages_kept(spark, steps):
    packed = P.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == rows(steps[4]).keys()


def test_odd_rows_and_nothing(spark):
    docs = materialize(odd_documents(spark, [(8, "One two three four five six seven."), (8, "One two three four five six seven.")]), "odd")
    for frame in (docs, materialize(docs.limit(0), "none")):
        for name, stage in P.STAGES[:-1]:
            frame = materialize(stage(spark, frame, SF), name)
            assert frame.columns == docs.columns
        P.STAGES[-1][1](spark, frame, SF).count()
