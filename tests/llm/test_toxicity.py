import math
import re
import zlib

import numpy as np
from tests_llm import odd_documents

from trackloom.llm import queries, toxicity
from trackloom.llm.common import whole


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in queries.op10_toxicity(spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    labels = [(rows[r.doc_id].score, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    toxic, clean = [s for s, y in labels if y], [s for s, y in labels if not y]
    assert toxic and np.mean([a > b for a in toxic for b in clean]) > 0.92 and np.mean(np.array(clean) >= 0.5) < 0.01
    assert np.mean([(s >= 0.5) == bool(y) for s, y in labels]) > 0.95


def test_held_out_labels_are_not_read(spark, sf_dir, docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = [(r.doc_id, 1 - r.toxic if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else r.toxic) for r in labels.collect()]
    turned = spark.createDataFrame(rows, "doc_id long, toxic int")
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, turned)


def test_risk_step_turns_back_when_negative():
    rng = np.random.default_rng(0)
    p, u = rng.random((40, 30)) < 0.5, rng.random((400, 30)) < 0.5
    p[:, 0] = True
    u[:, 0] = np.arange(400) < 60
    w, b = toxicity.fit_pu(p.astype(float), u.astype(float), 0.15)
    g = u @ w + b
    assert g[:60].mean() > g[60:].max() - 3 and (g[60:] < 0).mean() > 0.97


def test_odd_rows(spark):
    docs = odd_documents(spark, [(1, "some text"), (1, "some text")])
    labels = spark.createDataFrame([(1, None), (None, 1), (5, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model)
    assert model == [] and {r.score for r in scored.collect()} == {0.0}
    assert sorted(scored.columns) == sorted(docs.columns)
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.fit(docs, labels.limit(0)) == []


def plain_fit(positive, unlabelled, prior, words):
    """Screen and non-negative PU fit over lists of word sets, a number at a time."""
    z = {}
    for w in {w for t in positive + unlabelled for w in t}:
        a, b = sum(w in t for t in positive), sum(w in t for t in unlabelled)
        if a + b >= 5:
            share = (a + b) / (len(positive) + len(unlabelled))
            z[w] = abs(a / len(positive) - b / len(unlabelled)) / math.sqrt(share * (1 - share) * (1 / len(positive) + 1 / len(unlabelled)) + 1e-12)
    names = [w for w in sorted(z, key=lambda w: (-z[w], w))[:words] if z[w] > 4]
    w = [0.0] * len(names) + [math.log(prior / (1 - prior))]
    first, second = [0.0] * len(w), [0.0] * len(w)
    places = [[[i for i, x in enumerate(names) if x in t] + [len(names)] for t in texts] for texts in (positive, unlabelled)]
    for step in range(1, 401):
        scores = [[sum(w[i] for i in at) for at in part] for part in places]
        high = [sum(math.log1p(math.exp(-abs(g))) + max(g, 0) for g in part) / len(part) for part in scores]
        down, away = [0.0] * len(w), [0.0] * len(w)
        for part, at_all, weight in ((scores[0], places[0], -prior), (scores[1], places[1], 1.0)):
            for g, at in zip(part, at_all):
                s = 1 / (1 + math.exp(-g))
                for i in at:
                    away[i] += weight * s / len(part)
                    if weight < 0:
                        down[i] += prior * (s - 1) / len(part)
        kept = high[1] - prior * high[0] >= 0
        gradient = [d + a if kept else -a for d, a in zip(down, away)]
        for i in range(len(w)):
            g = gradient[i] + (1e-4 * w[i] if i < len(names) else 0)
            first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.999 * second[i] + 0.001 * g * g
            w[i] -= 0.05 * (first[i] / (1 - 0.9**step)) / (math.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return dict(zip(names, w)), w[-1]


def test_fit_and_score_equal_plain_version(spark):
    docs = [(i, "vile nasty scum talk" if i % 4 == 0 else f"good plain talk {'nasty' if i % 9 == 1 else 'kind'} x{i % 7}") for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = [(i, int(i % 4 == 0 and i % 3 > 0)) for i, _ in docs if i % 8 < 7]
    usable = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5]
    sets = {i: set(re.findall(r"[a-z]+", t)) for i, t in docs}
    weights, bias = plain_fit([sets[i] for i, y in usable if y], [sets[i] for i, _ in usable], sum(y for _, y in usable) / len(usable), toxicity.WORDS)
    model = toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert len(model) == 1 and set(model[0][1]) == set(weights) and len(weights) > 2
    assert np.allclose([model[0][0], *(model[0][1][w] for w in sorted(weights))], [bias, *(weights[w] for w in sorted(weights))], atol=1e-6)
    for r in toxicity.score(frame, model).collect():
        assert abs(r.score - 1 / (1 + math.exp(-bias - sum(weights.get(w, 0) for w in sets[r.doc_id])))) < 1e-6


def test_copies_of_an_id_do_not_move_the_fit(spark):
    docs = [(i, f"vile scum w{i % 5}" if i % 3 == 0 else f"good kind w{i % 5}") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in docs], "doc_id long, toxic int")
    one = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    many = spark.createDataFrame(docs + [docs[3]] * 5000 + [(4, None)] * 10, "doc_id long, text string").repartition(7)
    assert toxicity.fit(many, labels) == one and one[0][1]
    assert toxicity.score(many, one).count() == 5310


def test_long_text(spark):
    text = "vile " * 200_000 + "x" * 1_000_000
    scored = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), [(-1.0, {"vile": 3.0})]).collect()
    assert abs(scored[0].score - 1 / (1 + math.exp(-2))) < 1e-12


def test_only_texts_go_through_python(docs):
    scored = toxicity.score(docs.select(whole(docs), "text"), [(0.0, {"the": 1.0})])
    plan = scored.filter("score < 0.5").select("_doc.*")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("ArrowEvalPython") == 1
