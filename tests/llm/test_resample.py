import numpy as np
from tests_llm import odd_documents

from trackloom.llm import queries, resample


def test_query_equals_plain_models(spark, sf_dir, texts):
    rows = {r.doc_id: r for r in queries.op6_resampling(spark, sf_dir).collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").collect()}
    counts = np.zeros((2, resample.BUCKETS))
    found = {i: resample.ngrams(t.encode(), resample.BUCKETS) for i, t in texts.items()}
    for i, g in found.items():
        np.add.at(counts[0], g, 1)
        if i in good:
            np.add.at(counts[1], g, 1)
    p = (counts + 1) / (counts.sum(axis=1, keepdims=True) + resample.BUCKETS)
    ratio = np.log(p[1] / p[0])
    assert rows.keys() == texts.keys()
    assert all(abs(rows[i].log_weight - ratio[g].sum()) < 1e-6 for i, g in found.items())
    assert sum(r.selected for r in rows.values()) == round(resample.SHARE * len(rows))
    assert min(r.key for r in rows.values() if r.selected) > max(r.key for r in rows.values() if not r.selected)


def test_gumbel_keys_draw_in_proportion(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "cast(null AS string) AS text")
    keys = np.array([r.key for r in resample.resample(docs, docs.limit(0), share=0.5).select("key").collect()])
    assert abs(keys.mean() - 0.5772) < 0.03 and abs(keys.var() - np.pi**2 / 6) < 0.08


def test_good_texts_are_preferred(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r.selected for r in queries.op6_resampling(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    share = [np.mean([rows[r.doc_id] for r in labels if r.quality == q]) for q in (0, 1)]
    assert share[1] > share[0] + 0.3


def test_odd_rows(spark):
    docs = odd_documents(spark, [(1, "a b"), (1, "a b")])
    got = resample.resample(docs, docs.select("doc_id", "score")).collect()
    assert len(got) == 6 and sum(r.selected for r in got) >= 5
    assert resample.resample(docs.limit(0), docs).count() == 0
