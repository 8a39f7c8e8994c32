"""Toxicity classifiers learnt from confirmed toxic and unlabelled texts by non-negative PU risk.

With prior p of toxic texts, the risk of a scorer is p * R+(positives) + max(0, R-(unlabelled) - p * R-(positives)),
all means of the logistic loss; when the second part turns negative, its gradient is reversed, as the scorer
then fits the unlabelled texts too closely. The prior is the share of toxic among the labelled rows that may be
used; beyond it, the unlabelled part never sees a label.

Training uses at most ``positives`` and ``unlabelled`` labelled rows (those with the smallest hash of their
id), split over ``members`` classifiers that are fitted side by side, each in one task on its bounded share.
A member screens words by the difference of their document frequencies and fits weights for the most telling
ones; a text's score is the mean of its members' probabilities. Every text is scored whole.

Null and empty texts have no words and get the members' bias. Labels that are null are no positives. Without a
positive or an unlabelled row the score is 0. Repeated labels count once, as toxic if any of them is; an id with
several texts is fitted with the smallest of them; repeated rows and null ids are each scored; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

MEMBERS = 4
MEMBER_POSITIVES = 200     # fewer positives make fewer members
POSITIVES = 6_000
UNLABELLED = 12_000
WORDS = 400
MODEL = "member int, bias double, words array<string>, weights array<double>"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows whose labels are never learnt from; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def screen(positive: list[set[str]], unlabelled: list[set[str]], most: int) -> list[str]:
    """Words whose share of texts differs most between the two, in standard errors, and by over four of them."""
    a, b = Counter(w for t in positive for w in t), Counter(w for t in unlabelled for w in t)
    n, m = len(positive), len(unlabelled)
    names = [w for w in a.keys() | b.keys() if a[w] + b[w] >= 5]
    if not names:
        return []
    x, y = np.array([a[w] for w in names]) / n, np.array([b[w] for w in names]) / m
    share = (x * n + y * m) / (n + m)
    z = np.abs(x - y) / np.sqrt(share * (1 - share) * (1 / n + 1 / m) + 1e-12)
    order = sorted(range(len(names)), key=lambda i: (-z[i], names[i]))
    return [names[i] for i in order[:most] if z[i] > 4]


def fit_pu(p: np.ndarray, u: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.05, shrink: float = 1e-4):
    """Weights and bias by Adam steps on the non-negative risk over rows of word indicators."""
    p, u = (np.hstack([x, np.ones((len(x), 1))]) for x in (p, u))
    w = np.zeros(p.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        gp, gu = p @ w, u @ w
        sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
        down = p.T @ (sp - 1) / len(p) * prior                      # of positives' loss as positive
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        away = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)      # of the corrected negative part
        gradient = down + away if negative >= 0 else -away
        gradient[:-1] += shrink * w[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def _fit(prior: float, most: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("positive", "ascending")])     # sums repeat exactly, whatever order rows came in
        texts = [set(x) for x in table["words"].to_pylist()]
        positive = table["positive"].to_numpy()
        a = [t for t, y in zip(texts, positive) if y == 1]
        b = [t for t, y in zip(texts, positive) if y == 0]
        names, weights, bias = [], np.zeros(0), -40.0
        if a and b:
            names = screen(a, b, most)
            place = {w: i for i, w in enumerate(names)}

            def rows(texts):
                x = np.zeros((len(texts), len(names)))
                for i, t in enumerate(texts):
                    x[i, [place[w] for w in t if w in place]] = 1
                return x

            weights, bias = fit_pu(rows(a), rows(b), prior)
        return pa.table({"member": pa.array([table["member"][0].as_py()], pa.int32()), "bias": [bias],
                         "words": pa.array([names], pa.list_(pa.string())), "weights": pa.array([weights.tolist()], pa.list_(pa.float64()))})

    return run


def _words(batches):
    for batch in batches:
        words = [sorted(words_of(t.as_py())) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.string())), batch.column(3).cast(pa.int64())],
                                         names=["member", "positive", "words", "doc_id"])


def fit(docs: DataFrame, labels: DataFrame, members: int = MEMBERS, positives: int = POSITIVES,
        unlabelled: int = UNLABELLED, words: int = WORDS, folds: int = 5) -> list[tuple[float, dict[str, float]]]:
    """Up to `members` classifiers as (bias, weight by word), at most `members` x `words` numbers."""
    ship(docs.sparkSession)
    known = (labels.filter(~held_out(F.col("doc_id"), folds) & F.col("doc_id").isNotNull())
                   .groupBy("doc_id").agg(F.coalesce(F.max("toxic"), F.lit(0)).alias("toxic"))
                   .withColumn("order", F.xxhash64(F.col("doc_id"), F.lit(7))))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n or not toxic:
        return []
    prior = min(0.95, toxic / n)
    members = max(1, min(members, min(toxic, positives) // MEMBER_POSITIVES))
    p = known.filter("toxic = 1").orderBy("order", "doc_id").limit(positives).withColumn("positive", F.lit(1))
    u = known.withColumn("order", F.xxhash64(F.col("doc_id"), F.lit(8))).orderBy("order", "doc_id").limit(unlabelled).withColumn("positive", F.lit(0))
    chosen = p.unionByName(u).select("doc_id", "positive", F.pmod("order", F.lit(members)).cast("int").alias("member"))
    # copies of a chosen id end before the shuffle, so what follows has at most positives + unlabelled rows
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    fitted = (texts.join(F.broadcast(chosen), "doc_id").select("member", "positive", "text", "doc_id")
                   .mapInArrow(_words, "member int, positive int, words array<string>, doc_id long")
                   .groupBy("member").applyInArrow(_fit(prior, words), MODEL).collect())
    return [(r.bias, dict(zip(r.words, r.weights))) for r in sorted(fitted, key=lambda r: r.member)]


def score_text(text: str | None, weight: dict[str, np.ndarray], bias: np.ndarray) -> float:
    g = bias.copy()
    for w in sorted(words_of(text).intersection(weight)):   # in order, so that sums repeat exactly
        g += weight[w]
    return float((1 / (1 + np.exp(-np.clip(g, -500, 500)))).mean())


def _tables(model):
    bias = np.array([b for b, _ in model])
    weight: dict[str, np.ndarray] = {}
    for i, (_, words) in enumerate(model):
        for w, value in words.items():
            weight.setdefault(w, np.zeros(len(model)))[i] = value
    return weight, bias


def score(docs: DataFrame, model: list[tuple[float, dict[str, float]]]) -> DataFrame:
    """All rows and columns of `docs` with a `score` from 0 to 1. Only the texts go through Python."""
    ship(docs.sparkSession)
    if "score" in docs.columns:
        docs = docs.drop("score")
    sent = docs.sparkSession.sparkContext.broadcast(_tables(model))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weight, bias = sent.value
        for texts in batches:
            yield pa.array([score_text(t.as_py(), weight, bias) if len(bias) else 0.0 for t in texts], pa.float64())

    return docs.withColumn("score", F.arrow_udf(run, "double")("text"))
