"""Exact quantiles and ranks without sorting, against numpy."""

import dataclasses

import numpy as np
import pytest
from helpers import CUT, START

from trackloom.plans.selection import before_key, order_statistics, quantiles, row_key_at, row_keys_at

TINY = dataclasses.replace(CUT, bracket_rows=5, sketch_accuracy=20)


def columns():
    rng = np.random.default_rng(3)
    n = 4000
    heavy = np.where(rng.random(n) < 0.4, 7.0, np.where(rng.random(n) < 0.5, -1.0, rng.normal(size=n)))
    return {"smooth": rng.normal(size=n), "heavy": heavy, "constant": np.full(n, 2.5),
            "skewed": np.exp(rng.normal(scale=6, size=n)), "counts": rng.integers(0, 12, n).astype(float)}


@pytest.fixture(scope="module")
def table(spark):
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame(columns())).cache()


@pytest.mark.parametrize("cfg", [CUT, TINY])
def test_quantiles(table, cfg):
    wanted = {c: (0.0, 0.05, 0.25, 0.5, 0.999, 1.0) for c in columns()}
    found = quantiles(table, wanted, cfg)
    for name, values in columns().items():
        assert found[name] == pytest.approx(np.quantile(values, wanted[name]), rel=1e-12)


def test_ranks_at_the_edges_of_ties(table):
    values = np.sort(columns()["heavy"])
    edges = np.flatnonzero(np.diff(values) > 0)
    ranks = [0, len(values) - 1, *(int(e) for e in edges[:: max(1, len(edges) // 15)]), *(int(e) + 1 for e in edges[-3:])]
    assert order_statistics(table, [("heavy", r) for r in ranks], TINY) == [values[r] for r in ranks]
    assert order_statistics(table, [("heavy", len(values))], TINY) == [None]


def test_nulls_are_not_counted(spark):
    df = spark.createDataFrame([(float(i) if i % 2 else None,) for i in range(1000)], "x double")
    assert quantiles(df, {"x": [0.5]}, TINY)["x"] == quantiles(df, {"x": [0.5]})["x"] == [500.0]


def test_no_rows(spark):
    df = spark.createDataFrame([], "x double")
    assert quantiles(df, {"x": [0.5]}, TINY)["x"] == quantiles(df, {"x": [0.5]})["x"] == [None]


@pytest.mark.parametrize("rank", [0, 1, 899, 900, 1700, 1999])
def test_key_at_rank_with_equal_times(spark, rank):
    """Nine tenths of the rows share one timestamp; the id decides."""
    import datetime as dt

    rows = [(i, START + dt.timedelta(seconds=0 if 100 <= i < 1900 else i - 100)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, ts timestamp")
    by_hand = sorted(rows, key=lambda r: (r[1], r[0]))
    for cfg in (CUT, TINY):
        key = row_key_at(df, rank, ("ts", "id"), cfg)
        assert key[1] == by_hand[rank][0]
        assert df.filter(before_key(df, ("ts", "id"), key)).count() == rank


def test_many_keys_share_the_scans(spark):
    import datetime as dt

    rows = [(i, START + dt.timedelta(seconds=0 if 100 <= i < 900 else i // 3)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, ts timestamp")
    by_hand = [i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))]
    ranks = [1999, 0, 450, 450, 899, 1200, -1, 2000]
    jobs = []
    for chosen in ([450], ranks):
        spark.sparkContext.setJobGroup(f"keys{len(chosen)}", "")
        keys = row_keys_at(df, chosen, ("ts", "id"), TINY)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"keys{len(chosen)}")))
        assert [None if k is None else k[1] for k in keys] == [by_hand[i] if 0 <= i < 2000 else None for i in chosen]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] < 2 * jobs[0]        # five keys that exist; one by one they would take five times as many
