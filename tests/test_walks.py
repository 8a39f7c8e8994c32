"""Permuted values traced over codes: equal to scoring every changed row, at a fraction of its work."""

import time

import numpy as np
import pandas as pd
import pytest

from trackloom.models.trees import depth_limit, grow, pack


def _forest(rows, psi, trees, seed=0):
    grown = []
    for tree in range(trees):
        rng = np.random.default_rng([seed, tree])
        nodes = grow(rows[rng.permutation(len(rows))[:psi]], rng, depth_limit(psi))
        nodes.insert(0, "tree_id", tree)
        grown.append(nodes)
    return pack(pd.concat(grown), psi, np.zeros(rows.shape[1]), np.ones(rows.shape[1]))


def _one_by_one(forest, own, donors):
    out = []
    for donor in donors:
        scores = np.empty(own.shape)
        for f in range(own.shape[1]):
            changed = own.copy()
            changed[:, f] = donor[:, f]
            scores[:, f] = forest.scores(changed)[:, 0]
        out.append(scores)
    return out


@pytest.mark.parametrize("width, psi", [(1, 256), (2, 64), (6, 2), (6, 1024)])
def test_traced_rows_score_like_changed_rows(width, psi):
    rng = np.random.default_rng(width * psi)
    rows = np.round(rng.standard_normal((1500, width)) ** 3, 2)       # long tails, and many equal values
    rows[:, -1] = np.where(rows[:, -1] > 0, rows[:, -1], 0.0)
    forest = _forest(rows, psi, 12)
    own, donors = rows[:400].copy(), [rows[400:800].copy(), rows[800:1200].copy()]
    own[3, 0], donors[0][5, 0], donors[1][3, -1] = np.nan, np.nan, np.inf
    own[7, 0] = forest.cuts[0][len(forest.cuts[0]) // 2]              # on a cut point: left
    plain, *permuted = forest.permuted_scores(own, *donors)
    assert np.array_equal(plain, forest.scores(own)[:, 0])
    for found, want in zip(permuted, _one_by_one(forest, own, donors)):
        np.testing.assert_allclose(found, want, rtol=1e-13, atol=0)


def test_tracing_costs_a_part_of_scoring_every_changed_row():
    rng = np.random.default_rng(5)
    rows = rng.standard_normal((20_000, 35)) ** 3
    forest = _forest(rows, 256, 50)
    own, donors = rows[:10_000], [rows[rng.permutation(len(rows))[:10_000]] for _ in range(5)]

    def seconds(work):
        work()                                                        # tables of the forest are made once
        start = time.process_time()
        work()
        return time.process_time() - start

    one = seconds(lambda: [forest.scores(own) for _ in range(4)]) / 4
    assert seconds(lambda: forest.permuted_scores(own, *donors)) < 0.35 * one * (1 + 5 * rows.shape[1])
