"""Small numeric helpers that run inside tasks: grow one tree, score one batch.

Isolation trees as published by Liu, Ting and Zhou (2008): random feature, uniform cut,
bounded depth; the path of a leaf holding n rows is its depth plus the mean unsuccessful
search length of a binary tree over n keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd

EULER_GAMMA = 0.5772156649015329  # fixed value
LEAF = -1
BLOCK = 16_384  # rows scored together
TRACED = 16_384  # rows whose permuted values are traced together


def depth_limit(psi: int) -> int:
    return max(1, math.ceil(math.log2(max(psi, 2))))


def mean_path(n: np.ndarray | int) -> np.ndarray:
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    search = 2.0 * (np.log(big - 1.0) + EULER_GAMMA) - 2.0 * (big - 1.0) / big
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, search))


def grow(rows: np.ndarray, rng: np.random.Generator, limit: int) -> pd.DataFrame:
    """Node table of one tree over at most a few hundred rows."""
    nodes: list[list] = []
    todo = [(np.arange(len(rows)), 0, None, None)]
    while todo:
        members, depth, parent, side = todo.pop()
        node = len(nodes)
        nodes.append([node, LEAF, 0.0, LEAF, LEAF, len(members), depth])
        if parent is not None:
            nodes[parent][side] = node
        if depth >= limit or len(members) <= 1:
            continue
        here = rows[members]
        low, high = here.min(axis=0), here.max(axis=0)
        varying = np.flatnonzero(high > low)
        if not len(varying):
            continue
        feature = int(rng.choice(varying))
        cut = rng.uniform(low[feature], high[feature])
        if not cut < high[feature]:
            cut = low[feature]
        nodes[node][1:3] = [feature, float(cut)]
        left = here[:, feature] <= cut
        todo += [(members[~left], depth + 1, node, 4), (members[left], depth + 1, node, 3)]
    return pd.DataFrame(nodes, columns=["node_id", "feature", "threshold", "left", "right", "n", "depth"])


@dataclass(frozen=True)
class Side:
    """What one feature decides in a tree. A leaf is a box: inside its lowest and highest code of the feature, a row
    stays; outside, it leaves the path where the interval of the code between the tree's cuts says."""

    feature: int
    low: np.ndarray          # per leaf; of a feature that its path does not test, every code lies inside
    span: np.ndarray         # highest code above the lowest
    cuts: np.ndarray         # codes, ascending
    turns: np.ndarray        # leaf x interval: the node that the row enters instead
    below: np.ndarray        # per node: whether the feature is tested there or below
    any_below: bool          # whether it is at or below one of the turns


@dataclass(frozen=True)
class Walk:
    """A tree over codes: inner nodes from the root down, then leaves."""

    feature: np.ndarray
    cut: np.ndarray          # a code above it goes right
    child: np.ndarray        # of node i at 2i (left) and 2i+1 (right)
    path: np.ndarray         # per leaf
    sides: tuple[Side, ...]

    def reach(self, x: np.ndarray) -> np.ndarray:
        """Per node and row (x: feature x row) the leaf that the row gets to from the node."""
        inner, leaves, n = len(self.feature), len(self.path), x.shape[1]
        kind = np.dtype(np.uint8 if leaves <= 256 else np.uint32)
        to, right, other = np.empty((inner + leaves, n), kind), np.empty(n, bool), np.empty(n, kind)
        to[inner:] = np.arange(leaves)[:, None]
        for node in range(inner - 1, -1, -1):
            near, far = to[self.child[2 * node]], to[self.child[2 * node + 1]]
            np.greater(x[self.feature[node]], self.cut[node], out=right)
            np.bitwise_xor(near, far, out=other)
            np.multiply(other, right.view(np.uint8), out=other)
            np.bitwise_xor(near, other, out=to[node])
        return to

    def entered(self, side: Side, at: np.ndarray, row: np.ndarray, given: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The nodes below ``at`` from which the side's feature, whose code is ``given``, decides no more."""
        flat, n = x.ravel(), x.shape[1]
        on = np.flatnonzero(side.below.take(at))
        node, row, given = at.take(on), row.take(on), given.take(on)
        while len(on):
            f = self.feature.take(node)
            value = np.where(f == side.feature, given, flat.take(f * n + row))
            node = self.child.take(node + node + (value > self.cut.take(node)))
            at[on] = node
            more = np.flatnonzero(side.below.take(node))
            on, node, row, given = on.take(more), node.take(more), row.take(more), given.take(more)
        return at


@dataclass(frozen=True)
class PackedForest:
    """A forest as complete binary trees: child of slot i is 2i+1 (left) or 2i+2 (right)."""

    feature: np.ndarray      # trees x (2^d - 1)
    threshold: np.ndarray    # +inf sends everything left below an early leaf
    path: np.ndarray         # trees x 2^d
    depth: int
    psi: int
    median: np.ndarray
    iqr: np.ndarray

    def scores(self, raw: np.ndarray, tree_counts: tuple[int, ...] = ()) -> np.ndarray:
        """-2^(-mean path / c(psi)) per row; one column per prefix of the forest."""
        counts = tree_counts or (len(self.feature),)
        out = np.empty((len(raw), len(counts)))
        for start in range(0, len(raw), BLOCK):
            part = slice(start, start + BLOCK)
            total = np.zeros(len(out[part]))
            for tree, path in enumerate(self._descend(self.scaled(raw[part]), max(counts))):
                total += path
                for j, count in enumerate(counts):
                    if count == tree + 1:
                        out[part, j] = self._score(total, count)
        return out

    def permuted_scores(self, own: np.ndarray, *donors: np.ndarray) -> tuple[np.ndarray, ...]:
        """Scores as they are, and per donor table and feature with only that feature taken from the donor row."""
        parts = list(self.permuted_parts(self.codes(own), [self.codes(d) for d in donors]))
        if not parts:
            return np.empty(len(own)), *(np.empty(np.shape(own)) for _ in donors)
        plain, permuted = zip(*parts)
        return np.concatenate(plain), *np.concatenate(permuted, axis=2).transpose(1, 2, 0)

    def permuted_parts(self, own: np.ndarray, donors: Sequence[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """`permuted_scores` of rows given as codes, some rows at a time: scores, and feature x donor table x row."""
        for total, changes in self._permuted_paths(own, donors):
            yield self._score(total, len(self.feature)), self._score(total + changes, len(self.feature))

    def _permuted_paths(self, own: np.ndarray, donors: Sequence[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Path lengths of all trees together, and by how much they change with one feature taken from a donor.

        Another value of a feature matters to a tree only outside the box of the row's leaf. There the row leaves its
        path at a known node, and from the next one on it goes where its own values lead, but for nodes that test the
        feature once more.
        """
        for start in range(0, len(own), TRACED):
            part = slice(start, start + TRACED)
            x = np.ascontiguousarray(own[part].T)
            others = np.ascontiguousarray(np.stack([d[part].T for d in donors], axis=1))
            n, total, changes = x.shape[1], np.zeros(x.shape[1]), np.zeros(others.shape)
            row_of = np.tile(np.arange(n), len(donors))
            for tree in self.walks:
                to = tree.reach(x)
                leaf = to[0].astype(np.intp)
                path, ends = tree.path.take(leaf), to.ravel()
                total += path
                for side in tree.sides:
                    codes = others[side.feature]
                    outside = (codes - side.low.take(leaf)) > side.span.take(leaf)     # below the lowest, codes wrap around
                    hit = np.flatnonzero(outside)
                    row, given = row_of.take(hit), codes.ravel().take(hit)
                    turn = leaf.take(row)
                    turn *= len(side.cuts) + 1
                    for cut in side.cuts:
                        turn += given > cut
                    at = side.turns.take(turn)
                    if side.any_below:
                        at = tree.entered(side, at, row, given, x)
                    at *= n
                    at += row
                    change = tree.path.take(ends.take(at))
                    change -= path.take(row)
                    sums = changes[side.feature].ravel()
                    change += sums.take(hit)
                    sums[hit] = change
            yield total, changes

    @cached_property
    def cuts(self) -> tuple[np.ndarray, ...]:
        """All cut points of each feature, ascending."""
        inner = self.threshold < np.inf
        feature, threshold = self.feature[inner], self.threshold[inner]
        return tuple(np.unique(threshold[feature == f]) for f in range(len(self.median)))

    @cached_property
    def code_type(self) -> np.dtype:
        return np.dtype(np.uint16 if max(map(len, self.cuts)) < 1 << 16 else np.uint32)

    def codes(self, raw: np.ndarray) -> np.ndarray:
        """How many of its feature's cut points lie below each value, which is all that trees ask; none below NaN."""
        scaled, out = self.scaled(raw), np.empty(np.shape(raw), self.code_type)
        for f, cuts in enumerate(self.cuts):
            out[:, f] = np.where(np.isnan(scaled[:, f]), 0, np.searchsorted(cuts, scaled[:, f], "left"))
        return out

    @cached_property
    def walks(self) -> tuple[Walk, ...]:
        return tuple(map(self._walk, range(len(self.feature))))

    def _walk(self, tree: int) -> Walk:
        feature, threshold = self.feature[tree], self.threshold[tree]
        order, leaves, todo = {}, [], [(0, ())]       # a leaf's tests: (feature, cut, whether it goes right, the other child)
        cut_at = {}
        for slot in range(self.first_leaf):
            if slot and (slot - 1) // 2 not in order or not threshold[slot] < np.inf:
                continue
            order[slot], f = len(order), int(feature[slot])
            cut_at[slot] = f, int(np.searchsorted(self.cuts[f], threshold[slot]))
        while todo:
            slot, tests = todo.pop()
            if slot not in order:
                leaves.append((slot, tests))
                continue
            todo += [(2 * slot + 1 + side, (*tests, (*cut_at[slot], bool(side), 2 * slot + 2 - side))) for side in (1, 0)]
        place = order | {slot: len(order) + i for i, (slot, _) in enumerate(leaves)}
        child = np.array([place[2 * slot + side] for slot in order for side in (1, 2)], np.intp)
        ends = []
        for slot, _ in leaves:
            while slot < self.first_leaf:             # an early leaf's path stands at the leftmost slot below it
                slot = 2 * slot + 1
            ends.append(slot - self.first_leaf)
        tested, cut = (np.array([cut_at[s][i] for s in order], kind) for i, kind in ((0, np.intp), (1, self.code_type)))
        below = np.zeros((len(place), len(self.median)), bool)
        for node in range(len(order) - 1, -1, -1):
            below[node] = below[child[2 * node]] | below[child[2 * node + 1]]
            below[node, tested[node]] = True
        most = np.iinfo(self.code_type).max
        low, high = ({f: np.full(len(leaves), code, self.code_type) for f in set(tested.tolist())} for code in (0, most))
        cuts = {f: np.unique(cut[tested == f]) for f in low}
        at = {f: {c: i for i, c in enumerate(cuts[f].tolist())} for f in cuts}
        turns = {f: np.repeat(np.arange(len(order), len(place))[:, None], len(cuts[f]) + 1, axis=1) for f in cuts}
        for i, (_, tests) in enumerate(leaves):
            for f, c, right, other in reversed(tests):         # the topmost turn has the last word
                if right:
                    turns[f][i, :at[f][c] + 1] = place[other]
                    low[f][i] = max(low[f][i], c + 1)
                else:
                    turns[f][i, at[f][c] + 1:] = place[other]
                    high[f][i] = min(high[f][i], c)
        sides = (Side(f, low[f], high[f] - low[f], cuts[f], turns[f], below[:, f].copy(), bool(below[turns[f], f].any())) for f in sorted(cuts))
        return Walk(tested, cut, child, self.path[tree][ends], tuple(sides))

    @property
    def first_leaf(self) -> int:
        return (1 << self.depth) - 1

    def scaled(self, raw: np.ndarray) -> np.ndarray:
        return (raw - self.median) / self.iqr

    def _score(self, total: np.ndarray, trees: int) -> np.ndarray:
        return -np.exp2(-total / (trees * max(float(mean_path(self.psi)), 1e-12)))

    def _descend(self, x: np.ndarray, trees: int):
        """Per tree: each row's path length."""
        flat, base = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        at, place = np.empty(len(x), np.intp), np.empty(len(x), np.intp)
        value, cut, right = np.empty(len(x)), np.empty(len(x)), np.empty(len(x), bool)
        for tree in range(trees):
            feature, threshold = self.feature[tree], self.threshold[tree]
            at.fill(0)
            for _ in range(self.depth):
                np.take(feature, at, out=place, mode="clip")
                np.add(place, base, out=place)
                np.take(flat, place, out=value, mode="clip")
                np.take(threshold, at, out=cut, mode="clip")
                np.greater(value, cut, out=right)
                np.add(at, at, out=at)
                np.add(at, 1, out=at)
                np.add(at, right, out=at)
            yield self.path[tree].take(at - self.first_leaf, mode="clip")


def pack(nodes: pd.DataFrame, psi: int, median, iqr) -> PackedForest:
    depth = depth_limit(psi)
    trees = nodes["tree_id"].nunique()
    inner, leaves = (1 << depth) - 1, 1 << depth
    feature = np.zeros((trees, inner), dtype=np.intp)
    threshold = np.full((trees, inner), np.inf)
    path = np.zeros((trees, leaves))
    for t, (_, tree) in enumerate(nodes.groupby("tree_id", sort=True)):
        tree = tree.sort_values("node_id")
        f, c, lft, rgt, size, level = (tree[k].to_numpy() for k in
                                       ("feature", "threshold", "left", "right", "n", "depth"))
        value = level + mean_path(size)
        todo = [(0, 0, 0)]
        while todo:
            node, slot, d = todo.pop()
            if f[node] == LEAF:
                slot = ((slot + 1) << (depth - d)) - 1  # leftmost slot below on the last level
                path[t, slot - inner] = value[node]
            else:
                feature[t, slot], threshold[t, slot] = f[node], c[node]
                todo += [(lft[node], 2 * slot + 1, d + 1), (rgt[node], 2 * slot + 2, d + 1)]
    return PackedForest(feature, threshold, path, depth, psi,
                        np.asarray(median, float), np.asarray(iqr, float))
