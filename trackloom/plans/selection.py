"""Exact order statistics and quantiles at any size, without sorting the data.

``percentile_approx`` gives values that bracket each wanted rank; one aggregate counts the rows
below and inside every bracket; the next round sketches only the rows inside. A handful of
rounds leaves brackets small enough to read out. All columns and ranks share each scan, and the
driver only sees one small row per round. Small inputs use the built-in ``percentile``.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.config import DEFAULT, TrackConfig


@dataclass
class _Target:
    column: str
    rank: int                 # zero-based among the column's non-null values
    below: int
    inside: int
    low: Any = None           # exclusive bounds; None: open end
    high: Any = None
    value: Any = None
    done: bool = False

    @property
    def bracket(self):
        return self.column, self.low, self.high

    def contains(self) -> str:
        tests = [f"`{self.column}` IS NOT NULL"]
        if self.low is not None:
            tests.append(f"`{self.column}` > {_literal(self.low)}")
        if self.high is not None:
            tests.append(f"`{self.column}` < {_literal(self.high)}")
        return "(" + " AND ".join(tests) + ")"


def _literal(value: Any) -> str:
    """SQL text of a number; hundreds of conditions are far cheaper to build as text."""
    if isinstance(value, float):
        return f"{value!r}D" if math.isfinite(value) else f"double('{value}')"
    return f"{value}L"


def order_statistics(df: DataFrame, wanted: Sequence[tuple[str, int]],
                     cfg: TrackConfig = DEFAULT,
                     counts: Mapping[str, int] | None = None) -> list[Any]:
    """Exact value at each (column, zero-based rank); None where the rank does not exist."""
    return [t.value for t in _select(df, wanted, cfg, counts)]


def _select(df: DataFrame, wanted: Sequence[tuple[str, int]], cfg: TrackConfig,
            counts: Mapping[str, int] | None = None) -> list[_Target]:
    """Finished targets: the value, how many rows lie below it and how many are equal to it."""
    columns = list(dict.fromkeys(c for c, _ in wanted))
    df = df.select(*columns)
    if counts is None:
        counts = df.agg(*[F.count(c).alias(c) for c in columns]).first().asDict()
    targets = [_Target(c, r, 0, counts[c], done=not 0 <= r < counts[c]) for c, r in wanted]
    accuracy = cfg.sketch_accuracy
    while pending := [t for t in targets if not t.done and t.inside > cfg.bracket_rows]:
        before = sum(t.inside for t in pending)
        _narrow(df, pending, accuracy)
        if sum(t.inside for t in pending if not t.done) > before // 2:
            accuracy *= 10  # a sketch that hardly helps gets finer
    _read_out(df, [t for t in targets if not t.done])
    return targets


def _narrow(df: DataFrame, pending: list[_Target], accuracy: int) -> None:
    """One sketch pass and one counting pass over the rows inside the pending brackets."""
    shared = defaultdict(list)
    for t in pending:
        shared[t.bracket].append(t)
    rows = _inside_any(df, [group[0] for group in shared.values()])
    slack = 2.0 / accuracy
    sketches = []
    for i, group in enumerate(shared.values()):
        points = []
        for t in group:
            at = (t.rank - t.below) / max(t.inside - 1, 1)
            points += [max(0.0, at - slack), min(1.0, at + slack)]
        sketches.append(F.expr(
            f"percentile_approx(CASE WHEN {group[0].contains()} THEN `{group[0].column}` END, "
            f"array({', '.join(map(repr, points))}), {accuracy}) AS s{i}"))
    found = rows.agg(*sketches).first()
    # Cut every bracket at all values its sketch returned. Odd codes are rows equal to a cut
    # value, even codes the open intervals between; one narrow shuffle counts them all.
    cuts = [sorted(set(found[i])) for i in range(len(shared))]
    entries = []
    for i, group in enumerate(shared.values()):
        steps = [f"int(`{group[0].column}` >= {c}) + int(`{group[0].column}` > {c})"
                 for c in map(_literal, cuts[i])]
        entries.append(f"CASE WHEN {group[0].contains()} THEN "
                       f"struct({i} AS slot, {' + '.join(steps)} AS code) END")
    tally: dict[int, dict[int, int]] = defaultdict(dict)
    for row in (rows.selectExpr(f"explode(array_compact(array({', '.join(entries)}))) AS e")
                    .groupBy("e.slot", "e.code").count().collect()):  # brackets * cuts rows
        tally[row["slot"]][row["code"]] = row["count"]
    for i, group in enumerate(shared.values()):
        for t in group:
            seen = t.below
            for code in range(2 * len(cuts[i]) + 1):
                held = tally[i].get(code, 0)
                if t.rank < seen + held:
                    break
                seen += held
            gap = code // 2
            if code % 2:
                t.value, t.below, t.inside, t.done = cuts[i][gap], seen, held, True
            else:
                t.low = cuts[i][gap - 1] if gap else t.low
                t.high = cuts[i][gap] if gap < len(cuts[i]) else t.high
                t.below, t.inside = seen, held


def _inside_any(df: DataFrame, targets: list[_Target]) -> DataFrame:
    return df.filter(" OR ".join(dict.fromkeys(t.contains() for t in targets)))


def _read_out(df: DataFrame, targets: list[_Target]) -> None:
    """Brackets now hold at most ``bracket_rows`` rows each: count their values and walk."""
    if not targets:
        return
    groups = {t.bracket: t for t in targets}
    slots = {bracket: i for i, bracket in enumerate(groups)}
    held: dict[int, list] = defaultdict(list)
    for kind in dict.fromkeys(dict(df.dtypes)[t.column] for t in targets):
        same = [t for t in groups.values() if dict(df.dtypes)[t.column] == kind]
        entries = ", ".join(
            f"CASE WHEN {t.contains()} THEN struct({slots[t.bracket]} AS slot, `{t.column}` AS value) END"
            for t in same)
        rows = (_inside_any(df, same)
                .selectExpr(f"explode(array_compact(array({entries}))) AS e")
                .groupBy("e.slot", "e.value").count())
        for row in rows.collect():  # bounded: brackets * bracket_rows
            held[row["slot"]].append((row["value"], row["count"]))
    for t in targets:
        seen = t.below
        for value, count in sorted(held[slots[t.bracket]]):
            if seen <= t.rank < seen + count:
                t.value, t.below, t.inside, t.done = value, seen, count, True
                break
            seen += count


def quantiles(df: DataFrame, wanted: Mapping[str, Sequence[float]],
              cfg: TrackConfig = DEFAULT) -> dict[str, list[float | None]]:
    """Exact linearly interpolated quantiles of several columns, as driver-side numbers."""
    columns = list(wanted)
    df = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first().asDict()
    if max(counts.values()) <= cfg.small_sort_rows:
        return _small_quantiles(df, wanted)
    ranks = []
    for c in columns:
        for q in wanted[c]:
            at = q * max(counts[c] - 1, 0)
            ranks += [(c, math.floor(at)), (c, math.ceil(at))]
    values = iter(order_statistics(df, ranks, cfg, counts))
    out: dict[str, list[float | None]] = {c: [] for c in columns}
    for c in columns:
        for q in wanted[c]:
            low, high, at = next(values), next(values), q * max(counts[c] - 1, 0)
            # The formula of the built-in percentile, so that both ways give the same digits.
            flat = low is None or low == high or at == math.floor(at)
            out[c].append(low if flat else (math.ceil(at) - at) * low + (at - math.floor(at)) * high)
    return out


def _small_quantiles(df: DataFrame, wanted: Mapping[str, Sequence[float]]) -> dict:
    """Built-in percentile with the columns as groups, so that they share the tasks."""
    points = sorted({q for qs in wanted.values() for q in qs})
    entries = ", ".join(f"struct('{c}' AS name, `{c}` AS value)" for c in wanted)
    rows = (df.selectExpr(f"explode(array({entries})) AS e").groupBy("e.name")
              .agg(F.percentile("e.value", points).alias("at")).collect())  # one per column
    at = {r["name"]: r["at"] for r in rows}
    return {c: [at[c][points.index(q)] if at.get(c) else None for q in qs]
            for c, qs in wanted.items()}


def quantile(df: DataFrame, column: str, q: float, cfg: TrackConfig = DEFAULT) -> Column:
    """One quantile as a Column: a scalar subquery for few rows, else an exact literal; both give the same digits."""
    narrow = df.select(F.col(column).cast("double").alias(column))
    if narrow.count() <= cfg.small_sort_rows:
        return narrow.agg(F.percentile(column, q).alias("q")).scalar()
    return F.lit(quantiles(narrow, {column: [q]}, cfg)[column][0]).cast("double")


def row_keys_at(df: DataFrame, ranks: Sequence[int], order: Sequence[str], cfg: TrackConfig = DEFAULT,
                count: int | None = None) -> list[tuple | None]:
    """Ordering keys of the rows at several zero-based ranks; timestamps are returned in microseconds.

    The keys are found column by column: the values of the first column at the ranks, then, among the
    rows sharing each of them, the values of the next. All ranks share the scans of a column, so that
    the scans are those of the rank that takes most rounds. ``count``: non-null values of the
    first column, if known. A rank that does not exist gives None.
    """
    keyed = df.select(*[_number(df, c) for c in order])
    found: dict[int, tuple[tuple, int, int]] = {      # rank: (key so far, rank among equal rows, their number)
        r: ((), r, count) for r in dict.fromkeys(ranks) if r >= 0}
    for depth, column in enumerate(order):
        slots = {key: f"_k{i}" for i, key in enumerate(dict.fromkeys(key for key, _, _ in found.values()))}
        counts = {slots[key]: held for key, _, held in found.values()}
        rows = keyed.selectExpr(*[f"{_among(order[:depth], key, column)} AS {name}" for key, name in slots.items()])
        targets = _select(rows, [(slots[key], at) for key, at, _ in found.values()], cfg,
                          None if None in counts.values() else counts) if found else []
        found = {rank: ((*key, t.value), t.rank - t.below, t.inside)
                 for (rank, (key, _, _)), t in zip(found.items(), targets) if t.value is not None}
    return [found[r][0] if r in found else None for r in ranks]


def _among(columns: Sequence[str], key: tuple, out: str) -> str:
    """SQL text: column ``out`` of the rows that share the key, null elsewhere."""
    tests = " AND ".join(f"`{c}` = {_literal(v)}" for c, v in zip(columns, key))
    return f"CASE WHEN {tests} THEN `{out}` END" if tests else f"`{out}`"


def row_key_at(df: DataFrame, rank: int, order: Sequence[str],
               cfg: TrackConfig = DEFAULT) -> tuple | None:
    """``row_keys_at`` for one rank."""
    return row_keys_at(df, [rank], order, cfg)[0]


def _number(df: DataFrame, column: str) -> Column:
    kind = dict(df.dtypes)[column]
    return (F.unix_micros(column) if kind.startswith("timestamp") else F.col(column)).alias(column)


def before_key(df: DataFrame, order: Sequence[str], key: tuple | None) -> Column:
    """True for rows strictly before the key; always true for a missing key."""
    if key is None:
        return F.lit(True)
    test = F.lit(False)
    for column, value in reversed(list(zip(order, key))):
        here = F.timestamp_micros(F.lit(value)) if dict(df.dtypes)[column] == "timestamp" else F.lit(value)
        test = (F.col(column) < here) | ((F.col(column) == here) & test)
    return test
