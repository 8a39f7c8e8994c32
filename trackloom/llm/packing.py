"""Best-fit packing of token sequences by length patterns.

Documents are encoded whole; only those above the capacity are cut, into full pieces after a first piece
that takes the remainder. The histogram of piece lengths, at most ``capacity`` numbers, decides the packing:

1. patterns are all multisets of up to three lengths that occur and fill a sequence exactly;
2. non-negative least squares fits repeat counts of the patterns to the histogram (accelerated projected
   gradient), and the counts are rounded, shares passing on among patterns of one longest length, and cut to what
   the histogram has left;
3. the rest goes length by length, longest first, into the open pattern with the least sufficient space.

A plan is thus a list of patterns with repeats, whose size depends on the capacity and not on the number of
documents. Pieces of one length are interchangeable: their rank among that length, from a count per part of
the input, names their pattern, repeat and place. Nothing but the histogram and the plan is on the driver.

Null text counts as empty, and becomes the end id alone; null ids and repeated rows are kept, each row as a
document of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keyed, materialize, partition_id, ship

PIECES = "part int, nth long, doc_id long, row long, piece int, start long, length int, ids_crc32 long"


def _pieces(tokenizer: str, end_id: int, capacity: int, with_ids: bool):
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * with_ids
    names = ["part", "nth", "doc_id", "row", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        from .tokenizer import encoder

        encode, end = encoder(tokenizer).encode_one, np.asarray([end_id], "<u4").tobytes()
        part, met = partition_id(), [0] * (capacity + 1)

        def made(columns):
            return pa.RecordBatch.from_arrays([pa.array([part] * len(columns[0]), pa.int32()), *(pa.array(c, k) for c, k in zip(columns, kinds[1:]))], names=names)

        for batch in batches:
            out, size = [[] for _ in kinds[1:]], 0
            nth, docs, rows, pieces, starts, lengths, sums, *kept = out
            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                total, at, piece = len(ids) // 4, 0, 0
                while at < total:
                    length = (total - at) % capacity or capacity
                    own = ids if length == total else ids[4 * at:4 * (at + length)]
                    nth.append(met[length])
                    docs.append(doc)
                    rows.append(row)
                    pieces.append(piece)
                    starts.append(at)
                    lengths.append(length)
                    sums.append(crc32(own))
                    if kept:
                        kept[0].append(own)
                        size += len(own)
                    met[length] += 1
                    at, piece = at + length, piece + 1
                if size > 1 << 22:
                    yield made(out)
                    out, size = [[] for _ in kinds[1:]], 0
                    nth, docs, rows, pieces, starts, lengths, sums, *kept = out
            if nth:
                yield made(out)

    return run


def exact_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of three lengths, longest first, that sum to the capacity; zeros fill up shorter patterns."""
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    have[0] = True
    a, b = np.meshgrid(np.flatnonzero(have), np.flatnonzero(have), indexing="ij")
    c = capacity - a - b
    fits = (a >= b) & (c >= 0) & (c <= b)
    a, b, c = a[fits], b[fits], c[fits]
    return np.stack([a, b, c], axis=1)[have[c]]


def fit_repeats(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeats x >= 0 that minimise the squared difference of used and available lengths, each length in
    proportion to its share, so that rare lengths are fitted as well as frequent ones."""
    weight = 1 / np.sqrt(np.maximum(counts, 1.0))
    weight[0] = 0
    sides = [patterns[:, k] for k in range(3)]

    def used(x):
        return sum(np.bincount(s, x, len(counts)) for s in sides)

    # Power iteration bounds the curvature.
    v = np.ones(len(patterns))
    top = 1.0
    for _ in range(12):
        v = sum((weight**2 * used(v))[s] for s in sides)
        top = np.linalg.norm(v)
        v /= top or 1.0
    step = 1 / (1.1 * top) if top else 1.0
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        gradient = weight**2 * (used(y) - counts)
        new = np.maximum(0, y - step * sum(gradient[s] for s in sides))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that use every length exactly as often as the histogram has it."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    left = counts.copy()
    made: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        made.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    patterns = exact_patterns(np.flatnonzero(left), capacity)
    patterns = patterns[patterns[:, 1] > 0]
    whole = left.copy()
    if len(patterns):
        for lengths, repeats in rounded(patterns, fit_repeats(patterns, left.astype(float)), left):
            made.append((lengths, repeats))
    fitted = made + best_fit(left, capacity)
    if sum(r for _, r in fitted) > -(-int((counts * np.arange(capacity + 1)).sum()) // capacity):
        # What is left may fit worse without the lengths that went into patterns.
        plain = ([((capacity,), int(counts[capacity]))] if counts[capacity] else []) + best_fit(whole, capacity)
        if sum(r for _, r in plain) < sum(r for _, r in fitted):
            return plain
    return fitted


def rounded(patterns: np.ndarray, x: np.ndarray, left: np.ndarray):
    """Whole repeats of the patterns, taken out of `left`. Patterns go by their lengths, longest first, and what
    rounding leaves of one goes to the next of the same longest length, so that many small shares make whole ones."""
    share, longest = 0.0, -1
    for pattern, part in zip(patterns.tolist(), x.tolist()):
        if pattern[0] != longest:
            share, longest = 0.5, pattern[0]
        share += part
        repeats = int(share)
        if repeats < 1:
            continue
        lengths = Counter(v for v in pattern if v)
        repeats = min([repeats, *(int(left[v]) // k for v, k in lengths.items())])
        if repeats > 0:
            share -= repeats
            for v, k in lengths.items():
                left[v] -= k * repeats
            yield tuple(v for v in pattern if v), repeats


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: whole groups of equal open sequences move at once."""
    groups: dict[int, list[list]] = {}     # space left -> [lengths, repeats]
    spaces: list[int] = []

    def put(space, lengths, repeats):
        if space not in groups:
            groups[space] = []
            insort(spaces, space)
        groups[space].append([lengths, repeats])

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                each = capacity // length
                if n >= each:
                    put(capacity - each * length, (length,) * each, n // each)
                if n % each:
                    put(capacity - n % each * length, (length,) * (n % each), 1)
                n = 0
                continue
            space = spaces[at]
            lengths, repeats = groups[space].pop()
            if not groups[space]:
                del groups[space], spaces[at]
            each = min(space // length, max(1, n // repeats))
            took = min(repeats, n // each)
            put(space - each * length, lengths + (length,) * each, took)
            if repeats > took:
                put(space, lengths, repeats - took)
            n -= took * each
    return [(tuple(lengths), repeats) for group in groups.values() for lengths, repeats in group]


def _slots(made: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length: rows of (first rank, first sequence, offset), ordered by first rank."""
    used: Counter = Counter()
    rows: dict[int, list] = {}
    sequence = 0
    for lengths, repeats in made:
        offset = 0
        for length in lengths:
            rows.setdefault(length, []).append((used[length], sequence, offset))
            used[length] += repeats
            offset += length
        sequence += repeats
    return {length: np.array(r, np.int64) for length, r in rows.items()}


def _place(slots):
    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for one in np.unique(length):
                rows, mine = slots.value[int(one)], length == one
                at = np.searchsorted(rows[:, 0], rank[mine], side="right") - 1
                sequence[mine] = rows[at, 1] + rank[mine] - rows[at, 0]
                offset[mine] = rows[at, 2]
            keep = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(sequence), pa.array(offset)],
                                             names=[*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """A row per piece of `docs` (doc_id, text): doc_id, row, piece, start, length, ids_crc32, sequence_id,
    offset, and `ids` (little-endian unsigned 32-bit) on request."""
    spark = docs.sparkSession
    ship(spark)
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", "text")
    pieces = materialize(rows.mapInArrow(_pieces(tokenizer, end_id, capacity, with_ids), PIECES + ", ids binary" * with_ids), "pieces")
    counts = materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "length-counts")
    total = counts.groupBy("length").agg(F.sum("n")).collect()          # at most `capacity` rows
    slots = spark.sparkContext.broadcast(_slots(plan(dict(map(tuple, total)), capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    names = ["doc_id", "row", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    ranked = pieces.select("part", "nth", *names).join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth")).drop("part", "nth", "base")
    schema = "doc_id long, row long, piece int, start long, length int, ids_crc32 long" + ", ids binary" * with_ids
    return ranked.select(*names, "rank").mapInArrow(_place(slots), schema + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """Packed pieces with ids, put together: sequence_id, doc_ids, lengths and ids. A group holds one
    sequence, so at most `capacity` ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"),
        F.aggregate("p.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))
