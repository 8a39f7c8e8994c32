"""Benchmark items inside documents, found by pigeonhole pieces and checked by bit-parallel edit distance.

Texts and items are lower-cased and every run of white space becomes one space. An item of n characters may
differ by k = floor(rate * n) edits. Cut into k + 1 pieces, at least one piece of any such copy is unharmed;
one automaton over all pieces finds those in a single pass over each whole text. Around each hit the
bit-parallel distance of the whole item decides, so the result is exactly the pairs within k edits.

The benchmark is dealt into blocks of a bounded number of characters; each block is one pass over the
documents with that block's items on every worker. No pair of document and item is made without a hit.

Items shorter than ``shortest`` normal characters identify little: by default they are not searched; with
``short_exact`` they must occur letter for letter, not inside a longer word. Null items and items without a
letter are in no document. Null and empty texts contain nothing. Null ids are carried; a repeated row gives its pairs again, equal
benchmark items each give theirs; empty tables give no pairs; other columns are ignored.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

RATE = 0.08
SHORTEST = 20
BLOCK_CHARS = 4_000_000

PAIRS = "doc_id long, item_id long, distance int, start long, end long"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """The item in budget + 1 parts of nearly equal length, with their places."""
    n = budget + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def letters(item: str) -> dict[str, int]:
    """For each letter the places it has in the item, as bits."""
    found: dict[str, int] = {}
    for i, c in enumerate(item):
        found[c] = found.get(c, 0) | 1 << i
    return found


def nearest(where: dict[str, int], m: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """Least edits between the m letters and any part of `text` (a prefix if anchored), and where it first ends."""
    full, last = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for i, c in enumerate(text, 1):
        eq = where.get(c, 0)
        same = (((eq & up) + up) ^ up) | eq | down
        plus = down | ~(same | up) & full
        minus = up & same
        if plus & last:
            score += 1
        elif minus & last:
            score -= 1
        plus = (plus << 1 | anchored) & full
        minus = minus << 1 & full
        up = minus | ~((eq | down) | plus) & full
        down = plus & (eq | down)
        if score < best:
            best, end = score, i
    return best, end


def alone(text: str, start: int, end: int) -> bool:
    """Whether no word goes on over either end of the span."""
    return not (start and text[start - 1].isalnum() and text[start].isalnum()
                or end < len(text) and text[end].isalnum() and text[end - 1].isalnum())


class Items:
    """An automaton over the pieces of some items."""

    def __init__(self, items: list[tuple[int, str]], rate: float, shortest: int = SHORTEST):
        import ahocorasick

        self.items = []
        at: dict[str, list[tuple[int, int]]] = {}
        for k, (item_id, text) in enumerate(items):
            budget = int(rate * len(text)) if len(text) >= shortest else None       # None: letter for letter
            self.items.append((item_id, text, budget, letters(text), letters(text[::-1])))
            for offset, piece in pieces(text, budget or 0):
                at.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def found(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of the best copy of each item that has one in normal text."""
        starts: dict[int, set[int]] = {}
        for last, (size, places) in self.automaton.iter(text):
            for k, offset in places:
                starts.setdefault(k, set()).add(last + 1 - size - offset)
        out = []
        for k, likely in starts.items():
            item_id, item, budget, where, backwards = self.items[k]
            n, best, done = len(item), None, None
            if budget is None:
                own = next((s for s in sorted(likely) if alone(text, s, s + n)), None)
                if own is not None:
                    out.append((item_id, 0, own, own + n))
                continue
            spans: list[list[int]] = []
            for start in sorted(likely):
                if spans and start - spans[-1][1] <= budget:
                    spans[-1][1] = start
                else:
                    spans.append([start, start])
            for first, final in spans:
                low = max(0, first - budget)
                distance, end = nearest(where, n, text[low:final + n + budget])
                if distance <= budget and (best is None or distance < best[0]):
                    best, done = (distance, low + end), low
                    if distance == 0:
                        break
            if best is not None:
                distance, end = best
                _, length = nearest(backwards, n, text[done:end][::-1], anchored=True)
                out.append((item_id, distance, end - length, end))
        return out


_MADE: dict[str, Items] = {}


def _items(block, rate: float, shortest: int) -> Items:
    name, items = block.value
    if name not in _MADE:
        _MADE.clear()
        _MADE[name] = Items(items, rate, shortest)
    return _MADE[name]


def _blocks(benchmark: DataFrame, shortest: int, block_chars: int):
    """The items in blocks of about `block_chars` characters, each read when it is needed."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").filter("text is not null")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // block_chars))
    for i in range(n):
        mine = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        rows = [(r[0], normal(r[1])) for r in mine.collect()]
        rows = [r for r in rows if len(r[1]) >= shortest]
        if rows:
            yield benchmark.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, rows))


def pairs(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, shortest: int = SHORTEST,
          block_chars: int = BLOCK_CHARS, short_exact: bool = False) -> DataFrame:
    """`doc_id, item_id, distance, start, end` of every document (doc_id, text) and item (item_id, text) with
    a copy within the budget: its best place in the normal text, the first of equally good ones."""
    ship(docs.sparkSession)

    def search(block):
        def run(batches):
            items = _items(block, rate, shortest)
            for batch in batches:
                out = [(doc, *hit) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1))
                       for hit in items.found(normal(text.as_py()))]
                columns = list(zip(*out)) or [()] * 5
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                                 names=["doc_id", "item_id", "distance", "start", "end"])
        return run

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    found = None
    for block in _blocks(benchmark, 1 if short_exact else shortest, block_chars):
        part = rows.mapInArrow(search(block), PAIRS)
        found = part if found is None else found.union(part)
    return rows.sparkSession.createDataFrame([], PAIRS) if found is None else found


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, shortest: int = SHORTEST,
                  block_chars: int = BLOCK_CHARS, short_exact: bool = False) -> DataFrame:
    """The rows of `docs` whose text holds no item; all columns stay, nothing is shuffled."""
    ship(docs.sparkSession)

    def keep(block):
        def run(batches):
            items = _items(block, rate, shortest)
            for batch in batches:
                text = batch.column(batch.schema.get_field_index("text"))
                yield batch.filter(pa.array([not items.found(normal(t.as_py())) for t in text], pa.bool_()))
        return run

    for block in _blocks(benchmark, 1 if short_exact else shortest, block_chars):
        docs = docs.mapInArrow(keep(block), docs.schema)
    return docs
