import hashlib
import random
import zlib
from collections import defaultdict

from trackloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, key string"


def plain(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    lists = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    paths = {}
    for c, own in lists.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(lists.get(c - c % 5, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def below(p):
        leaves, saved, todo = 0, 0, [p]
        while todo:
            q = todo.pop()
            leaves += not children[q]
            saved += (len(members[q]) - 1) * (len(q[-1][1].encode()) if q else 0)
            todo += children[q]
        return leaves, saved

    out = []
    for p, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(paths[c]) == len(p))))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children[p]), *below(p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found(spark, rows, **how):
    df = spark.createDataFrame([(*r, 0, "k") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in prefix_trie.trie(df, **how).select(*COLUMNS).collect()), key=str)


def test_odd_rows(spark):
    rows = [(0, 1, "user", "hi"), (0, None, None, None), (0, 2, "bot", "é"), (1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 0, "a", "z"),
            (2, 5, "", ""), (None, 1, "user", "lost"), (7, 1, "user", "hi"), (7, 1, "user", "hi"), (13, 3, "x", "y"), (-4, 1, "user", "hi"), (5, 1, "user", "hi")]
    rows = [r for r in rows if r[0] != -4]
    assert found(spark, rows) == plain(rows)


def test_shared_and_lonely_long_conversations(spark):
    """Blocks of two and three columns: long copies, branches in every block, and chains that nobody shares."""
    rng = random.Random(3)
    rows = []
    for c in range(40):
        n = rng.choice([0, 1, 3, 7, 20])
        same = [("user", "abcdefgh"[i % 8]) for i in range(n)]
        if rng.random() < 0.5 and n:
            same[rng.randrange(n)] = ("bot", str(rng.randrange(2)))
        rows += [(c, i, *t) for i, t in enumerate(same)]
    rows += [(200, i, "user", f"own {i}") for i in range(60)]
    rows += [(c, i, "user", "long copy") for c in (300, 301) for i in range(30)]
    assert found(spark, rows, widths=(2, 3)) == plain(rows)


def test_empty(spark):
    assert found(spark, []) == [] and found(spark, [(None, 1, "a", "b")]) == []


def test_digest_over_many_stretches(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 7)
    rows = [(c, 0, "user", "same " * 2000) for c in range(0, 2000, 5)]
    assert found(spark, rows) == plain(rows)
