"""Prefix trie of conversations by ROLLUP over positional turn columns.

Every distinct sequence of first turns is a node. A conversation is a row of turn-id columns t1 .. tw; a Spark SQL
``ROLLUP`` over them aggregates all prefixes together, and ``grouping_id`` tells a row's depth. Longer conversations
go on in a further block of columns, keyed by the node at which the block before ended; blocks widen. A
conversation that is alone on its node shares nothing further down: the rest of it is one chain, written from its
turns without a block. So there are as many blocks as the longest shared beginning needs, however long single
conversations are. A second ``ROLLUP`` over the nodes adds up what lies below each, from the last block to the first.

Turns are put in order by ranges of (conv_id, turn), so a conversation with a third of all rows spreads over many
tasks; nothing gathers more of one than a block's columns. A turn's id is the SHA-256 digest of role and text with its
length in bytes, taken before any shuffle. The digest over a node's ending members is a running one over sorted
stretches of ids, in constant memory; by its nature, one node's ids pass through one task in order.

Null roles and texts count as empty; null turns come first; rows of one conversation and turn are ordered by role,
then text; repeated rows are turns of their own; rows of null conv_id take no part. An empty table has no nodes,
not even a root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.plans.numbering import positions

from .common import materialize, ship

WIDTHS = (8, 16, 32)      # columns of the first, second and every further block
STRETCH = 1 << 16         # ids of one stretch of a digest
ROOT = "root"


def turns(conversations: DataFrame) -> DataFrame:
    """`conv_id, at, t, size`: turn ids in order, at from 1; size is the text's bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256)
    plain = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                 role.alias("role"), text.alias("text")).filter("conv_id is not null")
    # Ties go by role and text; the digest alone tells equal turns from others.
    rows = plain.select("conv_id", "turn", "role", "text", digest.alias("t"), F.octet_length("text").cast("long").alias("size"))
    return materialize(positions(rows, "conv_id", ["turn", "role", "text"], "at", start=1).select("conv_id", "at", "t", "size"), "turns")


def rebuilt(rows: DataFrame, family: int = 5, longest: int = 9) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): each takes its first h turns from the first conversation of its family, with
    h = crc32(conv_id) % longest, and goes on with its own turns after its first h."""
    convs = rows.groupBy("conv_id").agg(F.max("at").alias("n"))
    head = convs.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % family).alias("base"),
                        (F.crc32(F.col("conv_id").cast("string")) % longest).alias("h"))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    head = head.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    head = materialize(head.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")), "rebuilt")
    begun = (rows.filter(F.col("at") < longest).withColumnRenamed("conv_id", "base")
                 .join(head.select("conv_id", "base", "taken"), "base").filter("at <= taken"))
    own = rows.join(head.select("conv_id", "h", "taken"), "conv_id").filter("at > h").withColumn("at", F.col("at") - F.col("h") + F.col("taken"))
    columns = ["conv_id", "at", "t", "size"]
    return head.select("conv_id", "n"), materialize(begun.select(*columns).unionByName(own.select(*columns)), "rebuilt-turns")


def _names(width: int) -> list[str]:
    return [f"t{i}" for i in range(1, width + 1)]


def _nodes(block: DataFrame, start: int, width: int) -> DataFrame:
    """All nodes of a block by one ROLLUP: depth, prior, t1.., n_convs, conv_id."""
    names = _names(width)
    found = block.sparkSession.sql(f"""
        SELECT prior, {', '.join(names)}, {width} - bit_count(grouping_id()) AS level,
               count(*) AS n_convs, min(conv_id) AS conv_id
        FROM {{block}} GROUP BY prior, ROLLUP({', '.join(names)})""", block=block)
    # Shorter conversations appear again on deeper levels with a null turn; those are no nodes.
    last = F.get(F.array(*names), (F.col("level") - 1).cast("int"))
    real = found.filter((F.col("level") > 0) & last.isNotNull())
    size = F.element_at(F.split(last, ":"), 2).cast("long")
    upto = lambda less: F.array_join(F.slice(F.array(*names), F.lit(1), (F.col("level") - less).cast("int")), " ")
    parent = F.when(F.col("level") == 1, F.col("prior")).otherwise(F.sha2(F.concat_ws(" ", "prior", upto(1)), 256))
    return real.select("prior", *names, "level", (F.lit(start) + F.col("level")).cast("long").alias("depth"), "n_convs", "conv_id",
                       F.sha2(F.concat_ws(" ", "prior", upto(0)), 256).alias("key"), parent.alias("parent"),
                       ((F.col("n_convs") - 1) * size).alias("saved"))


def _below(nodes: DataFrame, width: int) -> DataFrame:
    """`key, n_leaves, saved_tokens` over each node's subtree, by one ROLLUP over the nodes of a block; also under
    the key of the node at which the block begins."""
    names = _names(width)
    found = nodes.sparkSession.sql(f"""
        SELECT prior, {', '.join(names)}, {width} - bit_count(grouping_id()) AS level,
               sum(leaves) AS n_leaves, sum(saved) AS saved_tokens
        FROM {{nodes}} GROUP BY prior, ROLLUP({', '.join(names)})""", nodes=nodes)
    last = F.get(F.array(*names), (F.col("level") - 1).cast("int"))
    upto = F.array_join(F.slice(F.array(*names), F.lit(1), F.col("level").cast("int")), " ")
    key = F.when(F.col("level") == 0, F.col("prior")).otherwise(F.sha2(F.concat_ws(" ", "prior", upto), 256))
    return found.filter((F.col("level") == 0) | last.isNotNull()).select((F.col("level") == 0).alias("outside"), key.alias("key"), "n_leaves", "saved_tokens")


def _stretches(batches):
    """Comma-joined stretches of sorted ids, each of one node and one task."""
    node, ids, first = None, [], None
    names = ["key", "first", "ids"]

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
                                           pa.array([r[2] for r in rows], pa.string())], names=names)

    for batch in batches:
        done = []
        for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key != node or len(ids) >= STRETCH:
                if ids:
                    done.append((node, first, ",".join(ids)))
                node, ids, first = key, [], conv
            ids.append(str(conv))
        if done:
            yield made(done)
    if ids:
        yield made([(node, first, ",".join(ids))])


def _digests(batches):
    """SHA-256 of each node's stretches, which come sorted."""
    node, running, out = None, None, []
    names = ["key", "ends_sha256"]

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=names)

    for batch in batches:
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key != node:
                if running is not None:
                    out.append((node, running.hexdigest()))
                node, running = key, hashlib.sha256()
            else:
                running.update(b",")
            running.update(ids.encode())
        if len(out) > 10_000:
            yield made(out)
            out = []
    if running is not None:
        out.append((node, running.hexdigest()))
    if out:
        yield made(out)


def digests(ends: DataFrame) -> DataFrame:
    """`key, ends_sha256` over the numerically ascending conv_ids of each key."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = ends.select("key", "conv_id").repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    stretches = materialize(cut.mapInArrow(_stretches, "key string, first long, ids string"), "stretches")
    return stretches.repartition(parts, "key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(_digests, "key string, ends_sha256 string")


def trie(conversations: DataFrame, family: int = 5, longest: int = 9, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    ship(spark)
    heads, rows = rebuilt(turns(conversations), family, longest)
    rows = rows.select("conv_id", "at", F.concat_ws(":", "t", F.col("size").cast("string")).alias("t"))

    # Forward: the nodes of each block, and where its conversations end.
    members = materialize(heads.select("conv_id", "n", F.lit(ROOT).alias("prior")), "members")
    empty = members.filter("n = 0").select(F.lit(ROOT).alias("key"), "conv_id")
    blocks, ends, chains = [], [empty], []
    start, alone = 0, None
    while True:
        longer = members.filter(F.col("n") > start)
        if longer.isEmpty():
            break
        width = widths[min(len(blocks), len(widths) - 1)]
        names = _names(width)
        inside = rows.filter((F.col("at") > start) & (F.col("at") <= start + width)).join(longer.select("conv_id", "n", "prior"), "conv_id")
        wide = inside.groupBy("conv_id").agg(F.first("prior").alias("prior"), F.first("n").alias("n"), *[
            F.max(F.when(F.col("at") == start + i, F.col("t"))).alias(name) for i, name in enumerate(names, 1)])
        block = materialize(wide, "trie-block")
        nodes = materialize(_nodes(block, start, width), "trie-nodes")
        upto = F.array_join(F.slice(F.array(*names), F.lit(1), F.least(F.col("n") - start, F.lit(width)).cast("int")), " ")
        at = block.select("conv_id", "n", F.sha2(F.concat_ws(" ", "prior", upto), 256).alias("key"))
        ends.append(at.filter(F.col("n") <= start + width).select("key", "conv_id"))
        blocks.append((nodes, width))
        start += width
        shared = nodes.filter(F.col("level") == width).select("key", "n_convs")
        on = materialize(at.filter(F.col("n") > start).join(shared, "key"), "going-on")
        alone = on.filter("n_convs = 1").select("conv_id", "n", "key")
        # Alone on its node: the rest is a chain, one node a turn.
        link = lambda c, d: F.concat_ws("/", F.col("conv_id").cast("string"), d.cast("string"))
        rest = rows.filter(F.col("at") > start).select("conv_id", "at").join(alone, "conv_id")
        chains.append(rest.select(link("conv_id", F.col("at")).alias("key"), F.col("at").alias("depth"), "conv_id",
                                  F.when(F.col("at") == start + 1, F.col("key")).otherwise(link("conv_id", F.col("at") - 1)).alias("parent"),
                                  (F.col("at") == F.col("n")).cast("long").alias("last"), F.col("key").alias("top")))
        ends.append(alone.select(link("conv_id", F.col("n")).alias("key"), "conv_id"))
        members = materialize(on.filter("n_convs > 1").select("conv_id", "n", F.col("key").alias("prior")), "members")

    # Every node's children; each has one parent.
    total = heads.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
    own = ["key", "parent", "depth", "conv_id", "n_convs"]
    every = total.select(F.lit(ROOT).alias("key"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs")
    for nodes, _ in blocks:
        every = every.unionByName(nodes.select(*own))
    links = every.select("parent")
    chained = None
    for chain in chains:
        chained = chain if chained is None else chained.unionByName(chain)
    if chained is not None:
        chained = materialize(chained, "chains")
        links = links.unionByName(chained.filter(F.col("parent") == F.col("top")).select("parent"))
    children = materialize(links.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children")), "children")

    # Backward: sums over subtrees; what lies under a block's last nodes comes from the block after it.
    under = None
    if chained is not None:
        under = chained.filter("last = 1").groupBy(F.col("top").alias("key")).agg(F.sum("last").alias("n_leaves"), F.sum(F.lit(0).cast("long")).alias("saved_tokens"))
    sums = []
    for nodes, width in reversed(blocks):
        mine = nodes.join(children, "key", "left").select("key", "prior", *_names(width), F.col("n_children").isNull().cast("long").alias("leaves"), "saved")
        if under is not None:
            more = under.select("key", F.col("n_leaves").alias("more"), F.col("saved_tokens").alias("more_saved"))
            mine = mine.join(more, "key", "left").withColumns({
                "leaves": F.col("leaves") + F.coalesce("more", F.lit(0)), "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0))}).drop("more", "more_saved")
        summed = materialize(_below(mine, width), "subtrees")
        sums.append(summed.filter("NOT outside").drop("outside"))
        above = summed.filter("outside").drop("outside")
        # Chains hang under nodes of any block; their sums stay until that block's turn.
        under = above if under is None else above.unionByName(under).groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    if under is not None:
        sums.append(under.filter(F.col("key") == ROOT))
    below = None
    for one in sums:
        below = one if below is None else below.unionByName(one)

    parents = every.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = every.join(children, "key", "left").join(parents, "parent", "left")
    if below is None:
        whole = whole.withColumns({"n_leaves": F.lit(1).cast("long"), "saved_tokens": F.lit(0).cast("long")})
    else:
        whole = whole.join(below, "key", "left").withColumns({"n_leaves": F.coalesce("n_leaves", F.lit(1)).cast("long"), "saved_tokens": F.coalesce("saved_tokens", F.lit(0)).cast("long")})
    columns = ["key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    result = whole.withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")).select(*columns)
    if chained is not None:
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        # A chain's parents are the conversation itself, down from a node that it alone holds.
        result = result.unionByName(chained.select("key", "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"),
                                                   (1 - F.col("last")).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens")))
    finished = ends[0]
    for one in ends[1:]:
        finished = finished.unionByName(one)
    nothing = hashlib.sha256(b"").hexdigest()
    return result.join(digests(finished), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(nothing))).drop("key")


SQL = """WITH RECURSIVE own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
         {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT conv_id, list(t ORDER BY pos) AS ts FROM own GROUP BY conv_id),
crc AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS i, 4294967295 AS c FROM lists
  UNION ALL
  SELECT conv_id, s, i + 1, list_reduce(list_prepend(xor(c, CAST(ascii(s[i + 1]) AS BIGINT)), [0, 0, 0, 0, 0, 0, 0, 0]),
         lambda x, y: xor(x >> 1, 3988292384 * (x & 1))) FROM crc WHERE i < length(s)),
h AS (SELECT conv_id, xor(c, 4294967295) % 9 AS h FROM crc WHERE i = length(s)),
paths AS (
  SELECT l.conv_id, list_concat(coalesce(list_slice(b.ts, 1, h.h), []), list_slice(l.ts, h.h + 1, len(l.ts))) AS p
  FROM lists l JOIN h USING (conv_id) LEFT JOIN lists b ON b.conv_id = l.conv_id - l.conv_id % 5),
steps AS (SELECT conv_id, len(p) AS n, d, list_slice(p, 1, d) AS node FROM (SELECT *, unnest(range(0, len(p) + 1)) AS d FROM paths)),
nodes AS (
  SELECT node, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CASE WHEN n = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM steps GROUP BY node),
linked AS (SELECT c.*, p.conv_id AS parent_conv_id FROM nodes c LEFT JOIN nodes p ON c.depth > 0 AND p.node = list_slice(c.node, 1, c.depth - 1)),
families AS (SELECT list_slice(node, 1, depth - 1) AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
counted AS (SELECT l.*, coalesce(f.n_children, 0) AS n_children FROM linked l LEFT JOIN families f USING (node)),
ups AS (SELECT list_slice(node, 1, unnest(range(0, depth + 1))) AS node, CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf,
               CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(node[depth].text) END AS saved FROM counted),
sums AS (SELECT node, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM ups GROUP BY node)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM counted JOIN sums USING (node)"""
