"""Isolation forests as Spark jobs: sample by hash, grow one tree per group, score by Arrow batch."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.config import DEFAULT, TrackConfig
from trackloom.models.scaler import Scaler
from trackloom.models.trees import PackedForest, depth_limit, grow, pack
from trackloom.plans.numbering import numbered
from trackloom.plans.permutation import permuted
from trackloom.plans.scratch import materialize
from trackloom.schema import MODEL_META, NODES
from trackloom.session import ship

_TREE_COLUMNS = [f for f in NODES if f.name != "model_name"]


@dataclass(frozen=True)
class Model:
    name: str
    scaler: Scaler
    psi: int
    n_trees: int
    seed: int
    trained_at: dt.datetime
    nodes: DataFrame            # written table, at most n_trees * (2 psi - 1) rows
    threshold: float | None = None

    def packed(self) -> PackedForest:
        ship(self.nodes.sparkSession)
        nodes = self.nodes.select("tree_id", "node_id", "feature", "threshold", "left", "right",
                                  "n", "depth").toPandas()
        return pack(nodes, self.psi, self.scaler.median, self.scaler.iqr)

    def meta(self) -> DataFrame:
        row = (self.name, list(self.scaler.features), list(self.scaler.median),
               list(self.scaler.iqr), self.psi, self.n_trees, self.seed, self.threshold,
               self.trained_at)
        return self.nodes.sparkSession.createDataFrame([row], MODEL_META)


def sample_size(rows: int, max_samples: int | str, cfg: TrackConfig = DEFAULT) -> int:
    wanted = cfg.auto_samples if max_samples == "auto" else int(max_samples)
    if wanted <= 0:
        raise ValueError(f"max_samples: {max_samples!r}")
    return min(wanted, rows)


def _unit_hash(*parts: Column) -> Column:
    """Uniform number in [0, 1) that depends on the values only, never on the layout."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


TREE_BLOCK = 64        # trees whose candidates are drawn together
DISPATCHED = 100_000   # rows that are dealt out to their models at a time


def _hits(rate: float) -> list[float]:
    """Chances of at most 0, 1, 2, ... hits among the trees of a block, up to where the rest is below 2^-53."""
    below, total = [], 0.0
    for k in range(TREE_BLOCK):
        total += math.comb(TREE_BLOCK, k) * rate ** k * (1 - rate) ** (TREE_BLOCK - k)
        if 1.0 - total < 2.0 ** -53:
            break
        below.append(total)
    return below


def _candidate_trees(key: Column, n_trees: int, rate: float, seed: int) -> Column:
    """Array of the trees that a row is a candidate for, each with chance ``rate`` and independently.

    For each block of trees one hash gives the number of hits (a binomial draw by its inverse distribution);
    Floyd's method then picks that many distinct trees, with one hash a hit. A row costs as many hashes as it
    has hits and blocks, not as there are trees, and a tree's rows do not depend on how many trees there are.
    """
    salt, chances = F.lit(seed), _hits(rate)
    below = F.array(*[F.lit(p) for p in chances])
    none = F.array().cast("array<int>")

    def chosen(first: int) -> Column:
        start = F.lit(first)
        u = _unit_hash(key, start, salt, F.lit(-1))
        hits = F.size(F.filter(below, lambda p: p <= u))

        def pick(taken: Column, j: Column) -> Column:
            at = F.pmod(F.xxhash64(key, start, salt, j), (j + 1).cast("long")).cast("int")
            return F.array_append(taken, F.when(F.array_contains(taken, at), j).otherwise(at))

        places = F.aggregate(F.sequence(F.lit(TREE_BLOCK) - hits, F.lit(TREE_BLOCK - 1)), none, pick)
        return F.when(u < F.lit(chances[0]), none).otherwise(F.transform(places, lambda t: t + start))

    blocks = F.concat(*[chosen(first) for first in range(0, n_trees, TREE_BLOCK)])
    return F.filter(blocks, lambda t: t < F.lit(n_trees))


def draw_samples(rows: DataFrame, n: int, psi: int, n_trees: int, seed: int) -> DataFrame:
    """``min(psi, n)`` rows for each tree: (tree_id, id, ...). ``rows`` has an ``id``, which alone decides.

    Candidates are drawn at a rate that leaves a wide margin (it follows from ``n`` and ``psi``); of them each
    tree takes those of smallest hash. If a tree came out short, all trees are drawn again at twice the rate.
    """
    key, salt = F.col("id"), F.lit(seed)
    wanted = min(psi, n)
    if not wanted:
        raise ValueError("no rows to draw from")
    rate = (psi + 8 * math.sqrt(psi) + 32) / n
    while True:
        trees = (_candidate_trees(key, n_trees, rate, seed) if rate < 1
                 else F.sequence(F.lit(0), F.lit(n_trees - 1)))
        drawn = materialize(rows.withColumn("tree_id", F.explode(trees)), "drawn")
        full = drawn.groupBy("tree_id").count().filter(F.col("count") >= wanted).count()
        if full == n_trees or rate >= 1:
            break
        rate *= 2
    place = Window.partitionBy("tree_id").orderBy(_unit_hash(key, F.col("tree_id"), salt), key)
    return (drawn.withColumn("_place", F.row_number().over(place))
                 .filter(F.col("_place") <= psi).drop("_place"))


def grow_forest(rows: DataFrame, n: int, psi: int, n_trees: int, seed: int) -> DataFrame:
    """Node table of a forest over ``rows`` (id, x: array<double>, already scaled)."""
    limit = depth_limit(psi)
    ship(rows.sparkSession)

    def one_tree(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        tree = int(group["tree_id"].iloc[0])
        nodes = grow(np.stack(group["x"].to_numpy()), np.random.default_rng([seed, tree]), limit)
        nodes.insert(0, "tree_id", tree)
        return nodes

    sample = draw_samples(rows.select("id", "x"), n, psi, n_trees, seed)
    return sample.groupBy("tree_id").applyInPandas(one_tree, T.StructType(_TREE_COLUMNS))


def fit_forest(train: DataFrame, scaler: Scaler, name: str = "default",
               n_trees: int | None = None, max_samples: int | str | None = None,
               contamination: float | None = None, seed: int | None = None,
               rows: int | None = None, trained_at: dt.datetime | None = None,
               cfg: TrackConfig = DEFAULT) -> Model:
    """Fit on unscaled training rows; ``contamination`` is accepted and never changes a fit."""
    del contamination
    trees = cfg.n_trees if n_trees is None else n_trees
    seed = cfg.seed if seed is None else seed
    n = train.count() if rows is None else rows
    psi = sample_size(n, cfg.max_samples if max_samples is None else max_samples, cfg)
    scaled = train.select("id", F.array(*scaler.columns()).alias("x"))
    nodes = (grow_forest(scaled, n, psi, trees, seed)
             .select(F.lit(name).alias("model_name"), *[f.name for f in _TREE_COLUMNS]))
    when = trained_at or dt.datetime.now(dt.timezone.utc)
    return Model(name, scaler, psi, trees, seed, when, materialize(nodes, "forest"))


def score(df: DataFrame, model: Model, out: str = "anomaly_score") -> DataFrame:
    """Append the score; only the feature columns travel to Python, in Arrow batches."""
    packed = df.sparkSession.sparkContext.broadcast(model.packed())

    @F.pandas_udf(T.DoubleType())
    def forest_score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        forest = packed.value
        for columns in batches:
            yield pd.Series(forest.scores(np.column_stack(columns))[:, 0])

    return df.withColumn(out, forest_score(*[F.col(c).cast("double") for c in model.scaler.features]))


def score_prefixes(df: DataFrame, model: Model, tree_counts: Sequence[int], out: str) -> DataFrame:
    """Scores of the forest's first k trees for several k, as one array column."""
    packed, counts = df.sparkSession.sparkContext.broadcast(model.packed()), tuple(tree_counts)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def prefix_scores(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        forest = packed.value
        for columns in batches:
            yield pd.Series(list(forest.scores(np.column_stack(columns), counts)))

    return df.withColumn(out, prefix_scores(*[F.col(c).cast("double") for c in model.scaler.features]))


def gathered(batches: Iterator[tuple[pd.Series, ...]], rows: int = DISPATCHED) -> Iterator[list[tuple[pd.Series, ...]]]:
    """Batches in lists of about so many rows, as a forest takes long over few of them."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch[0])
        if size >= rows:
            yield held
            held, size = [], 0
    if held:
        yield held


def score_by_model(df: DataFrame, models: Mapping[str, Model],
                   out: str = "anomaly_score") -> DataFrame:
    """Score each row with the forest named in its ``model_name``; unknown names give null."""
    features = _shared_features(models.values())
    packed = df.sparkSession.sparkContext.broadcast({k: m.packed() for k, m in models.items()})

    @F.pandas_udf(T.DoubleType())
    def dispatch(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        forests = packed.value
        for part in gathered(batches):
            names = pd.concat([batch[0] for batch in part], ignore_index=True)
            raw, result = np.concatenate([np.column_stack(batch[1:]) for batch in part]), np.full(len(names), np.nan)
            for name, at in names.groupby(names).indices.items():
                if name in forests:
                    result[at] = forests[name].scores(raw[at])[:, 0]
            yield from map(pd.Series, np.split(result, np.cumsum([len(batch[0]) for batch in part[:-1]])))

    value = dispatch(F.col("model_name"), *[F.col(c).cast("double") for c in features])
    scored = df.withColumn(out, value)
    return scored.withColumn(out, F.when(~F.isnan(out), F.col(out)))


def score_by_stored_model(df: DataFrame, nodes: DataFrame, meta: DataFrame,
                          out: str = "anomaly_score", cfg: TrackConfig = DEFAULT) -> DataFrame:
    """Like ``score_by_model`` for any number of models: forests meet their rows by co-grouping.

    Rows of a model are spread over as many groups as its row count asks for, and its forest is
    sent to each; no task sees more than about ``scoring_group_rows`` rows or one forest.
    ``df`` must not be re-evaluated differently between passes (a stored table or pure columns).
    """
    sizes = df.groupBy("model_name").agg(F.count(F.lit(1)).alias("_rows"))
    groups = meta.select("model_name", "features", "median", "iqr", "psi").join(sizes, "model_name")
    groups = groups.withColumn("_groups", F.ceil(F.col("_rows") / F.lit(cfg.scoring_group_rows)).cast("int"))
    kinds = meta.select("features").distinct().limit(2).collect()
    if len(kinds) != 1:
        raise ValueError("models scored together must use the same features")
    names = kinds[0]["features"]
    left = (df.join(groups.select("model_name", "_groups"), "model_name")
              .withColumn("_slot", F.pmod(F.xxhash64("id"), F.col("_groups")).cast("int")).drop("_groups"))
    right = (nodes.join(groups.drop("_rows"), "model_name")
                  .withColumn("_slot", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)))
                  .drop("_groups"))
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])
    columns = df.columns
    ship(df.sparkSession)

    def one_group(rows: pd.DataFrame, forest: pd.DataFrame) -> pd.DataFrame:
        rows = rows[columns]
        if rows.empty or forest.empty:
            return rows.assign(**{out: np.nan}).iloc[:0]
        head = forest.iloc[0]
        packed = pack(forest, int(head["psi"]), head["median"], head["iqr"])
        raw = rows[list(names)].to_numpy(dtype=float)
        return rows.assign(**{out: packed.scores(raw)[:, 0]})

    scored = (left.groupBy("model_name", "_slot")
                  .cogroup(right.groupBy("model_name", "_slot")).applyInPandas(one_group, schema))
    scored = scored.withColumn(out, F.when(~F.isnan(out), F.col(out)))
    rest = df.join(groups.select("model_name"), "model_name", "left_anti")
    return scored.unionByName(rest.withColumn(out, F.lit(None).cast("double")).select(*columns, out))


def _shared_features(models) -> tuple[str, ...]:
    kinds = {m.scaler.features for m in models}
    if len(kinds) != 1:
        raise ValueError("models scored together must use the same features")
    return kinds.pop()


def permuted_scores(rows: DataFrame, model: Model, repeats: int, n: int,
                    cfg: TrackConfig = DEFAULT) -> DataFrame:
    """(feature, repeat, mean baseline score, mean score with that feature permuted over all rows).

    Rows are numbered in the order of their ids and values, and a keyed permutation of the numbers says whose
    values each row gets. What trees ask of a value is its place among their cut points, so rows travel as these
    codes. They meet their donors by the block of their number, which holds ``shuffle_block_rows`` rows at most and
    decides nothing but the size of tasks; a task scores and traces its rows once for all repeats and returns sums only.
    """
    features, seed = list(model.scaler.features), model.seed
    session = rows.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    held = max(1, min(cfg.shuffle_block_rows, math.ceil(n / (4 * tasks))))
    packed = session.sparkContext.broadcast(model.packed())

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = packed.value.codes(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]))
            width = codes.shape[1] * codes.itemsize
            ends = np.arange(0, (len(codes) + 1) * width, width, dtype=np.int32)
            made = pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(ends), pa.py_buffer(codes)])
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["_row", "x"])

    ship(session)
    inputs = rows.select("id", *[F.col(c).cast("double").alias(c) for c in features])
    placed = materialize(numbered(inputs, ["id", *features], "_row").select("_row", *features)
                         .mapInArrow(coded, "_row long, x binary"), "coded")
    block = F.floor(F.col("_row") / F.lit(held)).alias("_block")
    own = placed.select(block, "_row", F.col("x").alias("own"))
    places = [F.struct(F.lit(i).alias("repeat"), permuted(F.col("_row"), n, seed, i).alias("row"))
              for i in range(repeats)]
    given = (placed.withColumn("_to", F.explode(F.array(*places)))
                   .select(F.col("_to.repeat").alias("_repeat"), F.col("_to.row").alias("_row"), F.col("x").alias("given"))
                   .select(block, "_repeat", "_row", "given"))

    def decoded(table: pa.Table, column: str, *order: str) -> np.ndarray:
        keys = [table.column(c).to_numpy() for c in reversed(order)]
        codes = np.frombuffer(b"".join(table.column(column).to_pylist()), packed.value.code_type)
        return codes.reshape(len(table), len(features))[np.lexsort(keys)]

    def sums(mine: pa.Table, donors: pa.Table) -> pa.Table:
        if len(donors) != repeats * len(mine):
            raise ValueError(f"{len(mine)} rows met {len(donors)} donors: n is not the number of rows")
        plain, changed = 0.0, np.zeros((len(features), repeats))
        codes, theirs = decoded(mine, "own", "_row"), decoded(donors, "given", "_repeat", "_row")
        for scores, permuted_to in packed.value.permuted_parts(codes, np.split(theirs, repeats)):
            plain += scores.sum()
            changed += permuted_to.sum(axis=2)
        slot, repeat = (i.ravel() for i in np.indices(changed.shape, np.int32))
        return pa.table({"slot": slot, "repeat": repeat, "rows": np.full(len(slot), len(mine)),
                         "plain": np.full(len(slot), plain), "permuted": changed.ravel()})

    named = F.element_at(F.array(*[F.lit(c) for c in features]), F.col("slot") + 1)
    return (own.groupBy("_block").cogroup(given.groupBy("_block"))
            .applyInArrow(sums, "slot int, repeat int, rows long, plain double, permuted double")
            .groupBy(named.alias("feature"), "repeat")
            .agg((F.sum("plain") / F.sum("rows")).alias("baseline"),
                 (F.sum("permuted") / F.sum("rows")).alias("permuted")))


def feature_importance(rows: DataFrame, model: Model, repeats: int | None = None,
                       n: int | None = None, cfg: TrackConfig = DEFAULT) -> DataFrame:
    """Permutation importance: mean baseline score minus mean permuted score, over repeats."""
    repeats = cfg.importance_repeats if repeats is None else repeats
    size = rows.count() if n is None else n
    drops = permuted_scores(rows, model, repeats, size, cfg).select(
        "feature", (F.col("baseline") - F.col("permuted")).alias("importance"))
    return drops.groupBy("feature").agg(F.avg("importance").alias("importance_mean"),
                                        F.stddev_pop("importance").alias("importance_std"))


def save_model(model: Model, folder: str) -> None:
    """Write nodes and meta under ``model_name=...``; other models in the folder stay."""
    save_tables(model.nodes, model.meta(), folder)


def save_tables(nodes: DataFrame, meta: DataFrame, folder: str) -> None:
    """Write any number of models at once from their node and meta rows."""
    for table, rows in (("nodes", nodes), ("meta", meta)):
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("model_name").parquet(f"{folder}/{table}"))


def stored_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(NODES).parquet(f"{folder}/nodes")


def stored_meta(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MODEL_META).parquet(f"{folder}/meta")


def load_models(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, Model]:
    """The named models that exist; nodes stay on storage until a forest is packed."""
    nodes = stored_nodes(spark, folder)
    found = stored_meta(spark, folder).filter(F.col("model_name").isin(list(names))).collect()
    return {r["model_name"]: Model(
        r["model_name"], Scaler(tuple(r["features"]), tuple(r["median"]), tuple(r["iqr"])),
        r["psi"], r["n_trees"], r["seed"], r["trained_at"],
        nodes.filter(F.col("model_name") == r["model_name"]), r["threshold"]) for r in found}


def load_model(spark: SparkSession, folder: str, name: str) -> Model:
    found = load_models(spark, folder, [name])
    if name not in found:
        raise ValueError(f"no model {name!r} in {folder}")
    return found[name]


def delete_models(spark: SparkSession, folder: str, names: Sequence[str]) -> None:
    """Remove stored models; always a separate, explicit step."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name in names:
        for table in ("nodes", "meta"):
            path = hadoop(f"{folder}/{table}/model_name={name}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_threshold(model: Model, threshold: float | None) -> Model:
    return replace(model, threshold=threshold)
