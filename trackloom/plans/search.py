"""Time-aware search over forest sizes and sample sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.config import DEFAULT, TrackConfig
from trackloom.models.forest import fit_forest, sample_size, score_prefixes
from trackloom.models.scaler import Scaler
from trackloom.operators.split import add_fold_block
from trackloom.plans.scratch import materialize


def parameter_grid(cfg: TrackConfig = DEFAULT) -> list[tuple]:
    """Combinations in the order they are tried: names sorted, the last name varies fastest."""
    grid = []
    for contamination in cfg.search_contamination:
        for samples in cfg.search_samples:
            for trees in cfg.search_trees:
                grid.append((trees, str(samples), contamination, len(grid)))
    return grid


def fold_scores(train: DataFrame, scaler: Scaler, order: str = "time",
                cfg: TrackConfig = DEFAULT) -> DataFrame:
    """(fold, n_estimators, max_samples, score): mean score of each fold's validation rows.

    Contamination never enters a fit or a score, and the first k trees of a larger forest are
    the forest of k trees, so each fold needs one forest per distinct sample size.
    """
    total = train.count()
    blocks = materialize(add_fold_block(train, cfg.search_folds, order, cfg, total), "folds")
    sizes = {r["block"]: r["count"] for r in blocks.groupBy("block").count().collect()}
    largest = max(cfg.search_trees)
    parts = []
    for fold in range(1, cfg.search_folds + 1):
        past = blocks.filter(F.col("block") < fold)
        n = sum(sizes.get(b, 0) for b in range(fold))
        by_size: dict[int, list[str]] = {}
        for samples in cfg.search_samples:
            by_size.setdefault(sample_size(n, samples, cfg), []).append(str(samples))
        for psi, names in by_size.items():
            model = fit_forest(past, scaler, f"fold{fold}", largest, psi, rows=n, cfg=cfg)
            scored = score_prefixes(blocks.filter(F.col("block") == fold), model,
                                    cfg.search_trees, "_scores")
            means = scored.agg(*[F.avg(F.col("_scores")[i]).alias(f"m{i}")
                                 for i in range(len(cfg.search_trees))])
            entries = F.array(*[F.struct(F.lit(k).alias("n_estimators"), F.col(f"m{i}").alias("score"))
                                for i, k in enumerate(cfg.search_trees)])
            parts.append(means.select(F.explode(entries).alias("e"),
                                      F.array(*[F.lit(x) for x in names]).alias("names"))
                         .select(F.lit(fold).alias("fold"), "e.n_estimators",
                                 F.explode("names").alias("max_samples"), "e.score"))
    return reduce(DataFrame.unionByName, parts)


def best_combination(scores: DataFrame) -> DataFrame:
    """Highest mean score; the combination tried first wins ties."""
    return scores.orderBy(F.desc("score"), "combo_ord").limit(1)


def hyperparameter_search(train: DataFrame, scaler: Scaler, order: str = "time",
                          cfg: TrackConfig = DEFAULT) -> DataFrame:
    """Every combination of the grid with its mean score over the folds."""
    grid = train.sparkSession.createDataFrame(
        parameter_grid(cfg), "n_estimators int, max_samples string, contamination double, combo_ord int")
    means = (fold_scores(train, scaler, order, cfg).groupBy("n_estimators", "max_samples")
             .agg(F.avg("score").alias("score")))
    return grid.join(F.broadcast(means), ["n_estimators", "max_samples"])
