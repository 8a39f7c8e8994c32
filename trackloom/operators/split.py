"""Time-ordered train/test split and expanding time-series folds, by cut keys instead of ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.config import DEFAULT, TrackConfig
from trackloom.plans.selection import before_key, row_keys_at

ORDERS = {"time": ("ts", "id"), "device_time": ("device_id", "ts", "id")}


def _sizes(df: DataFrame, column: str, rows: int | None) -> tuple[int, int | None]:
    """Rows in all and rows with a value in ``column``, from one scan; the latter is None if not counted here."""
    if rows is not None:
        return rows, None
    return tuple(df.agg(F.count(F.lit(1)), F.count(column)).first())


def add_split(df: DataFrame, test_ratio: float | None = None, order: str = "time",
              cfg: TrackConfig = DEFAULT, rows: int | None = None) -> DataFrame:
    """Column ``split``: 'train' on the first ``int(n * (1 - ratio))`` rows, else 'test'."""
    ratio = cfg.test_ratio if test_ratio is None else test_ratio
    columns = ORDERS[order]
    total, dated = _sizes(df, columns[0], rows)
    [key] = row_keys_at(df, [int(total * (1 - ratio))], columns, cfg, dated)
    return df.withColumn("split", F.when(before_key(df, columns, key), "train").otherwise("test"))


def split_train_test(df: DataFrame, test_ratio: float | None = None, order: str = "time",
                     cfg: TrackConfig = DEFAULT,
                     rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    marked = add_split(df, test_ratio, order, cfg, rows)
    part = lambda name: marked.filter(F.col("split") == name).drop("split")
    return part("train"), part("test")


def split_ranges(marked: DataFrame) -> DataFrame:
    return marked.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"),
                                       F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def add_fold_block(df: DataFrame, folds: int | None = None, order: str = "time",
                   cfg: TrackConfig = DEFAULT, rows: int | None = None) -> DataFrame:
    """Column ``block``: 0 for the rows before the first validation block, then 1..folds.

    Fold f validates on block f and trains on all blocks below it; each validation block has
    ``n // (folds + 1)`` rows and the remainder stays in block 0.
    """
    folds = cfg.search_folds if folds is None else folds
    columns: Sequence[str] = ORDERS[order]
    total, dated = _sizes(df, columns[0], rows)
    size = total // (folds + 1)
    cuts = [total - (folds - f + 1) * size for f in range(1, folds + 1)]
    block = F.lit(folds)
    for f, key in reversed(list(enumerate(row_keys_at(df, cuts, columns, cfg, dated)))):
        block = F.when(before_key(df, columns, key), F.lit(f)).otherwise(block)
    return df.withColumn("block", block)


def fold_members(df: DataFrame, folds: int | None = None) -> DataFrame:
    """One row per (fold, row) with its role; ``df`` carries ``block``."""
    folds = DEFAULT.search_folds if folds is None else folds
    return (df.withColumn("fold", F.explode(F.sequence(F.greatest(F.col("block"), F.lit(1)), F.lit(folds))))
              .withColumn("role", F.when(F.col("block") == F.col("fold"), "validate").otherwise("train")))
