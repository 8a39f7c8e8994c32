"""Median / interquartile scaling as plain columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.config import DEFAULT, TrackConfig
from trackloom.plans.selection import quantiles


@dataclass(frozen=True)
class Scaler:
    features: tuple[str, ...]
    median: tuple[float, ...]
    iqr: tuple[float, ...]        # 1 where the column does not vary

    def columns(self) -> list[Column]:
        return [((F.col(c).cast("double") - F.lit(m)) / F.lit(s)).alias(c)
                for c, m, s in zip(self.features, self.median, self.iqr)]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(dict(zip(self.features, self.columns())))


def fit_scaler(df: DataFrame, features: Sequence[str], cfg: TrackConfig = DEFAULT) -> Scaler:
    """Exact quartiles of every feature, all columns in the same scans."""
    found = quantiles(df, {c: (0.25, 0.5, 0.75) for c in features}, cfg)
    median = tuple(found[c][1] for c in features)
    spread = tuple(found[c][2] - found[c][0] for c in features)
    return Scaler(tuple(features), median, tuple(s if s > 0 else 1.0 for s in spread))


def scale_statistics(df: DataFrame, features: Sequence[str],
                     cfg: TrackConfig = DEFAULT) -> DataFrame:
    """The fitted statistics as a table, one row per feature."""
    scaler = fit_scaler(df, features, cfg)
    rows = list(zip(scaler.features, scaler.median, scaler.iqr))
    return df.sparkSession.createDataFrame(rows, "feature string, median double, iqr double")
