"""The composite jobs: train, infer, score a batch of many devices, retrain."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.config import DEFAULT, TrackConfig
from trackloom.models import forest as fr
from trackloom.models.forest import Model
from trackloom.models.scaler import fit_scaler
from trackloom.operators.clean import require_rows
from trackloom.operators.devices import add_all_devices, assign_model, of_selected, orphan_models, with_model
from trackloom.operators.features import build_features, clean_features
from trackloom.operators.labels import anomaly_events, filter_isolated, is_anomaly, label
from trackloom.operators.metrics import evaluate, recent
from trackloom.operators.split import add_split
from trackloom.plans.scratch import materialize
from trackloom.plans.search import best_combination, hyperparameter_search
from trackloom.plans.selection import quantiles
from trackloom.schema import feature_names
from trackloom.sources.writers import apply_labels, write_results


@dataclass(frozen=True)
class TrainResult:
    model: Model
    full: DataFrame                    # every row: score, label after isolated anomalies went
    test: DataFrame
    test_metrics: DataFrame
    test_metrics_filtered: DataFrame
    full_metrics: DataFrame
    events: DataFrame                  # of the test rows
    importance: DataFrame | None       # only with enough test rows


def train(track: DataFrame, model_name: str = "default", search: bool = False, order: str = "time",
          clean_first: bool = True, importance: bool = True, trained_at: dt.datetime | None = None,
          cfg: TrackConfig = DEFAULT) -> TrainResult:
    """Features once, scaler and forest on the earliest rows, scores once, two labelled views.

    The feature and score tables are written to the scratch folder, so no later step repeats
    the window job.
    """
    wide = clean_features(track, cfg) if clean_first else build_features(track, cfg)
    features = feature_names(cfg.rolling_windows)
    keep = list(dict.fromkeys(["id", "device_id", "ts", "lat", "lon", "alt", *features]))
    rows = require_rows(materialize(wide.select(*keep), "features"),
                        cfg.min_training_rows, "training data")
    total = rows.count()
    marked = add_split(rows, None, order, cfg, total)
    train_rows = marked.filter(F.col("split") == "train")
    n_train = int(total * (1 - cfg.test_ratio))
    scaler = fit_scaler(train_rows, features, cfg)
    trees, samples = cfg.n_trees, cfg.max_samples
    if search:
        best = best_combination(hyperparameter_search(train_rows, scaler, order, cfg)).first()
        trees = best["n_estimators"]
        samples = "auto" if best["max_samples"] == "auto" else int(best["max_samples"])
    model = fr.fit_forest(train_rows, scaler, model_name, trees, samples, rows=n_train,
                          trained_at=trained_at, cfg=cfg)
    scored = materialize(fr.score(marked, model), "scores")
    cut = quantiles(scored, {"anomaly_score": [cfg.threshold_quantile]}, cfg)["anomaly_score"][0]
    model = fr.with_threshold(model, cut)

    test_scored = scored.filter(F.col("split") == "test").drop("split")
    test_labelled = label(test_scored, cfg=cfg)
    test = filter_isolated(test_labelled, cfg=cfg)
    full = filter_isolated(label(scored.drop("split"), threshold=cut, cfg=cfg), cfg=cfg)
    n_test = total - n_train
    ranked = None
    if importance and n_test > cfg.min_importance_rows:
        ranked = fr.feature_importance(test_scored, model, n=n_test, cfg=cfg)
    return TrainResult(model, full, test, evaluate(test_labelled), evaluate(test), evaluate(full),
                       anomaly_events(test, cfg=cfg), ranked)


def save_training(result: TrainResult, model_folder: str, results_path: str | None = None,
                  fixes: DataFrame | None = None) -> DataFrame | None:
    """Persist the model, optionally the result file; returns the relabelled fact table if given."""
    fr.save_model(result.model, model_folder)
    if results_path:
        write_results(result.full, results_path)
    return None if fixes is None else apply_labels(fixes, result.full.select("id", "anomaly"))


def infer(track: DataFrame, model: Model, mode: str = "batch_quantile", clean_first: bool = True,
          cfg: TrackConfig = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(labelled rows, events, metrics) of new data under a stored model."""
    wide = clean_features(track, cfg) if clean_first else build_features(track, cfg)
    scored = materialize(fr.score(wide, model), "scores")
    fixed = model.threshold if mode == "fixed" else None
    rows = filter_isolated(label(scored, mode, fixed, cfg=cfg), cfg=cfg)
    return rows, anomaly_events(rows, cfg=cfg), evaluate(rows)


def score_batch(new_fixes: DataFrame, devices: DataFrame, model_folder: str,
                mode: str = "fixed", cfg: TrackConfig = DEFAULT,
                featured: bool = False) -> DataFrame:
    """Score and label the new fixes of all devices at once, each with its device's model.

    Nothing is cleaned away. Rows whose device has no stored model are left out, like
    `devices_without_model` reports. ``fixed`` uses the threshold saved with each model.
    """
    labelled = label_batch(new_fixes, devices, model_folder, mode, cfg, featured)
    return filter_isolated(labelled, cfg=cfg)


def unusable(new_fixes: DataFrame, devices: DataFrame, meta: DataFrame, mode: str = "fixed") -> DataFrame:
    """`id, device_id, model_name, reason` of fixes that no stored model can label."""
    known = meta.select("model_name", F.lit(True).alias("_stored"), F.col("threshold").isNull().alias("_bare"))
    named = with_model(new_fixes.select("id", "device_id"), devices).join(known, "model_name", "left")
    reason = (F.when(F.col("model_name").isNull(), "no model assigned").when(F.col("_stored").isNull(), "model not stored")
               .when(F.lit(mode == "fixed") & F.col("_bare"), "model without threshold"))
    return named.withColumn("reason", reason).filter("reason IS NOT NULL").select("id", "device_id", "model_name", "reason")


def label_batch(new_fixes: DataFrame, devices: DataFrame, model_folder: str, mode: str = "fixed",
                cfg: TrackConfig = DEFAULT, featured: bool = False, strict: bool = True) -> DataFrame:
    """Scores and labels of ``score_batch`` before isolated anomalies go, as a written table.

    A model without threshold that a device of the batch uses is refused in mode ``fixed``; if not ``strict``, its
    rows are left out like those without a model, and `unusable` names them.
    """
    spark = new_fixes.sparkSession
    meta = fr.stored_meta(spark, model_folder)
    if mode == "fixed":
        bare = meta.filter("threshold IS NULL").select("model_name")
        used = with_model(new_fixes.select("device_id").distinct(), devices).join(bare, "model_name", "left_semi")
        found = [r[0] for r in used.select("model_name").distinct().limit(5).collect()] if strict else []
        if found:
            raise ValueError(f"models without a threshold cannot label in mode 'fixed': {found}")
        meta = meta.filter("threshold IS NOT NULL")
    known = meta.select("model_name", F.col("threshold").alias("_cut"))
    wide = new_fixes if featured else build_features(new_fixes, cfg)
    named = with_model(wide, devices).join(known, "model_name", "inner")
    names = [r[0] for r in meta.select("model_name").distinct().limit(cfg.broadcast_models + 1).collect()]
    if not names:
        scored = named.withColumn("anomaly_score", F.lit(None).cast("double"))
    elif len(names) <= cfg.broadcast_models:
        scored = fr.score_by_model(named, fr.load_models(spark, model_folder, names))
    else:
        stable = materialize(named, "to-score")
        scored = fr.score_by_stored_model(stable, fr.stored_nodes(spark, model_folder), meta, cfg=cfg)
    if mode == "fixed":
        labelled = scored.withColumn(
            "anomaly", F.when(F.col("anomaly_score") < F.col("_cut"), -1).otherwise(1))
    else:
        labelled = label(materialize(scored, "scores"), mode, cfg=cfg)
    return materialize(labelled.drop("_cut"), "labelled")


def anomaly_count(rows: DataFrame) -> DataFrame:
    return rows.groupBy("device_id").agg(F.count_if(is_anomaly()).alias("n_anomalies"))


def train_and_assign(fixes: DataFrame, devices: DataFrame, selection: DataFrame, model_name: str,
                     model_folder: str, cfg: TrackConfig = DEFAULT,
                     ) -> tuple[TrainResult, DataFrame, DataFrame]:
    """Train on the selected devices, assign the model to them, list models nobody uses any more."""
    picked = add_all_devices(selection, devices)
    result = train(of_selected(fixes, devices, picked), model_name, cfg=cfg)
    save_training(result, model_folder)
    updated = assign_model(devices, picked.withColumn("if_model", F.lit(model_name)))
    saved = fr.stored_meta(fixes.sparkSession, model_folder).select("model_name")
    return result, updated, orphan_models(saved, updated)


def retrain(history: DataFrame, new: DataFrame, model_name: str,
            features: Sequence[str] | None = None, days: int | None = None,
            cfg: TrackConfig = DEFAULT) -> Model:
    """Fresh scaler, forest and threshold on the last days of history and new rows together."""
    both = history.unionByName(new, allowMissingColumns=True)
    rows = materialize(recent(both, cfg.retrain_window_days if days is None else days), "recent")
    rows = require_rows(rows, 1, "recent rows")
    scaler = fit_scaler(rows, features or feature_names(cfg.rolling_windows), cfg)
    model = fr.fit_forest(rows, scaler, model_name, cfg=cfg)
    scores = materialize(fr.score(rows, model).select("anomaly_score"), "scores")
    cut = quantiles(scores, {"anomaly_score": [cfg.threshold_quantile]}, cfg)["anomaly_score"][0]
    return fr.with_threshold(model, cut)
