"""All tunables in one frozen place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TrackConfig:
    # They decide results and must not drift.
    rolling_windows: tuple[int, ...] = (3, 5, 9)
    zscore_window: int = 10
    hover_speed: float = 0.5
    hover_seconds: float = 600.0
    burst_acceleration: float = 2.0
    burst_speed_change: float = 1.5
    min_latitude: float = -90.0
    max_latitude: float = 90.0
    min_longitude: float = -180.0
    max_longitude: float = 180.0
    max_speed: float = 40.0
    min_dt: float = 1.0
    n_trees: int = 200
    max_samples: int | str = "auto"
    auto_samples: int = 256
    contamination: float = 0.1
    seed: int = 42
    test_ratio: float = 0.2
    min_training_rows: int = 100
    min_importance_rows: int = 100
    importance_repeats: int = 5
    threshold_quantile: float = 0.05
    event_gap_seconds: float = 900.0
    min_event_size: int = 2
    alert_window: int = 10
    alert_threshold: int = 3
    retrain_days: int = 7
    retrain_rows: int = 500
    retrain_window_days: int = 30
    search_folds: int = 3
    search_trees: tuple[int, ...] = (100, 200, 300)
    search_samples: tuple[int | str, ...] = ("auto", 256, 512)
    search_contamination: tuple[float, ...] = (0.01, 0.05, 0.1)

    # Physical knobs: they change plans; results only in the last digits of long sums, and in the shape of
    # polylines, whose rows hold at most `polyline_points` points.
    hot_device_rows: int = 5_000_000       # a device with more fixes is cut into pieces
    small_sort_rows: int = 1_000_000       # built-in percentile up to this many counted rows
    sketch_accuracy: int = 10_000          # percentile_approx accuracy while bracketing
    bracket_rows: int = 1_000              # bracket small enough to read out
    broadcast_rows: int = 1_000_000        # largest key list sent with broadcast()
    broadcast_models: int = 32             # forests shipped to every task at once
    scoring_group_rows: int = 500_000      # rows per Python group on the many-models path
    shuffle_block_rows: int = 50_000       # rows per block of the permutation shuffle
    polyline_points: int = 100_000         # points per polyline row
    state_lookback: int = 10               # fixes that can influence a feature row


DEFAULT = TrackConfig()
