"""What a stream writes, keeps and scores at a time."""

import datetime as dt
import os

import numpy as np
import pandas as pd
import pytest
from helpers import START, same
from pyspark.sql import functions as F

from trackloom.models import forest as Fr
from trackloom.models.scaler import Scaler
from trackloom.operators.features import build_features
from trackloom.plans.scratch import new_path, scratch_dir
from trackloom.schema import FEATURES
from trackloom.streaming.monitor import fix_stream
from trackloom.streaming.segments import current_features, start_features

SCHEMA = "id long, device_id long, ts timestamp, lat double, lon double, alt double"


def _stream(spark, *parts):
    """The folder of a feature stream over one micro-batch a part."""
    folder, out, mark = (new_path(spark, label) for label in ("feed", "out", "mark"))
    for rows in parts:
        frame = spark.createDataFrame(rows, SCHEMA)
        frame.coalesce(1).write.mode("append").parquet(folder)
        start_features(fix_stream(spark, folder, frame.schema), out, mark).awaitTermination(300)
    return out


def test_fixes_that_follow_leave_earlier_rows_and_no_scratch(spark):
    rows = [(i, 1 + i % 3, START + dt.timedelta(seconds=40 * i), 0.01 * (i % 7), 0.0, float(i % 5)) for i in range(90)]
    late = (500, 1, START + dt.timedelta(seconds=61), 0.5, 0.5, 0.0)
    before = set(os.listdir(scratch_dir(spark).removeprefix("file:")))
    out = _stream(spark, rows[:30], rows[30:60], [*rows[60:], late])
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(scratch_dir(spark).removeprefix("file:"))) - before}
    assert left <= {"feed", "out", "mark"}
    written = spark.read.parquet(f"{out}/features").groupBy("batch_id", "corrected").agg(F.count("*").alias("n"), F.count_distinct("device_id").alias("d"))
    found = {(r.batch_id, r.corrected): (r.n, r.d) for r in written.collect()}
    assert found[0, False] == found[1, False] == (30, 3) and found[2, False] == (31, 3)
    assert (1, True) not in found and found[2, True][1] == 1          # only the device with the late fix
    columns = ["id", "hover_run", *FEATURES]
    want = build_features(spark.createDataFrame([*rows, late], SCHEMA)).select(*columns)
    same(want, current_features(spark, out).select(*columns))
    assert [r.id for r in current_features(spark, out).filter("late").collect()] == [500]


def test_an_id_that_comes_again_stays_one_row(spark):
    rows = [(i, 1, START + dt.timedelta(seconds=40 * i), 0.0, 0.0, 0.0) for i in range(6)]
    out = _stream(spark, rows, [(2, 1, START + dt.timedelta(seconds=900), 1.0, 1.0, 0.0), (None, 1, START + dt.timedelta(seconds=950), 1.0, 1.0, 0.0)])
    found = {r.id: r.lat for r in current_features(spark, out).collect()}
    assert len(found) == current_features(spark, out).count() == 7 and found[2] == 1.0 and found[None] == 1.0


def test_batches_are_gathered_for_their_models():
    batches = [(pd.Series([f"m{i}"] * 10),) for i in range(25)]
    parts = list(Fr.gathered(iter(batches), 100))
    assert [len(p) for p in parts] == [10, 10, 5] and [b[0][0] for p in parts for b in p] == [f"m{i}" for i in range(25)]


@pytest.mark.parametrize("rows", [0, 1, 300])
def test_gathered_rows_get_their_own_scores(spark, rows):
    when = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    models = {}
    for name, cut in (("a", 0.3), ("b", 0.6)):
        nodes = spark.createDataFrame([(name, 0, 0, 0, cut, 1, 2, 9, 0), (name, 0, 1, -1, 0.0, -1, -1, 5, 1), (name, 0, 2, -1, 0.0, -1, -1, 2, 1)], Fr.NODES)
        models[name] = Fr.Model(name, Scaler(("x",), (0.0,), (1.0,)), 8, 1, 0, when, nodes)
    data = [(i, ["a", "b", "none", None][i % 4], float(np.sin(i) ** 2)) for i in range(rows)]
    frame = spark.createDataFrame(data, "id long, model_name string, x double").coalesce(1)
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = {r.id: r.anomaly_score for r in Fr.score_by_model(frame, models).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", usual)
    packed = {k: m.packed() for k, m in models.items()}
    assert found == {i: packed[m].scores(np.array([[x]]))[0, 0] if m in packed else None for i, m, x in data}
