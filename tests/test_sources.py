"""Readers and writers on files."""

import pytest
from helpers import CUT, crowd, rows_of, same
from pyspark.sql import functions as F

from catalog.adapter import fixes, scored_fixes
from trackloom.operators import labels as L
from trackloom.operators.clean import clean
from trackloom.plans.scratch import new_path
from trackloom.sources import readers as R
from trackloom.sources import writers as Wr


@pytest.fixture(scope="module")
def track(spark, sf_dir):
    return fixes(spark, sf_dir).select("id", "device_id", "ts", "lat", "lon", "alt")


def test_columns_are_found_by_name(spark, track):
    path = new_path(spark, "csv")
    shuffled = track.select(F.col("alt").alias("Altitude"), F.col("ts").alias("Timestamp"), F.lit("x").alias("extra"),
                            F.col("lon").alias("Longitude"), F.col("id").alias("Id"),
                            F.col("lat").alias("Latitude"), F.col("device_id").alias("Device_id"))
    shuffled.write.option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSSxxx").csv(path)
    same(track, R.load_track(spark, path, validate=False))
    same(clean(track), R.load_track(spark, path))
    assert R.load_track(spark, path, device_id=3, validate=False).select("device_id").distinct().count() == 1
    with pytest.raises(ValueError):
        R.load_track(spark, path, device_ids=[-5])


def test_file_without_ids(spark, track):
    path = new_path(spark, "parquet")
    track.drop("id").write.parquet(path)
    loaded = R.load_track(spark, path, fmt="parquet")
    assert rows_of(loaded.select("device_id", "ts", "dt")) == rows_of(clean(track).select("device_id", "ts", "dt"))


def test_missing_column(spark, track):
    path = new_path(spark, "parquet")
    track.drop("alt").write.parquet(path)
    with pytest.raises(ValueError, match="alt"):
        R.load_track(spark, path, fmt="parquet")


def test_unknown_device_gives_no_rows(spark, track):
    names = spark.createDataFrame([(1, "one")], "device_id long, device_name string")
    assert R.device_fixes(track, names, "two").count() == 0
    assert R.device_fixes(track, names, "one").count() == track.filter("device_id = 1").count()


def test_label_defaults_and_history(spark, track):
    assert R.with_defaults(track).filter("anomaly = 1").count() == track.count()
    history = spark.createDataFrame([(0, 1, -1), (1, 1, 1), (0, 2, -1)], "batch_id long, id long, anomaly int")
    assert rows_of(Wr.latest_labels(history)) == [("-1", "2"), ("1", "1")]


def test_unmatched_labels_are_reported(spark, track):
    path = new_path(spark, "table")
    track.withColumn("day", F.to_date("ts")).withColumn("anomaly", F.lit(1)).write.partitionBy("day").parquet(path)
    day = track.select(F.to_date("ts")).first()[0]
    new = spark.createDataFrame([(day, 5, -1), (day, -5, -1)], "day date, id long, anomaly int")
    assert [r["id"] for r in Wr.rewrite_labelled_days(path, new).collect()] == [-5]
    table = spark.read.parquet(path)
    assert table.count() == track.count()
    assert [r["id"] for r in table.filter("anomaly = -1").collect()] == [5]


def test_device_quantiles_do_not_gather_a_device(spark, sf_dir):
    rows = crowd(scored_fixes(spark, sf_dir))
    same(L.device_quantiles(rows, 0.05), L.device_quantiles(rows, 0.05, CUT))
    expected = rows.groupBy("device_id").agg(F.percentile("anomaly_score", 0.05).alias("threshold"))
    same(expected, L.device_quantiles(rows, 0.05))


def test_equal_rows_of_an_idless_file_get_their_own_stable_keys(spark, track):
    path, again = new_path(spark, "idless"), new_path(spark, "idless")
    rows = track.drop("id").limit(40)
    three = rows.unionByName(rows.limit(1)).unionByName(rows.limit(1)).cache()
    three.repartition(1).write.parquet(path)
    three.repartition(7).write.parquet(again)
    a, b = (R.load_track(spark, p, validate=False, fmt="parquet").select("id", "device_id", "ts", "lat", "lon", "alt") for p in (path, again))
    same(a, b)
    assert sorted(r.id for r in a.select("id").collect()) == list(range(1, 43))
    labels = a.withColumn("anomaly", F.when(F.col("id") % 2 == 0, -1).otherwise(1)).select("id", "anomaly")
    assert Wr.apply_labels(a.withColumn("anomaly", F.lit(1)), labels).filter("anomaly = -1").count() == 21


def test_short_zones_and_rejects(spark):
    lines = ["INSERT INTO t VALUES", "('2024-01-01 00:00:00+00', 1.5, 2, NULL, 3, 1),", "('2024-01-01 03:00:00+03', .5, -2e1, 7, 3, -1);",
             "('2024-01-01 00:00:00', 1, NULL, 3, 3, 1),", "('soon', 1, 2, 3, 3, 1),", "(broken", "('2024-01-01 00:00:00', 1, 2, 3, x, 1)", "('2024-01-01 00:00:00', 1, 2, 3, 4, )",
             "('2024-01-01 00:00:00', 1, 2, tall, 4, 1)", ""]
    path = new_path(spark, "lines")
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    good = R.read_insert_file(spark, path).select(F.unix_seconds("ts").alias("s"), "lat", "lon", "alt", "device_id", "anomaly").collect()
    assert sorted(map(tuple, good), key=str) == sorted([(1704067200, 1.5, 2.0, None, 3, 1), (1704067200, 0.5, -20.0, 7.0, 3, -1)], key=str)
    counts = {r.reason: r.n_rows for r in R.reject_counts(R.parse_insert_lines(spark.read.text(path))).collect()}
    assert counts == {"ok": 2, "bad position": 1, "bad time": 1, "not a tuple": 1, "bad device": 1, "bad label": 1, "bad altitude": 1}


def test_a_deep_page_reads_its_ranges_only(spark, track):
    index = R.PageIndex(track, "device_id", "ts", "id")
    want = [r.id for r in track.orderBy("device_id", "ts", "id").collect()]
    for number, size in ((0, 10), (17, 13), (len(want) // 9, 9), (10**6, 5)):
        page = index.page(number, size)
        assert [r.id for r in page.collect()] == want[number * size:number * size + size]
    plan = index.page(17, 13)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "_part" in plan.split("PushedFilters")[1][:200]
