"""Every registered query against its SQL twin; those without one must give rows."""

import pytest
from compare import difference

import __spark_entry__ as entry

WITH_SQL = sorted(entry.oracle_sql())
ROWS_ONLY = sorted(set(entry.queries()) - set(WITH_SQL))


def test_names_match():
    assert set(WITH_SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", WITH_SQL)
def test_equals_sql(name, spark, duck, sf_dir):
    assert difference(entry.queries()[name](spark, sf_dir), duck, entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_gives_rows(name, spark, sf_dir):
    assert entry.queries()[name](spark, sf_dir).count() > 0


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_twins_notice_a_planted_error(spark, duck, sf_dir):
    events = entry.queries()["anomaly_events"](spark, sf_dir)
    assert difference(events, duck, entry.oracle_sql()["anomaly_events"].replace("900000000", "90000000"))
    metrics = entry.queries()["evaluation_metrics"](spark, sf_dir)
    assert difference(metrics, duck, entry.oracle_sql()["evaluation_metrics"].replace("stddev_pop", "stddev_samp"))
    times = entry.queries()["time_features"](spark, sf_dir)
    assert difference(times, duck, entry.oracle_sql()["time_features"].replace("isodow(ts) - 1", "dayofweek(ts)"))
