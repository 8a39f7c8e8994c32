from pyspark.sql import functions as F

from trackloom.plans.numbering import numbered, positions


def _rows(spark, hot=600):
    data = [(7, i % 5, f"r{i}") for i in range(hot)] + [(k, None if k == 3 else k % 2, "same") for k in range(20) for _ in range(3)] + [(None, 1, "x"), (None, 0, "y")]
    return spark.createDataFrame(data, "k long, v long, s string")


def test_numbers_are_dense_and_in_order(spark):
    rows = numbered(_rows(spark).repartition(5), ["k", "v", "s"], "n", start=1).collect()
    assert sorted(r.n for r in rows) == list(range(1, len(rows) + 1))
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in (r.k, r.v, r.s))
    assert [key(r) for r in sorted(rows, key=lambda r: r.n)] == sorted(map(key, rows))


def test_numbers_do_not_depend_on_the_layout(spark):
    df = _rows(spark)
    a, b = (sorted(map(tuple, numbered(df.repartition(n, "s"), ["k", "v", "s"], "n").collect()), key=lambda r: r[3]) for n in (1, 13))
    assert a == b


def test_positions_count_within_keys(spark):
    df = positions(_rows(spark), "k", ["v", "s"], "at", start=1)
    spread = df.groupBy("k").agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.countDistinct("at").alias("d")).collect()
    assert all(r.lo == 1 and r.n == r.hi == r.d for r in spread) and {r.k for r in spread} >= {None, 7}


def test_a_hot_key_is_numbered_by_many_tasks(spark):
    from trackloom.plans.numbering import PART, sorted_parts

    parts = sorted_parts(_rows(spark, 3000), ["k", "v", "s"], "t").filter("k = 7").select(PART).distinct().count()
    assert parts > 3


def test_empty(spark):
    none = _rows(spark).limit(0)
    assert numbered(none, ["k"], "n").count() == 0 and positions(none, "k", ["v"], "n").count() == 0
