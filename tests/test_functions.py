import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from retail_insight.functions import floor_days, half_even, money_sum, parse_timestamp, py_strip


def test_half_even_matches_numpy_round(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.uniform(0, 5000, 2000), np.array([0.125, 0.375, 2.675, 1.005, 10.5, 11.5])])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = [r[0] for r in df.select(half_even("x", 2)).collect()]
    assert got == [float(v) for v in np.round(vals, 2)]
    got1 = [r[0] for r in df.select(half_even("x", 0)).collect()]
    assert got1 == [float(v) for v in np.round(vals, 0)]


def test_money_sum_is_exact_and_order_free(spark):
    vals = [0.1] * 10 + [0.2] * 5
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(5)
    assert df.agg(money_sum("x")).first()[0] == 2.0


def test_floor_days_counts_whole_24h_spans(spark):
    rows = [(dt.datetime(2024, 1, 1, 0, 1), dt.datetime(2024, 1, 2, 23, 59)),   # 47h58m -> 1
            (dt.datetime(2024, 1, 1, 12, 0), dt.datetime(2024, 1, 2, 11, 59)),  # 23h59m -> 0
            (dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 3))]                  # 48h -> 2
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.select(floor_days("a", "b")).collect()] == [1, 0, 2]
    # a calendar difference would say 1, 1, 2
    assert [r[0] for r in df.select(F.datediff(F.col("b"), F.col("a"))).collect()] == [1, 1, 2]


def test_py_strip_removes_unicode_whitespace(spark):
    df = spark.createDataFrame([(" \t a b  \n",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(py_strip("s")).collect()] == ["a b", "x", None]


def test_parse_timestamp_formats_and_garbage(spark):
    df = spark.createDataFrame([("2024-01-05 10:11:12",), ("12/1/2010 8:26",), ("2024-03-04",),
                                ("not a date",), (None,)], "s string")
    got = [r[0] for r in df.select(parse_timestamp(F.col("s"))).collect()]
    assert got == [dt.datetime(2024, 1, 5, 10, 11, 12), dt.datetime(2010, 12, 1, 8, 26),
                   dt.datetime(2024, 3, 4), None, None]
