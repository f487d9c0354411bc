"""Sums that do not depend on the order of rows."""

import math
import random
import re
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tierflow.functions import exact_sums

NAN, INF = float("nan"), float("inf")


def same(a, b):
    return a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b))


@pytest.mark.parametrize(
    "values, want",
    [
        ([NAN, 1.0], NAN), ([INF, 1.0], INF), ([-INF, 1.0], -INF), ([INF, -INF], NAN),
        ([4e-13] * 4, 1.6e-12), ([4e25] * 3, 1.2e26), ([1e308, 1e308], INF), ([5e-324] * 3, 1.5e-323),
        ([None, None], None), ([None, 2.5], 2.5), ([0.0, -0.0], 0.0), ([0.1, 0.2], 0.3),
        ([1234.56, 0.07], 1234.63), ([-0.001, 0.0011], 0.0001), ([1e300, 1.0, -1e300], 1.0),
        ([9.999999999999999e7, 1e-8], 1e8), ([1e7, 0.001, 999999.5, 1e8], 110999999.501),
    ],
)
def test_values(spark, values, want):
    df = spark.createDataFrame([(1, v) for v in values], "k int, v double")
    assert same(exact_sums(df, ["k"], {"s": "v"}).first().s, want)


def test_several_sums_keys_and_counts(spark):
    rows = [("a", 1.5, 2.0, 1), ("a", 0.25, None, 2), (None, 3e-20, 7.0, 3), (None, 1e20, 1.0, None)]
    df = spark.createDataFrame(rows, "k string, v double, w double, n int")
    got = {r.k: tuple(r)[1:] for r in exact_sums(df, ["k"], {"v": "v", "w": "w"}, {"n": "n"}).collect()}
    assert got == {"a": (1.75, 2.0, 3), None: (1e20, 8.0, 3)}
    assert exact_sums(df.where("n > 9"), ["k"], {"v": "v"}).collect() == []


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.floats(allow_nan=False, allow_infinity=False), st.floats(-1e6, 1e6)), min_size=1, max_size=12))
def test_any_order_gives_one_answer(spark, values):
    def total(order):
        df = spark.createDataFrame([(v,) for v in order], "v double").repartition(3)
        return exact_sums(df, [F.lit(1).alias("k")], {"s": "v"}).first().s

    shuffled = random.Random(len(values)).sample(values, len(values))
    first = total(values)
    assert same(first, total(shuffled))
    exact = float(sum(Fraction(repr(v)) for v in values)) if all(abs(v) < 1e300 for v in values) else None
    if exact is not None:
        assert math.isclose(first, exact, rel_tol=1e-9, abs_tol=1e-9 * max(map(abs, values)))


def test_rows_are_added_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    text = exact_sums(df, ["k"], {"s": "v"})._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in text and "Python" not in text and "CartesianProduct" not in text
    assert {r.k: r.s for r in exact_sums(df, ["k"], {"s": "v"}).collect()} == {k: float(sum(range(k, 1000, 3))) for k in range(3)}


def test_without_far_numbers_no_join_is_left(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    df.write.parquet(str(tmp_path / "x"))
    total = exact_sums(spark.read.parquet(str(tmp_path / "x")), ["k"], {"s": "v"})
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(v,1.0E14\)", total._jdf.queryExecution().toString())
    total.collect()
    text = total._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Join" not in text and text.count("Exchange") == 1
