"""Order, null order, ties and edge cases of sorts, and the plans behind them."""

from __future__ import annotations

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.operators import sorting
from tessella.operators.sorting import Key

LOW, HIGH = -(2**31), 2**31 - 1
VALUES = [None, LOW, HIGH, 0, 42, 42, -1, None]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("first", [False, True])
def test_null_order_and_extremes(spark, descending, first):
    rows = [(x, i) for i, x in enumerate(VALUES)]
    df = spark.createDataFrame(rows, "k int, i int").repartition(3)
    ours = [tuple(r) for r in sorting.with_position(df, Key("k", descending, first), "i").orderBy("pos").collect()]

    def order(row):
        k, i = row
        return (k is None) != first, -(k or 0) if descending else k or 0, i

    assert [x[:2] for x in ours] == sorted(rows, key=order)
    assert [x[2] for x in ours] == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("kinds", [("int", "int"), ("tinyint", "int"), ("int", "smallint"), ("int", "bigint"), ("string", "int")])
def test_two_keys_of_all_directions(spark, kinds):
    """Extremes, nulls and ties, with both orders of each key and both places of nulls; the third key breaks ties."""
    small = {"tinyint": [-128, 127, 0], "smallint": [-32768, 32767, 0], "string": ["", "a", "b"]}
    pools = [[None, *small.get(k, [LOW, HIGH, 0, -1])] for k in kinds]
    rng = random.Random(1)
    rows = [(rng.choice(pools[0]), rng.choice(pools[1]), i) for i in range(60)]
    df = spark.createDataFrame(rows, f"a {kinds[0]}, b {kinds[1]}, i int").repartition(3)
    for down, first in ((False, True), (True, False), (True, True), (False, False)):
        keys = (Key("a", down, first), Key(F.col("b"), not down, first), "i")

        expected = sorted(rows, key=lambda r: r[2])
        for at, reverse in ((1, not down), (0, down)):  # stable sorts, the last key first
            known = sorted((r for r in expected if r[at] is not None), key=lambda r: r[at], reverse=reverse)
            nulls = [r for r in expected if r[at] is None]
            expected = nulls + known if first else known + nulls
        assert [tuple(r) for r in sorting.global_sort(df, *keys).collect()] == expected
        assert [tuple(r) for r in sorting.local_sort(df.coalesce(1), *keys).collect()] == expected


def test_equal_null_keys_go_on_to_the_next_key(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), (1, 0)], "a int, b int")
    assert [tuple(r) for r in sorting.global_sort(df, "a", "b").collect()] == [(None, 1), (None, 2), (1, 0)]


def test_special_doubles(spark):
    df = spark.createDataFrame([(x,) for x in (math.nan, math.inf, -math.inf, None, 1.5)], "x double")
    found = [r[0] for r in sorting.global_sort(df, "x").collect()]
    assert found[:4] == [None, -math.inf, 1.5, math.inf] and math.isnan(found[4])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5) | st.none(), st.integers(LOW, HIGH)), max_size=40))
def test_random_rows(spark, rows):
    df = spark.createDataFrame(rows, "a int, b int").repartition(4)
    found = [tuple(r) for r in sorting.global_sort(df, "a", "b").collect()]
    assert found == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "k int, v int")
    assert sorting.with_position(empty, "k").collect() == []
    assert sorting.group_ranges(empty, "k", "v").collect() == []
    one = spark.createDataFrame([(7, 1)], "k int, v int")
    assert [tuple(r) for r in sorting.with_position(one, "k").collect()] == [(7, 1, 1)]


def test_group_ranges_of_many_duplicates(spark):
    keys = [64, 42, 42, 32, 42, 64, 16]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int")
    found = {r["k"]: (r["first_pos"] - 1, r["last_pos"]) for r in sorting.group_ranges(df, "k", "i").collect()}
    assert found == {16: (0, 1), 32: (1, 2), 42: (2, 5), 64: (5, 7)}


def test_inversions_can_be_seen(spark):
    numbers = list(range(200))
    random.Random(3).shuffle(numbers)
    df = spark.createDataFrame([(x,) for x in numbers], "k int").coalesce(1)
    assert sorting.inversions(df, "k").first()[0] > 0
    assert sorting.inversions(sorting.local_sort(df, "k"), "k").first()[0] == 0


def test_plans(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    assert "rangepartitioning" in plan(sorting.global_sort(orders, "o_custkey"))
    assert "Exchange" not in plan(sorting.local_sort(orders, "o_custkey"))
    assert "TakeOrderedAndProject" in plan(sorting.top(orders, 5, "o_custkey"))
    narrow = plan(orders.filter(F.col("o_custkey") == 5).select("o_orderkey"))
    assert "EqualTo(o_custkey,5)" in narrow and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in narrow
