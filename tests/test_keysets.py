"""Repeated keys found by bitmaps: the same rows as a plain grouping, whatever the keys look like."""

import collections
import random

import pytest
from conftest import rows

from tillroll.functions.keysets import Packing, choose_packing, repeated_keys
from tillroll.operators import quality as Q
from tillroll.sources.starmap import load_star

LOW, HIGH = -(2 ** 63), 2 ** 63 - 1


def expected(keys):
    counts = collections.Counter(keys)
    nulls = sum(n for k, n in counts.items() if None in k)
    found = [(*k, False, n) for k, n in counts.items() if n > 1 and None not in k]
    return sorted(found) + ([(*[None] * len(keys[0]), True, nulls)] if nulls else [])


def found(frame, keys, **how):
    got = rows(repeated_keys(frame, keys, **how))
    return sorted(r for r in got if not r[-2]) + [r for r in got if r[-2]]


def dense(n):
    return [(i,) for i in range(-n, n)] + [(5,), (5,), (-7,), (None,), (None,)]


def strided(n):
    return [(o * 1000 + line,) for o in range(n) for line in range(1, 8)] + [(3001,), (3001,), (4999,), (4999,), (-2003,), (-2003,), (-2004,)]


def sparse(n):
    rng = random.Random(3)
    return [(rng.randrange(LOW, HIGH),) for _ in range(n)] + [(LOW,), (HIGH,), (LOW,), (0,), (0,), (None,)]


@pytest.mark.parametrize("keys, way", [(dense(3000), Packing("k", 1, 1)), (strided(900), Packing("k", 1000, 8)), (sparse(1000), None), ([(None,)], None)])
def test_single_keys(spark, keys, way):
    frame = spark.createDataFrame(keys, "k bigint").repartition(4)
    assert choose_packing(frame.filter("k IS NOT NULL"), ["k"]) == way
    assert found(frame, ["k"]) == expected(keys) == found(frame, ["k"], pack=False)


def test_composite_keys_and_clashing_names(spark):
    keys = [(i, f"c{i % 3}") for i in range(6000)] + [(7, "c1"), (7, "c1"), (8, "c0"), (None, "c1"), (9, None), (-1, "c2"), (-1, "c2")]
    frame = spark.createDataFrame([(*k, 1, 2) for k in keys], "a int, b string, n int, _bucket int")
    assert choose_packing(frame.filter("a IS NOT NULL AND b IS NOT NULL"), ["a", "b"]) == Packing("a", 1, 1)
    assert found(frame, ["a", "b"]) == expected(keys)


def test_text_keys_and_an_empty_table(spark):
    frame = spark.createDataFrame([("x",), ("x",), (None,)], "k string")
    assert found(frame, ["k"]) == [("x", False, 2), (None, True, 1)]
    assert found(spark.createDataFrame([], "k bigint"), ["k"]) == []


def test_most_rows_of_one_key(spark):
    keys = [(i,) for i in range(4000)] + [(11,)] * 2000
    assert found(spark.createDataFrame(keys, "k bigint").repartition(5), ["k"]) == [(11, False, 2001)]


def test_the_shuffle_holds_bitmaps(spark):
    t = load_star(spark, "/root/testdata/sf0.01")
    ids = t.invoices().select("invoice_id")
    plan = repeated_keys(ids, ["invoice_id"])._jdf.queryExecution().toString()
    assert "left_semi" in plan.lower().replace("leftsemi", "left_semi")  # only rows of differing buckets are grouped
    assert rows(repeated_keys(ids, ["invoice_id"])) == []


def test_a_child_is_scanned_once_for_all_its_references(spark):
    t = load_star(spark, "/root/testdata/sf0.001")
    plan = Q.check_foreign_keys(t)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Expand") == 2  # invoice_line and product_category
    assert plan.count("l_partkey:bigint") == 1
