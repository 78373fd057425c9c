"""As-of joins against DuckDB and brute force; one key over many partitions."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from docloom.operators.asof import asof_join
from docloom.operators.joins import nearest_releases


def brute(left, right, forward, strict):
    out = []
    for i, k, t in left:
        fits = [(rt, v) for rk, rt, v in right if k is not None and rk == k and t is not None and rt is not None and ((rt > t if strict else rt >= t) if forward else (rt < t if strict else rt <= t))]
        if not fits:
            out.append((i, k, t, None, None))
            continue
        near = (min if forward else max)(rt for rt, _ in fits)
        out.append((i, k, t, near, max((v for rt, v in fits if rt == near), key=lambda v: (v is not None, v))))
    return sorted(out, key=str)


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_equals_brute_force(spark, forward, strict):
    rng = random.Random(11)
    key = lambda: rng.choice(["hot"] * 8 + ["b", "c", None, "d"])
    time = lambda: rng.choice([None, *range(60)])
    left = [(i, key(), time()) for i in range(400)]
    right = [(key(), time(), rng.choice([None, "x", "y", "z"])) for _ in range(40)]
    l, r = spark.createDataFrame(left, "i int, k string, t int"), spark.createDataFrame(right, "k string, t int, v string")
    for parts in (1, 17):
        got = asof_join(l, r, ["k"], F.col("t"), F.col("t"), {"rt": "t", "v": "v"}, forward, strict, partitions=parts)
        assert got.columns == ["i", "k", "t", "rt", "v"]
        assert sorted(map(tuple, got.collect()), key=str) == brute(left, right, forward, strict)


def test_one_key_over_many_partitions_equals_duckdb(spark):
    # nearly all rows have one key, and long stretches have no right row
    left = spark.range(0, 20_000, 1, 4).select((F.col("id") % 50 == 7).cast("int").alias("k"), ((F.col("id") * 7919) % 100_003).alias("t"))
    right = spark.range(60).select((F.col("id") % 9 == 0).cast("int").alias("k"), (F.col("id") * F.col("id") * 29 % 90_000).alias("t"), F.col("id").alias("v")).dropDuplicates(["k", "t"])
    got = asof_join(left, right, ["k"], F.col("t"), F.col("t"), {"rt": "t", "v": "v"}, partitions=40).toPandas()
    l, r = left.toPandas(), right.toPandas()  # noqa: F841
    want = duckdb.sql("SELECT l.k, l.t, r.t AS rt, r.v FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.t >= r.t").df()
    order = ["k", "t", "rt", "v"]
    assert len(got) == 20_000 and got.sort_values(order).fillna(-1).astype(int).values.tolist() == want.sort_values(order).fillna(-1).astype(int).values.tolist()


def test_empty_sides_and_several_keys(spark):
    l = spark.createDataFrame([(1, "a", 5.0), (1, "b", 5.0), (2, "a", 5.0)], "x int, y string, t double")
    r = spark.createDataFrame([(1, "a", 4.0, None), (1, "b", 6.0, "v")], "x int, y string, t double, v string")
    got = asof_join(l, r, ["x", "y"], F.col("t"), F.col("t"), {"at": "t", "v": "v"})
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "a", 5.0, 4.0, None), (1, "b", 5.0, None, None), (2, "a", 5.0, None, None)]
    assert asof_join(l.limit(0), r, ["x", "y"], F.col("t"), F.col("t"), {"v": "v"}).count() == 0
    assert {r.v for r in asof_join(l, r.limit(0), ["x", "y"], F.col("t"), F.col("t"), {"v": "v"}).collect()} == {None}


def test_nearest_releases(spark):
    m = spark.createDataFrame([("g", "10.4", "a"), ("g", "10.10", "b"), ("g", "10.xxxx", "c"), ("h", "9", "d")], "guide string, release string, target string")
    w = spark.createDataFrame([("g", "10.9"), ("g", "10.10"), ("h", "9.0"), ("i", "1")], "guide string, release string")
    got = {(r.guide, r.release): (r.before, r.before_target, r.after, r.after_target) for r in nearest_releases(w, m, ["guide"]).collect()}
    assert got == {("g", "10.9"): ("10.4", "a", "10.10", "b"), ("g", "10.10"): ("10.4", "a", "10.xxxx", "c"), ("h", "9.0"): (None,) * 4, ("i", "1"): (None,) * 4}
