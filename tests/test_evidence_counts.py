"""The ceiling of distinct values: below, near and above it."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import aggregates


def rows(spark, distinct, times=3):
    return spark.range(distinct * times).select(F.lit("text").alias("kind"), (F.col("id") % distinct).cast("string").alias("value"))


@pytest.mark.parametrize("distinct, limit", [(1000, 1000), (999, 1000), (500, 1000), (1, 1), (1000, 1_000_000)])
def test_counts_below_and_at_the_ceiling(spark, distinct, limit):
    got = aggregates.evidence_counts(rows(spark, distinct), limit)
    assert got.columns == ["kind", "value", "n"] and got.count() == distinct and got.where("n <> 3").count() == 0


@pytest.mark.parametrize("distinct, limit", [(1001, 1000), (1050, 1000), (5000, 1000), (2, 1)])
def test_failure_above_the_ceiling(spark, distinct, limit):
    with pytest.raises(ValueError, match=f"more than {limit} values"):
        aggregates.evidence_counts(rows(spark, distinct), limit)


def test_far_above_it_fails_before_the_groups_are_formed(spark, monkeypatch):
    stored, made = aggregates.stored, []
    monkeypatch.setattr(aggregates, "stored", lambda df, name: made.append(name) or stored(df, name))
    with pytest.raises(ValueError):
        aggregates.evidence_counts(rows(spark, 5000), 100)
    assert made == ["evidence"]


def test_null_values_and_empty_rows(spark):
    some = spark.createDataFrame([("a", None), ("a", None), (None, "x")], "kind string, value string")
    assert sorted(map(str, map(tuple, aggregates.evidence_counts(some).collect()))) == ["('a', None, 2)", "(None, 'x', 1)"]
    assert aggregates.evidence_counts(some.limit(0)).count() == 0
