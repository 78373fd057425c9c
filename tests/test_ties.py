"""Rows that an order leaves equal: the one that stands first in the table."""

import duckdb
import pytest
from oracle import compare
from pyspark.sql import functions as F

from docloom import plans


def table_of(folder, rows):
    """lineitem of (order, part, supplier, line), beside the other tables."""
    c = duckdb.connect()
    c.sql("CREATE TABLE t (l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT)")
    c.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", rows)
    c.sql(f"COPY t TO '{folder}/lineitem.parquet'")
    import oracle

    for t in oracle.TABLES:
        if t != "lineitem":
            (folder / f"{t}.parquet").symlink_to(f"{oracle.SF}/{t}.parquet")
    return str(folder)


ROWS = {
    "parts beyond a million": [(1, 1_500_000, 1, 1), (1, 400_000, 1, 2), (2, 3, 1, 7), (2, 2_000_001, 1, 6)],
    "equal orders": [(1, 1_500_000, 1, 1), (1, 500_000, 1, 2), (2, 500_000, 1, 2), (2, 1_500_000, 1, 1)],
    "equal lines": [(1, 20, 5, 2), (1, 10, 5, 2), (1, 30, 5, 2), (2, 10, 5, 1), (2, 20, 5, 1), (2, 5, 6, 1)],
    "nulls": [(1, None, 1, 3), (1, 7, 1, None), (1, 9, 1, 2), (2, 5, 1, None), (3, 6, 1, 4)],
}


@pytest.mark.parametrize("name", ["r7_incremental_upsert", "w8_duplicate_ids"])
@pytest.mark.parametrize("case", [c for c in ROWS if c != "nulls"])
def test_ties(spark, tmp_path, name, case):
    compare(spark, plans.QUERIES[name], plans.SQL[name], table_of(tmp_path, ROWS[case]))


def test_upsert_of_nulls(spark, tmp_path):
    compare(spark, plans.QUERIES["r7_incremental_upsert"], plans.SQL["r7_incremental_upsert"], table_of(tmp_path, ROWS["nulls"]))


def test_lines_without_a_number_come_last(spark, tmp_path):
    """Spark's own order would put them first."""
    compare(spark, plans.QUERIES["w8_duplicate_ids"], plans.SQL["w8_duplicate_ids"], table_of(tmp_path, ROWS["nulls"]))


def test_first_rows_of_a_group_with_null_orders(spark):
    from docloom.operators import ordered

    rows = spark.createDataFrame([("a", None), ("a", 3), ("a", 1), ("b", None)], "g string, k int")
    assert sorted(map(tuple, ordered.first_in_group(rows, ["g"], "k", 2).collect()), key=str) == [("a", 1), ("a", 3), ("b", None)]


def test_place_follows_files_and_rows(spark, tmp_path):
    from docloom.plans.registry import placed

    spark.range(60).repartitionByRange(3, "id").sortWithinPartitions(F.desc("id")).write.parquet(f"{tmp_path}/t.parquet")
    got = [r.id for r in placed(spark, str(tmp_path), "t").repartition(4).orderBy("place").collect()]
    want = [x for f in sorted((tmp_path / "t.parquet").glob("*.parquet")) for (x,) in duckdb.sql(f"SELECT id FROM '{f}'").fetchall()]
    assert got == want


def test_equal_lines_of_many_files(spark, tmp_path):
    """Spark deals out large files first: rows meet in another order."""
    (tmp_path / "lineitem.parquet").mkdir()
    for name, rows in (("a", "SELECT 1 AS o, 20 AS p"), ("b", "SELECT 1 AS o, 10 AS p UNION ALL SELECT range + 2, range FROM range(5000)")):
        duckdb.sql(f"COPY (SELECT o::BIGINT AS l_orderkey, p::BIGINT AS l_partkey, 5::BIGINT AS l_suppkey, 2::INT AS l_linenumber FROM ({rows})) TO '{tmp_path}/lineitem.parquet/{name}.parquet'")
    got = plans.QUERIES["w8_duplicate_ids"](spark, str(tmp_path))
    assert [tuple(r) for r in got.where("l_orderkey = 1").collect()] == [(1, 20, 2)] and got.count() == 5001
