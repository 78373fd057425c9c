from datetime import datetime

from docloom.streaming import state


def _run(spark, rows, schema, make, tmp_path):
    source = str(tmp_path / "in")
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = make(stream).writeStream.format("memory").queryName("out").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table("out").collect()


def test_pacing_keeps_a_gap_by_origin(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [[("a", 1, t), ("a", 2, t), ("b", 3, t)], [("a", 4, t)]]
    got = _run(spark, rows, "origin string, id long, at timestamp", lambda s: state.paced(s, 2.0), tmp_path)
    starts = sorted((r.start - t).total_seconds() for r in got if r.origin == "a")
    assert starts == [0.0, 2.0, 4.0]


def test_budget_counts_across_batches(spark, tmp_path):
    rows = [[("j", 1), ("j", 2)], [("j", 3), ("k", 4)]]
    got = _run(spark, rows, "job string, id long", lambda s: state.budgeted(s, 2), tmp_path)
    assert sum(r.allowed for r in got if r.job == "j") == 2 and all(r.allowed for r in got if r.job == "k")


def test_upsert_keeps_the_newest(spark, tmp_path):
    target = str(tmp_path / "library")
    write = state.upsert_each_batch(target, "k", "ord")
    write(spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, ord int, v string"), 0)
    write(spark.createDataFrame([("a", 2, "z")], "k string, ord int, v string"), 1)
    assert sorted((r.k, r.v) for r in spark.read.parquet(target).collect()) == [("a", "z"), ("b", "y")]
