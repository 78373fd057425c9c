"""The incremental library: replays, restarts, untouched ranges, change sets."""

import os
import random

import pytest
from pyspark.sql import functions as F

from docloom.streaming.library import Library, run_stream

SCHEMA = "k int, v string, at int"


def state_of(library):
    return {r.k: (r.v, r.at) for r in library.read().collect()}


def test_batches_equal_the_newest_records(spark, tmp_path):
    rng = random.Random(3)
    library, want, kinds = Library(spark, str(tmp_path / "lib"), "k", "at", range_rows=20), {}, {}
    for n in range(5):
        batch = [(rng.randrange(120), rng.choice("xyz"), rng.randrange(9)) for _ in range(60)]
        assert library.upsert(spark.createDataFrame(batch, SCHEMA), n)
        newest = {}
        for k, v, at in batch:
            newest[k] = max(newest.get(k, (at, v)), (at, v))
        for k, new in newest.items():
            kinds[n, k] = "added" if k not in want else "changed" if new > want[k] else "same"
            want[k] = max(want.get(k, new), new)
        assert state_of(library) == {k: (v, at) for k, (at, v) in want.items()}
    assert {(r.batch, r.k): r.change for r in library.changes().collect()} == kinds and set(kinds.values()) == {"added", "changed", "same"}
    assert not library.upsert(spark.createDataFrame([(1, "late", 99)], SCHEMA), 4)  # done before
    manifest = library.manifest()
    assert len(manifest["bounds"]) > 3 and manifest["bounds"] == sorted(set(manifest["bounds"]))
    sizes = [spark.read.parquet(f"{library.target}/{p}").count() for p in manifest["paths"] if p]
    assert max(sizes) <= 20 and sum(sizes) == len(want)


def files_of(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet") and "/data-" in d}


def test_untouched_ranges_keep_their_files(spark, tmp_path):
    library = Library(spark, str(tmp_path / "lib"), "k", "at", range_rows=100)
    library.upsert(spark.range(1000).select(F.col("id").cast("int").alias("k"), F.lit("a").alias("v"), F.lit(1).alias("at")), 0)
    before, files = library.manifest(), files_of(library.target)
    library.upsert(spark.createDataFrame([(5, "new", 2), (7, "new", 2)], SCHEMA), 1)
    after, now = library.manifest(), files_of(library.target)
    assert before["bounds"] == after["bounds"] and sum(a != b for a, b in zip(before["paths"], after["paths"])) == 1
    assert files.items() <= now.items() and len(now) == len(files) + 1
    assert sorted((r.k, r.change) for r in library.changes().where("batch = 1").collect()) == [(5, "changed"), (7, "changed")]


def test_restart_goes_on_from_the_checkpoint(spark, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "ck")
    library = Library(spark, str(tmp_path / "lib"), "k", "at", range_rows=3)
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    put([(i, "a", 1) for i in range(8)])
    put([(3, "b", 2), (9, "b", 2)])
    run_stream(stream(), library, checkpoint)
    assert sorted(library.manifests()) == [0, 1]
    put([(3, "old", 1), (8, "c", 3)])
    run_stream(stream(), Library(spark, library.target, "k", "at", range_rows=3), checkpoint)
    assert sorted(library.manifests()) == [0, 1, 2]
    assert state_of(library) == {**{i: ("a", 1) for i in range(8)}, 3: ("b", 2), 9: ("b", 2), 8: ("c", 3)}
    assert {r.k: r.change for r in library.changes().where("batch = 2").collect()} == {3: "same", 8: "added"}


def test_a_batch_that_fails_changes_nothing(spark, tmp_path):
    library = Library(spark, str(tmp_path / "lib"), "k", "at")
    with pytest.raises(FileNotFoundError):
        library.read()
    library.upsert(spark.createDataFrame([(1, "a", 1)], SCHEMA), 0)
    with pytest.raises(Exception, match="a record without key"):
        library.upsert(spark.createDataFrame([(None, "b", 2), (1, "b", 2)], SCHEMA), 1)
    assert state_of(library) == {1: ("a", 1)} and sorted(library.manifests()) == [0]
    assert library.upsert(spark.createDataFrame([], SCHEMA), 1) and state_of(library) == {1: ("a", 1)}


def test_old_generations_go(spark, tmp_path):
    library = Library(spark, str(tmp_path / "lib"), "k", "at", keep=2)
    for n in range(4):
        library.upsert(spark.createDataFrame([(1, str(n), n)], SCHEMA), n)
    assert sorted(library.manifests()) == [2, 3] and len([d for d in os.listdir(library.target) if d.startswith("data-")]) == 2
    assert state_of(library) == {1: ("3", 3)} and library.changes().count() == 4
