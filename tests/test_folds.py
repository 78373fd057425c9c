"""Sorted folds: groups cut over partitions, a million rows in one group, null
groups, ties, empty tables."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from docloom.functions import rewrite
from docloom.operators import aggregates, folds
from docloom.sources import catalogue, sinks


def test_numbers_of_groups_cut_over_partitions(spark):
    rng = random.Random(4)
    data = [(rng.choice(["a", "a", "a", "a", "b", None, "c"]), rng.randrange(50), i) for i in range(3000)]
    rows = spark.createDataFrame(data, "g string, k int, i long")
    got = folds.numbered(rows, ["g"], ["k", "i"], partitions=23).collect()
    groups = {}
    for g, k, i in data:
        groups.setdefault(g, []).append((k, i))
    want = {(g, k, i): n for g, vs in groups.items() for n, (k, i) in enumerate(sorted(vs))}
    assert len(got) == len(data) and all(want[r.g, r.k, r.i] == r.nth for r in got)
    assert folds.numbered(rows.limit(0), ["g"], ["k"]).count() == 0
    two = folds.numbered(rows, ["g", "k"], ["i"], partitions=9).groupBy("g", "k").agg(F.max("nth").alias("m"), F.count("*").alias("n"))
    assert two.where("m <> n - 1").count() == 0


def test_equal_rows_are_numbered_each(spark):
    rows = spark.range(500).select(F.lit("g").alias("g"), F.lit(1).alias("k"))
    assert sorted(r.nth for r in folds.numbered(rows, ["g"], ["k"], partitions=7).collect()) == list(range(500))


def test_a_group_of_a_million_rows_is_in_no_cell(spark):
    files = spark.range(0, 1_000_000, 1, 8).select(F.when(F.col("id") < 999_990, "big").otherwise("small").alias("root"), F.format_string("f%07d", "id").alias("path"), F.col("id").cast("string").alias("sha256"))
    parts = folds.sorted_parts(files, ["root"], ["path"], F.col("path"), "\n", partitions=16)
    top = parts.agg(F.max(F.length("text")).alias("chars"), F.count("*").alias("n")).first()
    assert top.n == 1001 and top.chars == 1000 * 9 - 1
    digests = {r.root: r.digest for r in catalogue.tree_digest(files, "root").collect()}
    want = hashlib.sha256()
    for i in range(999_990):
        want.update((b"\n" if i else b"") + f"f{i:07d}\t{i}".encode())
    assert digests["big"] == want.hexdigest()
    assert digests["small"] == hashlib.sha256("\n".join(f"f{i:07d}\t{i}" for i in range(999_990, 1_000_000)).encode()).hexdigest()


def test_no_collected_groups_in_the_plans(spark):
    files = spark.createDataFrame([("g", "p", "s", 1)], "guide string, path string, sha256 string, size long")
    for df in (catalogue.tree_digest(files, "guide"), sinks.manifest_parts(files, "guide"), aggregates.affected_topics(files, "guide", "path")):
        assert "collect_" not in df._jdf.queryExecution().optimizedPlan().toString()


def text_of(parts, group):
    out = {}
    for r in sorted(parts.collect(), key=lambda r: (str(r[group]), r.part)):
        out[r[group]] = out.get(r[group], "") + r.text
    return out


def test_manifest_and_index_parts_make_the_documents(spark):
    rng = random.Random(9)
    data = [(rng.choice(["g1", "g2", None]), f'p"{i}\\', f"h{i}", rng.randrange(99)) for i in range(2500)] + [("g3", "only", "h", 5), ("g3", "only", "h", 5)]
    files = spark.createDataFrame(data, "guide string, path string, sha256 string, size long")
    whole = {r.guide: r.manifest for r in sinks.manifest_json(files, "guide").collect()}
    parts = text_of(sinks.manifest_parts(files, "guide"), "guide")
    assert parts == whole
    assert json.loads(parts["g3"])["files"] == [{"path": "only", "sha256": "h", "size": 5}] * 2
    topics = files.withColumn("ord", F.monotonically_increasing_id()).withColumn("title", F.concat(F.lit("<&>"), "path")).where("guide is not null")
    want = {r.guide: r.html for r in rewrite.index_page(topics, "guide", "ord", "title", "path").collect()}
    assert text_of(rewrite.index_parts(topics, "guide", "ord", "title", "path"), "guide") == want
    assert sinks.manifest_parts(files.limit(0), "guide").count() == 0


def test_evidence_skips_pages_and_goes_on(spark):
    rng = random.Random(5)
    data = [(g, p, f"id{rng.randrange(40)}") for g in ("a", "b") for p in range(80) for _ in range(rng.randrange(1, 14))]
    marks = spark.createDataFrame(data, "guide string, ord int, id string")
    got = {(r.guide, r.ord): (r.ids, r.complete) for r in aggregates.evidence(marks, 8, 100).collect()}
    pages = {}
    for g, p, i in data:
        pages.setdefault((g, p), set()).add(i)
    used = {"a": 0, "b": 0}
    for key in sorted(pages):
        fits = len(pages[key]) <= 8 and used[key[0]] + len(pages[key]) <= 100
        used[key[0]] += len(pages[key]) if fits else 0
        assert got[key] == ((sorted(pages[key]) if fits else []), fits)
    assert len(got) == len(pages) and min(used.values()) > 80
    assert aggregates.evidence(marks.limit(0), 8, 100).count() == 0


def test_affected_topics_are_distinct_and_in_order(spark):
    uses = spark.createDataFrame([("s1", "b"), ("s1", "a"), ("s1", "b"), ("s2", None), (None, "z")], "style string, topic string")
    assert sorted(map(str, map(tuple, aggregates.affected_topics(uses, "style", "topic").collect()))) == sorted(map(str, [("s1", "a", 0), ("s1", "b", 1), ("s2", None, 0), (None, "z", 0)]))


def test_running_sums_over_all_rows(spark):
    rng = random.Random(8)
    data = [(rng.randrange(30), i, rng.randrange(4)) for i in range(2000)]
    got = folds.numbered(spark.createDataFrame(data, "k int, i int, w long"), [], ["k", "i"], "sum", partitions=11, weight="w").collect()
    before, want = 0, {}
    for k, i, w in sorted(data):
        want[i], before = before, before + w
    assert {r.i: r.sum for r in got} == want
    by = folds.numbered(spark.createDataFrame(data, "k int, i int, w long"), ["k"], ["i"], "sum", partitions=11, weight="w").collect()
    assert all(r.sum == sum(w for k, i, w in data if k == r.k and i < r.i) for r in by)


def test_a_digest_is_handed_on_between_tasks_that_read_a_segment_each(spark, monkeypatch):
    """no task reads a whole large group; the digests stay those of the whole."""
    read, fold = [], folds.fold_sorted

    def spy(rows, by, order, state, columns, results):
        read.append(rows.groupBy(*by).agg(F.sum(F.octet_length(columns[0])).alias("n")).agg(F.max("n")).first()[0] or 0)
        return fold(rows, by, order, state, columns, results)

    monkeypatch.setattr(folds, "fold_sorted", spy)
    monkeypatch.setattr(folds, "SEGMENT", 1500, raising=False)
    monkeypatch.setattr(folds, "PIECE", 300, raising=False)
    lines = lambda g, n: [(g, i, ("é" * (i % 90)) + str(i) if i % 7 else "") for i in range(n)]
    data = [*lines("large", 60), *lines("small", 3), *lines(None, 30), *lines("one", 1)]
    got = folds.sorted_digest(spark.createDataFrame(data, "g string, i int, t string").repartition(5), ["g"], ["i"], F.col("t"), "\n")
    want = {g: hashlib.sha256("\n".join(t for k, _, t in data if k == g).encode()).hexdigest() for g in ("large", "small", None, "one")}
    assert {r.g: r.digest for r in got.collect()} == want
    assert max(read) <= 1500 + 200
    assert folds.sorted_digest(spark.createDataFrame([], "g string, i int, t string"), ["g"], ["i"], F.col("t")).count() == 0


def test_digests_are_the_same_where_states_cannot_be_handed_on(spark, monkeypatch):
    monkeypatch.setattr(folds, "_resumable", lambda: False)
    rows = spark.createDataFrame([("a", i, str(i)) for i in range(50)] + [("b", 0, "x")], "g string, i int, t string")
    got = {r.g: r.digest for r in folds.sorted_digest(rows, ["g"], ["i"], F.col("t"), "-").collect()}
    assert got == {"a": hashlib.sha256("-".join(map(str, range(50))).encode()).hexdigest(), "b": hashlib.sha256(b"x").hexdigest()}


def test_parts_of_a_large_group_are_joined_where_their_rows_lie(spark, monkeypatch):
    """only stretches on the border of two tasks are shuffled after the sort."""
    moved, fold = [], folds.fold_sorted

    def spy(rows, by, order, state, columns, results):
        moved.append(rows.agg(F.sum(F.octet_length(columns[0])).alias("n")).first()[0] or 0)
        return fold(rows, by, order, state, columns, results)

    monkeypatch.setattr(folds, "fold_sorted", spy)
    files = spark.range(0, 200_000, 1, 4).select(F.lit("g").alias("guide"), F.format_string("p%07d", "id").alias("path"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"), "id").withColumnRenamed("id", "size")
    parts = sinks.manifest_parts(files, "guide")
    whole = parts.agg(F.sum(F.octet_length("text")).alias("n"), F.count("*").alias("rows")).first()
    assert whole.rows == 202 and moved[-1] < whole.n / 10
    assert text_of(parts, "guide")["g"] == sinks.manifest_json(files, "guide").first().manifest


def test_parts_cut_at_the_borders_of_files_and_batches(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "a", "a", None, *"bcdefgh"]), i, None if i % 50 == 7 else f"t{i}") for i in range(3000)] + [(f"one{i}", i, "x") for i in range(300)] + [("nothing", i, None) for i in range(9)]
    groups = {}
    for g, i, t in data:
        groups.setdefault(g, []).append((i, t))
    want = {}
    for g, rows in groups.items():
        for at in range(0, len(rows), 7):
            want[g, at // 7] = ",".join(t for _, t in sorted(rows)[at : at + 7] if t is not None)
    rows = spark.createDataFrame(data, "g string, i long, t string").repartition(3)
    try:
        for batch in ("1", "5", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            got = [((r.g, r.part), r.text) for r in folds.sorted_parts(rows, ["g"], ["i"], F.col("t"), ",", 7, partitions=13).collect()]
            assert len(got) == len(want) and dict(got) == want
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")  # several files' pieces in a task, files cut
        assert {(r.g, r.part): r.text for r in folds.sorted_parts(rows, ["g"], ["i"], F.col("t"), ",", 7, partitions=2).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_manifests_keep_checksums_of_any_form(spark):
    sums = ["ab" * 32, "AB" * 32, "abc", "", None, "xyz", "ab", "abcd", "0b", "0B", "b"]
    files = spark.createDataFrame([("g", p, s, n) for p in ("p", "q") for n in (1, 2) for s in sums], "guide string, path string, sha256 string, size long")
    assert text_of(sinks.manifest_parts(files, "guide"), "guide")["g"] == sinks.manifest_json(files, "guide").first().manifest
