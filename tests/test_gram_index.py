"""Searches by the gram index find the rows of the scan, whatever the term."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import gram_index, search
from docloom.operators.gram_index import GramIndex

WORDS = ["alpha", "Beta", "ﬁx", "naïve", "ét́", "STRASSE", "straße", "日本語", "🙂🙂", "ab", "a", "x" * 50, "ẞ", "ＡＢＣ", "tab\tbed", "line\nbreak", ""]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    out = [(i, rng.choice(["g1", "G2", None]), rng.choice(["Title", None, "β title"]), rng.choice(["a/b.html", "../x", "c.html"]), " ".join(rng.choice(WORDS) for _ in range(rng.randrange(12)))) for i in range(400)]
    out += [(400, "g1", None, "a", None), (401, None, None, "a", ""), (70_000, "g1", "far", "a", "alpha far away"), (3_000_000, "g1", "farther", "a", "alpha beta gamma"), (7, "twin", "Title", "a", "alpha twin")]
    return spark.createDataFrame(out, "ord long, guide string, title string, url string, text string").cache()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return str(tmp_path_factory.mktemp("grams"))


QUERIES = ["alpha", "alpha far", "Beta FIX", "ﬁx", "ét́", "ét", "straße", "ss", "日本", "日", "🙂", "a", "b", "x" * 50, "x" * 51, "ab alpha", "abc", "bed", "k b", "zzz", "zz", "z", "", "  ", "alpha twin", "title", "g2", "gamma", "́"]


@pytest.mark.parametrize("ascii_only", [False])
def test_release_search_equals_the_scan(spark, rows, folder, ascii_only):
    index = GramIndex.build(rows, search.release_text(ascii_only), f"{folder}/release", buckets=4)
    for q in QUERIES:
        want = [tuple(r) for r in search.release_search(rows, q).collect()]
        got = search.release_search_indexed(index, q)
        assert sorted(map(str, map(tuple, got.select(*rows.columns, "snippet", "n_matches").collect()))) == sorted(map(str, want)), q


def test_guide_search_equals_the_scan(spark, rows, folder):
    GramIndex.build(rows, search.guide_text(), f"{folder}/guide")
    index = GramIndex(spark, f"{folder}/guide")  # opened again
    for q in [*QUERIES, "beta alpha", "alpha  beta", "e alpha"]:
        want = [tuple(r) for r in search.guide_search(rows, q, 1000).collect()]
        got = search.guide_search_indexed(index, q, 1000).select(*rows.columns)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)), q


def test_plan_reads_the_postings_of_the_grams_only(spark, rows, folder):
    index = GramIndex.build(rows, search.release_text(), f"{folder}/plan", buckets=8)
    grams = gram_index.grams_of("alpha")
    plan = index.read(grams)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "PushedFilters" in plan and "In(gram" in plan
    files = {r[0].split("/bucket=")[1].split("/")[0] for r in index.read(grams).select(F.input_file_name()).distinct().collect()}
    keys = spark.createDataFrame([(g,) for g in grams], "gram long").select(F.pmod(F.hash("gram"), F.lit(8)).cast("string"))
    assert files <= {r[0] for r in keys.collect()} and len(files) < 8
    counted = index.read(grams).groupBy("gram").agg(F.sum("n"))._jdf.queryExecution().executedPlan().toString()
    assert "held" not in counted.split("ReadSchema")[1]


def test_the_rarest_grams_are_chosen(spark, rows, folder):
    index = GramIndex.build(rows, search.release_text(), f"{folder}/rare")
    assert index.chosen(["nosuchterm"]) is None
    n = index.counts(gram_index.grams_of("alpha far"))
    chosen = index.chosen(["alpha far"])
    assert len(chosen) <= gram_index.MOST and chosen[0] == min(n, key=lambda g: (n[g], g))
    # candidates hold every match, and few others
    assert {r.ord for r in index.candidates(["alpha far"]).collect()} == {70_000}


def test_containers():
    for n in (0, 1, 4096, 4097, 65_536):
        low = np.sort(np.random.default_rng(n).choice(65_536, n, replace=False))
        held = gram_index.to_container(low)
        assert len(held) <= 8193 and (gram_index.from_container(held) == low).all()


def test_text_grams_are_all_positions():
    text = "a🙂bcé"
    grams = gram_index.text_grams(text)
    padded = text + "\0\0"
    assert set(grams.tolist()) == {gram_index.packed(list(map(ord, padded[i : i + 3]))) for i in range(len(text))}
    low, high = gram_index.range_of("é")
    assert sum(low <= g < high for g in grams) == 1


def test_empty_index_and_rows_without_ordinal(spark, rows, folder):
    index = GramIndex.build(rows.limit(0), search.release_text(), f"{folder}/none")
    assert search.release_search_indexed(index, "alpha").count() == 0
    with pytest.raises(Exception, match="a row without an ordinal"):
        GramIndex.build(rows.withColumn("ord", F.lit(None).cast("long")), search.release_text(), f"{folder}/null")


def test_hay_of_the_index_is_the_scan_text(spark, rows, folder):
    index = GramIndex.build(rows, search.release_text(), f"{folder}/hay")
    for r in index.rows.select("guide", "title", "text", "hay").collect():
        assert r.hay == unicodedata.normalize("NFKC", " ".join(x for x in (r.guide, r.title, r.text) if x is not None)).lower()
