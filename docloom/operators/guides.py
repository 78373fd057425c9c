"""Selection, replacement and verification of guides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exactly_one(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows, failing the run where a key has more than one: a lookup that must
    match exactly one entry."""
    return _bounded(rows, by, 1, "more than one entry")


def within(rows: DataFrame, by: list[str], limit: int) -> DataFrame:
    """rows, failing the run where a unit exceeds a hard ceiling."""
    return _bounded(rows, by, limit, f"more than {limit} entries")


def _bounded(rows: DataFrame, by: list[str], limit: int, message: str) -> DataFrame:
    """The count is an aggregate of keys; the join meets only the keys that are
    over the limit, of which the first fails the run."""
    over = rows.groupBy(*by).agg(F.count("*").alias("n_")).where(F.col("n_") > limit)
    failed = over.select(*(F.col(c).alias(f"{c}_") for c in by), F.raise_error(F.lit(message)).cast("boolean").alias("failed_"))
    found = rows.join(failed, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"{c}_")) for c in by)), "left")
    return found.where("failed_ is null").select(*rows.columns)


def choices(releases: DataFrame, documents: DataFrame) -> DataFrame:
    """Each release with its mapped and failed guides, and why it cannot be
    chosen (null: it can)."""
    counts = documents.groupBy("release").agg(F.count_if(F.col("error").isNull()).alias("mapped"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    out = releases.join(counts, "release", "left").fillna(0, ["mapped", "failed"])
    return out.withColumn("reason", F.when(F.col("mapped") > 0, None).when(F.col("failed") > 0, "every guide has an error").otherwise("no mapped guides"))


def split_available(documents: DataFrame, states: DataFrame) -> DataFrame:
    """documents with selected or skipped: only what is known to be missing is
    skipped; unknown stays selected."""
    out = documents.join(states, "guide", "left").withColumn("state", F.coalesce("state", F.lit("unknown")))
    return out.withColumn("decision", F.when(F.col("state") == "unavailable", "skipped").otherwise("selected"))


def replacements(candidates: DataFrame, mapped: DataFrame) -> DataFrame:
    """Candidates (guide, ord, origin, url) in order, without repeats of a URL
    and without the mapped URL itself."""
    other = candidates.join(mapped.select("guide", "url"), ["guide", "url"], "left_anti")
    return other.groupBy("guide", "url").agg(F.min("ord").alias("ord"), F.min_by("origin", "ord").alias("origin"))


def fragment_checks(links: DataFrame, ids: DataFrame, evidence: DataFrame) -> DataFrame:
    """links (page, target, fragment): ok, or error, warn or online by what is
    known of the target's bookmarks."""
    known = ids.select("target", "fragment").distinct().withColumn("there_", F.lit(True))
    out = links.join(known, ["target", "fragment"], "left").join(evidence, "target", "left")
    return out.select("page", "target", "fragment", F.when(F.col("fragment") == "", "ok").when(F.col("there_"), "ok").when(F.col("complete"), "error").when(F.col("complete").isNull(), "online").otherwise("warn").alias("result"))


def positional(left: DataFrame, right: DataFrame, by: list[str], order: str, key: str) -> DataFrame:
    """Rows at whose position the two sides differ."""
    a, b = left.select(*by, order, F.col(key).alias("left_key")), right.select(*by, order, F.col(key).alias("right_key"))
    return a.join(b, [*by, order], "full").where(~F.col("left_key").eqNullSafe(F.col("right_key")))


def propagated(references: DataFrame, assets: DataFrame, failures: DataFrame) -> DataFrame:
    """references (owner, url, kind) with the asset's file or its failure."""
    out = references.join(assets.select("url", "kind", "file"), ["url", "kind"], "left").join(failures.select("url", "kind", "failure"), ["url", "kind"], "left")
    return out.select("owner", "url", "kind", "file", F.when(F.col("file").isNull(), F.coalesce("failure", F.lit("not fetched"))).alias("failure"))


def at_least_one(left: DataFrame, right: DataFrame, on: Column, key: str) -> DataFrame:
    """Rows of left without any match in right."""
    return left.join(right, on, "left_anti").select(key)


def headings(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """Anchors whose text is exactly one block, with the next non-empty block
    of the page: (anchor, n, next)."""
    w = Window.partitionBy("page").orderBy("y0", "block").rowsBetween(1, Window.unboundedFollowing)
    rows = blocks.withColumn("next", F.first(F.nullif("text", F.lit("")), ignorenulls=True).over(w))
    found = anchors.join(rows, anchors["anchor"] == rows["text"], "left")
    return found.groupBy("anchor").agg(F.count("text").alias("n"), F.min("next").alias("next"))


def violations(rows: DataFrame, key: str, **rules: Column) -> DataFrame:
    """One row for each rule that a row breaks (a rule is true where it holds)."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())))
    return rows.select(key, F.explode(broken).alias("rule"))


def skipped_problems(skipped: DataFrame, retained: DataFrame) -> DataFrame:
    """Skipped guides (guide, retained) whose mark disagrees with the guides
    that the library still holds, and marked guides that it lists twice."""
    held = retained.select("guide").distinct().withColumn("held_", F.lit(True))
    met = skipped.join(held, "guide", "left").withColumn("held_", F.coalesce("held_", F.lit(False)))
    wrong = F.when(F.col("retained") & ~F.col("held_"), "retained guide is gone").when(~F.col("retained") & F.col("held_"), "guide is retained")
    return met.select("guide", wrong.alias("problem")).where("problem is not null")


# What a record of a missing image may say.
FAILURES = ("http-404", "http-410", "timeout", "retry-exhausted", "incomplete-body", "invalid-raster", "mime-mismatch")
RASTERS = ("png", "jpeg", "gif", "webp", "avif")


def missing_resource_problems(missing: DataFrame, topics: DataFrame) -> DataFrame:
    """Records of missing images (key, page, page_sha256, topic_url, element,
    failure, raster, status, placeholder) that their topic (path, sha256, url)
    does not bear out: key and problem."""
    known = topics.select(F.col("path").alias("page"), F.col("sha256").alias("s_"), F.col("url").alias("u_"))
    met = missing.join(known, "page", "left")
    wrong = (
        F.when(F.col("u_").isNull() | ~F.startswith("page", F.lit("pages/")), "page")
        .when(~F.col("s_").eqNullSafe(F.col("page_sha256")), "hash")
        .when(~F.col("u_").eqNullSafe(F.col("topic_url")), "topic")
        .when(~F.col("element").isin("img", "picture"), "element")
        .when(~F.col("failure").isin(*FAILURES) | ~F.col("raster").isin(*RASTERS), "class")
        .when(F.startswith("failure", F.lit("http-")) & (F.concat(F.lit("http-"), F.col("status").cast("string")) != F.col("failure")), "status")
        .when(~F.startswith("placeholder", F.lit("image-placeholder-")), "placeholder")
    )
    return met.select("key", wrong.alias("problem")).where("problem is not null")


def still_archived(unpublished: DataFrame, topics: DataFrame, key: str = "url") -> DataFrame:
    """Unpublished pages that are archived all the same."""
    return unpublished.join(topics.select(key).distinct(), key, "left_semi")


def print_destinations(links: DataFrame, aliases: DataFrame, ids: DataFrame, absent: DataFrame) -> DataFrame:
    """Links (referrer, key, fragment) with the bookmark of the combined
    document: the topic's anchor, or the printed id of the fragment. A fragment
    that the source is known to lack leads to the anchor, with a warning; any
    other missing one is an error; a key of two topics or none stays outside."""
    known = aliases.groupBy("key").agg(F.min("anchor").alias("anchor"), F.max("anchor").alias("other_")).where(F.col("anchor") == F.col("other_")).drop("other_")
    out = links.join(known, "key", "left").join(ids.select("anchor", "fragment", "printed"), ["anchor", "fragment"], "left")
    out = out.join(absent.select("anchor", "fragment").distinct().withColumn("absent_", F.lit(True)), ["anchor", "fragment"], "left")
    result = F.when(F.col("anchor").isNull(), "outside").when(F.col("fragment") == "", "topic").when(F.col("printed").isNotNull(), "bookmark").when(F.col("absent_"), "warning").otherwise("error")
    place = F.when(result == "bookmark", F.col("printed")).when(result.isin("topic", "warning"), F.col("anchor"))
    return out.select("referrer", "key", "fragment", place.alias("destination"), result.alias("result"))


def ordered_outcomes(jobs: DataFrame, results: DataFrame, by: str) -> DataFrame:
    """Results of a level's reads in the order of its jobs (ord): how many are
    done, and the first real error, whatever finished first; reads that were
    only cancelled are no errors."""
    met = jobs.join(results, [by, "ord"], "left")
    real = F.col("error").isNotNull() & (F.col("error") != "cancelled")
    return met.groupBy(by).agg(F.count("*").alias("jobs"), F.count_if(F.col("error").isNull() & F.col("value").isNotNull()).alias("done"), F.min_by(F.when(real, F.col("error")), F.when(real, F.col("ord"))).alias("error"))


def from_chunks(tree: DataFrame, chunks: DataFrame) -> DataFrame:
    """A module's tree (tree, node, depth, path) with the titles and links that
    its chunks hold for each index; an index without an entry, or with two
    different ones, is a problem."""
    entry = F.struct("title", "link")
    known = chunks.groupBy("tree", "node").agg(F.min(entry).alias("e_"), F.max(entry).alias("f_"))
    met = tree.join(known, ["tree", "node"], "left")
    problem = F.when(F.col("e_").isNull(), "no entry").when(F.col("e_") != F.col("f_"), "two entries")
    return met.select("tree", "node", "depth", "path", "e_.title", "e_.link", problem.alias("problem"))
