"""Aggregating operators; all but the arrays they return are partial on the
map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.shared import stored
from .folds import numbered, within_budget

#: Notice kinds in the order of a summary, with singular and plural (fixed).
NOTICE_LABELS = [
    ("external-link-retained", "external link retained", "external links retained"),
    ("navigation-style-omitted", "navigation style omitted", "navigation styles omitted"),
    ("css-cleanup", "CSS cleanup", "CSS cleanup"),
    ("source-policy", "source policy", "source policy"),
    ("publisher-link-corrected", "publisher link correction", "publisher link correction"),
]


def count_map_text(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """`a (2), b (1)`: counts by value as one sorted text."""
    by = by or []
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    items = F.sort_array(F.collect_list(F.struct(F.col(value).alias("v"), "n")))
    return counts.groupBy(*by).agg(F.array_join(F.transform(items, lambda x: F.concat(x["v"], F.lit(" ("), x["n"].cast("string"), F.lit(")"))), ", ").alias("summary"))


def notice_summary(notices: DataFrame, by: str) -> DataFrame:
    """Distinct notices by group, counted by kind in a fixed order."""
    distinct = notices.where((F.col("kind") != "") & (F.trim("message") != "")).select(by, "kind", "message").distinct()
    counted = distinct.groupBy(by).agg(F.count("*").alias("n"), *(F.count_if(F.col("kind") == k).alias(f"n_{i}") for i, (k, _, _) in enumerate(NOTICE_LABELS)))
    known = sum((F.col(f"n_{i}") for i in range(1, len(NOTICE_LABELS))), F.col("n_0"))
    part = lambda n, one, many: F.when(n > 0, F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many)))
    parts = F.array_compact(F.array(*(part(F.col(f"n_{i}"), one, many) for i, (_, one, many) in enumerate(NOTICE_LABELS)), part(F.col("n") - known, "other", "other")))
    label = F.when(F.col("n") == 1, "publisher notice").otherwise("publisher notices")
    return counted.select(by, F.concat(F.col("n").cast("string"), F.lit(" "), label, F.lit(" ("), F.array_join(parts, "; "), F.lit(")")).alias("summary"))


def mix(rows: DataFrame, by: list[str], **conditions: Column) -> DataFrame:
    """Conditional counts by group."""
    return rows.groupBy(*by).agg(*(F.count_if(c).alias(name) for name, c in conditions.items()))


def blocks(lines: DataFrame) -> DataFrame:
    """Text, enclosing box and largest font of each block."""
    texts = F.sort_array(F.collect_list(F.struct("ord", "text")))
    return lines.groupBy("page", "block").agg(F.array_join(F.transform(texts, lambda x: x["text"]), " ").alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("font").alias("font"))


def repeated_texts(lines: DataFrame, more_than: int, least_chars: int = 20, least_font: float = 14.0) -> DataFrame:
    """Large texts on more pages than allowed."""
    large = lines.where((F.char_length("text") >= least_chars) & (F.col("font") >= least_font)).select("text", "page").distinct()
    often = large.groupBy("text").agg(F.count("*").alias("n_")).where(F.col("n_") > more_than).select("text")
    return large.join(often, "text", "left_semi").groupBy("text").agg(F.sort_array(F.collect_list("page")).alias("pages"))


def page_frequency(lines: DataFrame, value: str = "text", page: str = "page") -> DataFrame:
    return lines.groupBy(value).agg(F.count_distinct(page).alias("pages"))


def evidence(bookmarks: DataFrame, page_cap: int, guide_cap: int) -> DataFrame:
    """Sorted ids of each page (guide, ord, id), all or nothing: a page over
    its cap is left out, and so is one that would take the guide over its cap;
    later smaller pages may still fit. The fold sees one number per page; the
    ids of a page are gathered only where they fit."""
    distinct = bookmarks.select("guide", "ord", "id").distinct()
    sizes = distinct.groupBy("guide", "ord").agg(F.count("id").cast("int").alias("n"))
    kept = within_budget(sizes, "guide", "ord", "n", page_cap, guide_cap).withColumn("complete", F.lit(True))
    pages = sizes.join(kept, ["guide", "ord"], "left").select("guide", "ord", F.coalesce("complete", F.lit(False)).alias("complete"))
    held = distinct.join(kept.drop("complete"), ["guide", "ord"], "left_semi").groupBy("guide", "ord").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    return pages.join(held, ["guide", "ord"], "left").select("guide", "ord", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"), "complete")


def affected_topics(uses: DataFrame, style: str, topic: str) -> DataFrame:
    """The distinct topics of each style in order, one row each: (style, nth,
    topic). A style that all topics use is spread over ranges."""
    return numbered(uses.select(style, topic).distinct(), [style], [topic])


def footer_audit(lines: DataFrame, pages: DataFrame, limit: float) -> DataFrame:
    """Pages without exactly one number and one label below a height."""
    low = lines.where(F.col("y0") >= limit)
    number = F.col("text").rlike(r"^(\d+|(?i)[ivxlcdm]+)$")
    counts = low.groupBy("page").agg(F.count_if(number).alias("numbers"), F.count_if(~number).alias("labels"))
    return pages.join(counts, "page", "left").fillna(0, ["numbers", "labels"]).withColumn("ok", (F.col("numbers") == 1) & (F.col("labels") == 1))


def report(**violations: DataFrame) -> DataFrame:
    """One row per rule with its number of violations; passed: none at all."""
    out = None
    for rule, rows in violations.items():
        one = rows.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("passed", F.col("violations") == 0)


def evidence_counts(rows: DataFrame, limit: int = 5_000_000, error: float = 0.02) -> DataFrame:
    """How often each (kind, value) of a source occurs; the run fails if there
    are more than `limit` distinct ones. The rows are made once, and a sketch
    counts the distinct ones as they are written: far above the limit the run
    fails before anything is shuffled, far below it nothing is counted again,
    and near it (five standard errors) the groups are counted exactly."""
    seen = Observation()
    pair = F.struct("kind", "value")
    held = stored(rows.select("kind", "value").observe(seen, F.approx_count_distinct(pair, error).alias("n")), "evidence")
    guess, near = seen.get["n"], 5 * error * limit
    if guess > limit + near:
        raise ValueError(f"more than {limit} values")
    counts = held.groupBy("kind", "value").agg(F.count("*").alias("n"))
    if guess < limit - near:
        return counts
    counts = stored(counts, "evidence-counts")
    if counts.count() > limit:
        raise ValueError(f"more than {limit} values")
    return counts
