"""Order-dependent operators: every source carries its ordinal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import numbered as number_sorted
from .trees import kept


def ordered_distinct(rows: DataFrame, value: str, order: str, limit: int | None = None) -> DataFrame:
    """Values in order of first occurrence, blanks dropped; optionally capped
    (the cap is the operator's)."""
    out = rows.where(F.trim(value) != "").groupBy(value).agg(F.min(order).alias(order))
    return out.orderBy(order).limit(limit) if limit else out


def first_by_key(rows: DataFrame, key: str, order: str, fill: str | None = None) -> DataFrame:
    """The first row of each key; an empty `fill` takes the first that is not
    empty. One aggregate with structs: no sort, partial on the map side."""
    others = [c for c in rows.columns if c not in (key, order)]
    aggs = [F.min(order).alias(order), F.min_by(F.struct(*others), order).alias("row_")]
    if fill:
        aggs.append(F.min_by(fill, F.when(F.col(fill) != "", F.col(order))).alias("fill_"))
    out = rows.groupBy(key).agg(*aggs).select(key, order, "row_.*", *(["fill_"] if fill else []))
    return out.withColumn(fill, F.coalesce("fill_", fill)).drop("fill_") if fill else out


def navigation(pages: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Previous and next value in each group."""
    w = Window.partitionBy(*by).orderBy(order)
    return pages.withColumns({"previous": F.lag(value).over(w), "next": F.lead(value).over(w)})


def carried_forward(rows: DataFrame, by: list[str], order: str, value: str, out: str) -> DataFrame:
    """The last value that was not null before each row."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(w))


def first_in_group(rows: DataFrame, by: list[str], order: str | list[str], n: int = 1) -> DataFrame:
    """The first n rows of each group, null orders last, as in SQL's ORDER BY
    of the queries; further columns of `order` settle ties."""
    w = Window.partitionBy(*by).orderBy(*(F.col(c).asc_nulls_last() for c in ([order] if isinstance(order, str) else order)))
    return rows.withColumn("rn_", F.row_number().over(w)).where(F.col("rn_") <= n).drop("rn_")


def descents(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value does not exceed the one before: none in a strictly
    ascending list."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("before", F.lag(value).over(w)).where(F.col(value) <= F.col("before"))


def parents(outline: DataFrame, by: list[str], deepest: int = 100) -> DataFrame:
    """A preorder list (ord, depth) with each row's parent: the last earlier
    row one level up. A running array holds the last row of every level."""
    w = Window.partitionBy(*by).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    levels = outline.agg(F.max("depth")).first()[0] or 0
    if levels > deepest:
        raise ValueError(f"outline deeper than {deepest}")
    parent = F.lit(None).cast("long")
    for d in range(1, levels + 1):
        parent = F.when(F.col("depth") == d, F.last(F.when(F.col("depth") == d - 1, F.col("ord")), ignorenulls=True).over(w)).otherwise(parent)
    return outline.withColumn("parent", parent)


def children(outline: DataFrame, by: list[str]) -> DataFrame:
    """Each row of a preorder list with its number of direct children."""
    linked = parents(outline, by)
    counts = linked.where("parent is not null").groupBy(*by, F.col("parent").alias("ord")).agg(F.count("*").alias("n_children"))
    return outline.join(counts, [*by, "ord"], "left").fillna(0, ["n_children"])


def boundary_repeats(lines: DataFrame, longest: int = 3) -> DataFrame:
    """Pages whose last k lines are the first k of the next page, k as large
    as possible up to `longest`: page, k, text. Only the lines at the borders
    meet, each with at most `longest` others."""
    ranked = number_sorted(lines.select("page", "ord", "text"), ["page"], ["ord", "text"], "nth")
    sizes = ranked.groupBy("page").agg((F.max("nth") + 1).alias("n"))
    last = ranked.join(sizes, "page").select("page", (F.col("n") - 1 - F.col("nth")).alias("i"), F.col("text").alias("end")).where(F.col("i") < longest)
    then = ranked.where(F.col("nth") < longest).select((F.col("page") - 1).alias("page"), F.col("nth").alias("j"), "text")
    # a repeat of k lines is k equal pairs of the i-th from the end and the j-th, i + j = k - 1
    met = last.join(then, "page").where((F.col("end") == F.col("text")) & (F.col("i") + F.col("j") < longest))
    found = met.groupBy("page", (F.col("i") + F.col("j") + 1).cast("int").alias("k")).agg(F.count("*").alias("pairs"), F.sort_array(F.collect_list(F.struct("j", "text"))).alias("held"))
    best = found.where("pairs = k").groupBy("page").agg(F.max_by(F.struct("k", "held"), "k").alias("best"))
    return best.select("page", "best.k", F.array_join(F.transform("best.held", lambda x: x["text"]), "\n").alias("text"))


def in_reading_order(lines: DataFrame) -> list[Column]:
    return [F.col("y0"), F.col("x0"), F.col("block"), F.col("ord")]


def numbered(rows: DataFrame, keys: list[str | Column], name: str) -> DataFrame:
    """rows numbered from 1 in the order of the keys, without one task that
    sees them all: ranges of the keys are sorted each, and the ranges' counts
    (one row per range) give the offsets."""
    ranges = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranges = kept(ranges.select("*", F.spark_partition_id().alias("part_"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row_")))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.groupBy("part_").agg(F.count("*").alias("n_")).select("part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("offset_"))
    return ranges.join(offsets, "part_").withColumn(name, F.col("row_") + F.col("offset_") + 1).drop("part_", "row_", "offset_")


def capped_total(rows: DataFrame, size: str, limit: int) -> DataFrame:
    """Total size and whether it exceeds the limit."""
    return rows.agg(F.sum(size).alias("total")).withColumn("over", F.col("total") > limit)
