"""Set operators: change sets, subset and equality tests, member rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded_path, safe_path


def change_set(now: DataFrame, before: DataFrame, digests: DataFrame, old_digests: DataFrame) -> DataFrame:
    """Guides of the new state (guide, url, format) with their change: added,
    replaced (url or format differ), changed (any digest differs) or same."""
    old = before.select("guide", F.col("url").alias("old_url"), F.col("format").alias("old_format"), F.lit(True).alias("known"))
    cols = ["guide", "url", "digest"]
    differ = digests.select(*cols).exceptAll(old_digests.select(*cols)).unionByName(old_digests.select(*cols).exceptAll(digests.select(*cols))).select("guide").distinct().withColumn("differs", F.lit(True))
    out = now.join(old, "guide", "left").join(differ, "guide", "left")
    change = F.when(F.col("known").isNull(), "added").when((F.col("url") != F.col("old_url")) | (F.col("format") != F.col("old_format")), "replaced").when(F.col("differs"), "changed").otherwise("same")
    return out.select("guide", change.alias("change"))


def subset_violations(part: DataFrame, whole: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of part that are not in whole; none: it is a subset."""
    return part.select(*keys).exceptAll(whole.select(*keys))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, counted as multisets."""
    cols = left.columns
    return left.exceptAll(right.select(*cols)).withColumn("side", F.lit("left")).unionByName(right.select(*cols).exceptAll(left).withColumn("side", F.lit("right")))


def ordered_union(*parts: DataFrame) -> DataFrame:
    """Union with the ordinal (source, ord) that keeps reading order."""
    out = None
    for i, part in enumerate(parts):
        one = part.withColumn("source", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


def member_problems(members: DataFrame, name: str, size: str, limit: int) -> DataFrame:
    """Archive members that break a rule: unsafe, repeated, confusable; and
    one row if all together exceed the limit."""
    unsafe = members.where(~safe_path(F.col(name))).select(F.col(name).alias("name"), F.lit("unsafe").alias("problem"))
    repeated = members.groupBy(name).count().where("count > 1").select(F.col(name).alias("name"), F.lit("repeated").alias("problem"))
    folds = members.select(name).distinct().withColumn("fold", folded_path(F.col(name)))
    confusable = folds.groupBy("fold").agg(F.count("*").alias("n"), F.min(name).alias("name")).where("n > 1").select("name", F.lit("confusable").alias("problem"))
    large = members.agg(F.sum(size).alias("total")).where(F.col("total") > limit).select(F.lit("").alias("name"), F.lit("too large").alias("problem"))
    return unsafe.unionByName(repeated).unionByName(confusable).unionByName(large)
