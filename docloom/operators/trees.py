"""Trees and graphs: preorder tables, recursive expansion, link closure.

Trees and closures are expanded level by level: the rows of a level are one
relation and a level is a join, never a loop over nodes at the driver. Depth is
bounded, the number of rows is not."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept

#: Deepest tree or chain that is accepted.
DEPTH = 100


def preorder(nodes: DataFrame) -> DataFrame:
    """(tree, node, depth, path) of the nodes (tree, node, parent, ord) that a
    root reaches; ordering by path is preorder. Level by level: a level is a
    join with the nodes, written to the shared folder, so neither rows nor
    plans pile up. A tree deeper than DEPTH fails, as a cycle below a root would."""
    level = kept(nodes.where("parent is null").select("tree", "node", F.lit(1).alias("depth"), F.array("ord").alias("path")))
    levels, below = [], nodes.where("parent is not null").select("tree", F.col("node").alias("child"), F.col("parent").alias("node"), "ord")
    for depth in range(2, DEPTH + 2):
        levels.append(level)
        found = below.join(level, ["tree", "node"])
        level = kept(found.select("tree", F.col("child").alias("node"), F.lit(depth).alias("depth"), F.array_append("path", F.col("ord")).alias("path")))
        if not level.limit(1).count():
            return reduce(DataFrame.unionByName, levels)
    raise ValueError(f"tree deeper than {DEPTH}")


def reachable(edges: DataFrame, roots: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Nodes that the roots reach, with the least number of steps. Level by
    level: each is the new neighbours of the last, so a cycle ends it; a level
    is written once and never again."""
    levels = [kept(roots.select("node").distinct().withColumn("steps", F.lit(0)))]
    for step in range(1, depth + 1):
        seen = reduce(DataFrame.unionByName, levels).select("node")
        found = edges.join(levels[-1].select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        level = kept(found.join(seen, "node", "left_anti").withColumn("steps", F.lit(step)))
        if not level.limit(1).count():
            return reduce(DataFrame.unionByName, levels)
        levels.append(level)
    raise ValueError(f"closure deeper than {depth}")


def chain(links: DataFrame, starts: DataFrame, stops: DataFrame, steps: int = 50) -> DataFrame:
    """Follow the link (src, dst) of each page from each start to a stop page,
    a page seen before or the end: start, step, node. A page on the way whose
    links conflict and a chain of more than `steps` pages fail the run."""
    ways = links.groupBy("src").agg(F.min("dst").alias("dst"), F.max("dst").alias("other")).withColumn("conflict", F.col("dst") != F.col("other"))
    ends = stops.select(F.col("node").alias("dst")).distinct()
    level = kept(starts.select(F.col("node").alias("start"), F.lit(0).alias("step"), "node"))
    seen = [level]
    for step in range(1, steps + 2):
        found = level.select("start", F.col("node").alias("src")).join(ways, "src")
        if found.where("conflict").limit(1).count():
            raise ValueError("a page has conflicting links")
        found = found.join(ends, "dst", "left_anti").select("start", F.lit(step).alias("step"), F.col("dst").alias("node"))
        level = kept(found.join(reduce(DataFrame.unionByName, seen).select("start", "node"), ["start", "node"], "left_anti"))
        if not level.limit(1).count():
            return reduce(DataFrame.unionByName, seen).where("step > 0")
        seen.append(level)
    raise ValueError(f"more than {steps} pages follow one another")


def metrics(tree: DataFrame, by: str) -> DataFrame:
    """Entries and greatest depth of each tree."""
    return tree.groupBy(by).agg(F.count("*").alias("entries"), F.max("depth").alias("max_depth"))


def descendants(tree: DataFrame) -> DataFrame:
    """(tree, node, path) with the number of rows below each: every row adds
    one to each of its ancestors, named by a prefix of its path."""
    ups = tree.select("tree", F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("n"), "path").where("size(path) > 1").select("tree", F.slice("path", F.lit(1), F.col("n")).alias("path"))
    counts = ups.groupBy("tree", "path").agg(F.count("*").alias("descendants"))
    return tree.join(counts, ["tree", "path"], "left").fillna(0, ["descendants"])


def first_target(tree: DataFrame, target: str) -> DataFrame:
    """Each row's own target, or the first one below it in reading order."""
    own = tree.where(F.col(target).isNotNull())
    ups = own.select("tree", F.col(target).alias("t_"), F.col("path").alias("at_"), F.explode(F.sequence(F.lit(1), F.size("path"))).alias("n"))
    best = ups.groupBy("tree", F.slice("at_", F.lit(1), F.col("n")).alias("path")).agg(F.min_by("t_", "at_").alias("resolved"))
    return tree.join(best, ["tree", "path"], "left")


def outline_problems(rows: DataFrame) -> DataFrame:
    """Linked outline (node, parent, prev, next, count): rows whose neighbours
    or counts do not agree."""
    a = rows.alias("a")
    after = a.join(rows.alias("b"), F.col("a.next") == F.col("b.node"), "left").where("a.next is not null and (b.prev is null or b.prev != a.node or not (b.parent <=> a.parent))").select("a.node", F.lit("next").alias("problem"))
    counts = rows.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n"))
    wrong = rows.join(counts, "node", "left").where(F.coalesce("n", F.lit(0)) != F.col("count")).select("node", F.lit("count").alias("problem"))
    return after.unionByName(wrong)


def without(tree: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The tree without unpublished pages, and whether any was dropped."""
    return tree.join(gone.select(key).distinct(), key, "left_anti")
