"""Queries of trees and graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import guides as O
from ..operators import outlines as L
from ..operators import trees as G
from ..operators.folds import numbered
from .registry import query, rows, table

#: Region, nation, customer as one tree.
TREE = """SELECT 'w' AS tree, 'r' || r_regionkey AS node, CAST(NULL AS VARCHAR) AS parent, r_regionkey AS ord FROM region
UNION ALL SELECT 'w', 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey FROM nation
UNION ALL SELECT 'w', 's' || s_suppkey, 'n' || s_nationkey, CAST(s_suppkey AS INT) FROM supplier"""
WALK = f"""WITH RECURSIVE e AS ({TREE}), t AS (SELECT tree, node, 1 AS depth, [CAST(ord AS INT)] AS path FROM e WHERE parent IS NULL
UNION ALL SELECT e.tree, e.node, t.depth + 1, list_append(t.path, CAST(e.ord AS INT)) FROM t JOIN e ON e.tree = t.tree AND e.parent = t.node)"""


def nodes(spark, d):
    part = lambda name, prefix, key, up: table(spark, d, name).select(F.lit("w").alias("tree"), F.concat(F.lit(prefix), F.col(key).cast("string")).alias("node"), up.alias("parent"), F.col(key).cast("int").alias("ord"))
    return part("region", "r", "r_regionkey", F.lit(None).cast("string")).unionByName(part("nation", "n", "n_nationkey", F.concat(F.lit("r"), F.col("n_regionkey").cast("string")))).unionByName(part("supplier", "s", "s_suppkey", F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))))


@query("t2_t9_preorder", f"{WALK} SELECT * FROM t")
def t9(spark, d):
    return G.preorder(nodes(spark, d))


@query("a10_tree_metrics", f"{WALK} SELECT tree, count(*) AS entries, max(depth) AS max_depth FROM t GROUP BY 1")
def a10(spark, d):
    return G.metrics(G.preorder(nodes(spark, d)), "tree")


@query("t10_descendants", f"{WALK} SELECT a.node, (SELECT count(*) FROM t b WHERE len(b.path) > len(a.path) AND b.path[1:len(a.path)] = a.path) AS descendants FROM t a")
def t10(spark, d):
    return G.descendants(G.preorder(nodes(spark, d))).select("node", "descendants")


@query("t11_first_target", f"{WALK}, k AS (SELECT *, CASE WHEN node LIKE 's%' THEN node END AS target FROM t) SELECT a.node, (SELECT arg_min(b.target, b.path) FROM k b WHERE b.target IS NOT NULL AND b.path[1:len(a.path)] = a.path) AS resolved FROM k a")
def t11(spark, d):
    t = G.preorder(nodes(spark, d)).withColumn("target", F.when(F.col("node").startswith("s"), F.col("node")))
    return G.first_target(t, "target").select("node", "resolved")


EDGES = "SELECT DISTINCT l_partkey AS src, l_suppkey * 7 AS dst FROM lineitem"


@query("t7_t8_closure", f"""
WITH RECURSIVE e AS ({EDGES}), t AS (SELECT 1::BIGINT AS node, 0 AS steps UNION SELECT e.dst, t.steps + 1 FROM t JOIN e ON e.src = t.node WHERE t.steps < 40)
SELECT node, min(steps) AS steps FROM t GROUP BY 1""")
def t7(spark, d):
    edges = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") * 7).alias("dst")).distinct()
    return G.reachable(edges, spark.sql("SELECT 1L AS node"))


LINKS = "VALUES ('a','b'), ('b','c'), ('c','toc'), ('x','y') AS t(src, dst)"


@query("t5_matter_chain", "SELECT * FROM (VALUES ('a',1,'b'), ('a',2,'c'), ('x',1,'y')) AS t(start, step, node)")
def t5(spark, d):
    return G.chain(rows(spark, LINKS), rows(spark, "VALUES ('a'), ('x') AS t(node)"), rows(spark, "VALUES ('toc') AS t(node)"))


NODES = "VALUES (1, NULL, NULL, 4, 2), (2, 1, NULL, 3, 0), (3, 1, 2, NULL, 0), (4, NULL, 9, NULL, 0) AS t(node, parent, prev, next, count)"


@query("t12_outline_audit", "SELECT 1 AS node, 'next' AS problem")
def t12(spark, d):
    return G.outline_problems(rows(spark, NODES))


OUTLINE = """l AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem),
n AS (
  SELECT 'n' || n_nationkey AS node, n_name AS title, 1 AS depth, n_nationkey AS a, -1 AS b, -1 AS c FROM nation
  UNION ALL SELECT 's' || s_suppkey, s_name, 2, s_nationkey, s_suppkey, -1 FROM supplier JOIN nation ON n_nationkey = s_nationkey
  UNION ALL SELECT 'l' || l_suppkey || '/' || l_orderkey, 'Order ' || l_orderkey, 3, s_nationkey, l_suppkey, l_orderkey FROM l JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)"""


def outline(spark, d):
    """Nations, their suppliers and the orders of those as a linked outline."""
    nations = table(spark, d, "nation")
    suppliers = table(spark, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    # the only large exchange: pairs of keys, which windows and counts then share
    orders = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey").repartition("l_suppkey").distinct().join(suppliers.select("s_suppkey"), F.col("s_suppkey") == F.col("l_suppkey"))
    name = lambda kind, *keys: F.concat(F.lit(kind), F.concat_ws("/", *(F.col(k).cast("string") for k in keys)))
    beside = lambda kind, *group: [F.when(F.col(n).isNotNull(), name(kind, *group, n)).alias(side) for side, n in (("prev", "before"), ("next", "behind"))]
    near = lambda rows, order, *group: rows.withColumns({"before": F.lag(order).over(Window.partitionBy(*group).orderBy(order)), "behind": F.lead(order).over(Window.partitionBy(*group).orderBy(order))})
    none = lambda kind: F.lit(None).cast(kind)
    columns = ["node", "parent", "prev", "next", "first", "last", "count", "title"]
    low = near(orders, "l_orderkey", "l_suppkey").select(name("l", "l_suppkey", "l_orderkey").alias("node"), name("s", "l_suppkey").alias("parent"), *beside("l", "l_suppkey"), none("string").alias("first"), none("string").alias("last"), none("long").alias("count"), F.concat(F.lit("Order "), "l_orderkey").alias("title"))
    held = orders.groupBy("l_suppkey").agg(F.min("l_orderkey").alias("low"), F.max("l_orderkey").alias("high"), F.count("*").alias("count"))
    owners = suppliers.join(held, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    middle = near(owners, "s_suppkey", "s_nationkey").select(name("s", "s_suppkey").alias("node"), name("n", "s_nationkey").alias("parent"), *beside("s"), F.when(F.col("low").isNotNull(), name("l", "s_suppkey", "low")).alias("first"), F.when(F.col("high").isNotNull(), name("l", "s_suppkey", "high")).alias("last"), "count", F.col("s_name").alias("title"))
    of_nations = owners.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("low"), F.max("s_suppkey").alias("high"), F.sum(F.coalesce("count", F.lit(0)) + 1).alias("count"))
    roots = nations.select("n_nationkey", "n_name").join(of_nations, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    top = near(roots, "n_nationkey").select(name("n", "n_nationkey").alias("node"), none("string").alias("parent"), *beside("n"), F.when(F.col("low").isNotNull(), name("s", "low")).alias("first"), F.when(F.col("high").isNotNull(), name("s", "high")).alias("last"), "count", F.col("n_name").alias("title"))
    return top.select(columns).union(middle.select(columns)).union(low.select(columns)).withColumn("tree", F.lit("guide"))


@query("t12_linked_outline", f"""WITH {OUTLINE}
SELECT node, title, row_number() OVER (ORDER BY a, b, c) - 1 AS position, depth, CASE depth WHEN 1 THEN count(*) OVER (PARTITION BY a) WHEN 2 THEN count(*) OVER (PARTITION BY a, b) ELSE 1 END - 1 AS descendants FROM n""")
def t12_positions(spark, d):
    return L.positions(outline(spark, d)).drop("tree")


@query("t12_outline_faults", f"""WITH {OUTLINE}
SELECT node, 'title' AS problem FROM n WHERE depth = 3 AND c % 50 = 7
UNION ALL SELECT node, 'prev' FROM n WHERE depth = 3 AND c % 50 = 11
UNION ALL SELECT node, 'leaf' FROM n WHERE depth = 3 AND c % 50 = 13
UNION ALL SELECT node, 'count' FROM n WHERE depth = 2 AND b % 5 = 0 AND b IN (SELECT l_suppkey FROM l)""")
def t12_faults(spark, d):
    low, order = F.col("node").startswith("l"), F.substring_index("node", "/", -1).try_cast("long") % 50
    own = F.col("node").startswith("s") & (F.substring("node", 2, 20).try_cast("long") % 5 == 0) & F.col("first").isNotNull()
    return L.problems(outline(spark, d).withColumns({
        "title": F.when(low & (order == 7), " ").otherwise(F.col("title")),
        "prev": F.when(low & (order == 11), F.col("node")).otherwise(F.col("prev")),
        "last": F.when(low & (order == 13), F.col("node")).otherwise(F.col("last")),
        "count": F.when(own, F.col("count") + 1).otherwise(F.col("count")),
    })).drop("tree")


@query("j27_outline_differences", f"""WITH {OUTLINE},
e AS (SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS position, depth, title FROM n),
s AS (SELECT position, depth, CASE WHEN depth = 3 AND position % 40 = 3 THEN upper(title) ELSE title END AS title FROM e WHERE depth < 3 OR position % 1000 <> 77),
r AS (SELECT row_number() OVER (ORDER BY position) - 1 AS position, depth, title FROM s)
SELECT position, e.depth AS expected_depth, e.title AS expected_title, r.depth AS actual_depth, r.title AS actual_title
FROM e FULL JOIN r USING (position) WHERE e.depth IS DISTINCT FROM r.depth OR e.title IS DISTINCT FROM r.title""")
def j27(spark, d):
    flat = L.positions(outline(spark, d))
    changed = flat.withColumn("title", F.when((F.col("depth") == 3) & (F.col("position") % 40 == 3), F.upper("title")).otherwise(F.col("title")))
    shown = numbered(changed.where((F.col("depth") < 3) | (F.col("position") % 1000 != 77)), ["tree"], ["position"], "at")
    return L.differences(flat, shown.drop("position").withColumnRenamed("at", "position")).drop("tree")


@query("j13_branch_children", """
WITH l AS (SELECT DISTINCT l_suppkey AS branch, l_orderkey AS k FROM lineitem),
a AS (SELECT branch, k, row_number() OVER (PARTITION BY branch ORDER BY k) - 1 AS ord FROM l),
b AS (SELECT branch, k, row_number() OVER (PARTITION BY branch ORDER BY k) - 1 AS ord FROM l WHERE branch % 3 > 0 OR k % 500 <> 1)
SELECT branch, ord, a.k AS left_key, b.k AS right_key FROM a FULL JOIN b USING (branch, ord) WHERE a.k IS DISTINCT FROM b.k""")
def j13_branches(spark, d):
    held = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("branch"), F.col("l_orderkey").alias("k")).distinct()
    ranked = lambda rows: numbered(rows, ["branch"], ["k"], "ord")
    return O.positional(ranked(held), ranked(held.where("branch % 3 > 0 or k % 500 <> 1")), ["branch"], "ord", "k")


@query("t13_drop_unpublished", "SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE strlen(html) < 1500)")
def t13(spark, d):
    p = table(spark, d, "pages")
    return G.without(p.select("page_id", "url"), p.where(F.octet_length("html") < 1500), "url")
