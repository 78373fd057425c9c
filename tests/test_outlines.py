"""Linked outlines: positions, problems and differences, also of long lists."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import outlines

SCHEMA = "tree string, node string, parent string, prev string, next string, first string, last string, count long, title string"


def linked(children, tree="t"):
    """Rows of an outline given as {node: [children]}, None for the top."""
    below = {}

    def size(n):
        below[n] = sum(1 + size(c) for c in children.get(n, []))
        return below[n]

    size(None)
    rows = {}
    for up, nodes in children.items():
        for i, n in enumerate(nodes):
            kids = children.get(n, [])
            rows[n] = [tree, n, up, nodes[i - 1] if i else None, nodes[i + 1] if i + 1 < len(nodes) else None, kids[0] if kids else None, kids[-1] if kids else None, below[n] or None, f"title {n}"]
    return rows


def grown(rng, n):
    children, nodes = {}, [None]
    for i in range(n):
        up = rng.choice(nodes[-5:] if rng.random() < 0.5 else nodes)
        children.setdefault(up, []).append(f"e{i}")
        nodes.append(f"e{i}")
    return children


def walk(children, up=None, depth=1):
    for n in children.get(up, []):
        yield n, depth
        yield from walk(children, n, depth + 1)


def frame(spark, *trees):
    return spark.createDataFrame([tuple(r) for rows in trees for r in rows.values()], SCHEMA)


def test_positions_of_random_trees(spark):
    rng = random.Random(6)
    trees = {f"t{i}": grown(rng, n) for i, n in enumerate([1, 2, 9, 150])}
    got = outlines.positions(frame(spark, *(linked(c, t) for t, c in trees.items()))).collect()
    for t, children in trees.items():
        mine = {r.position: r for r in got if r.tree == t}
        want = [*walk(children)]
        rows = linked(children, t)
        assert [(mine[i].node, mine[i].depth, mine[i].descendants) for i in range(len(mine))] == [(n, d, rows[n][7] or 0) for n, d in want]


def found(spark, rows, **kw):
    return sorted((r.node, r.problem) for r in outlines.problems(frame(spark, rows), **kw).collect())


BASE = {None: ["a", "b", "c"], "a": ["a1", "a2", "a3"], "b": ["b1"], "b1": ["b2"]}
TREE, NODE, PARENT, PREV, NEXT, FIRST, LAST, COUNT, TITLE = range(9)


def test_a_sound_outline_has_no_problems(spark):
    assert found(spark, linked(BASE)) == []
    assert found(spark, linked({None: ["a"]})) == []
    assert outlines.problems(frame(spark, linked(BASE)).limit(0)).count() == 0 and outlines.positions(frame(spark, linked(BASE)).limit(0)).count() == 0


@pytest.mark.parametrize(
    "changes, want",
    [
        ([("a2", PREV, "a3")], [("a2", "prev")]),
        ([("a", PREV, "b")], [("a", "unreached")]),
        ([("b2", PARENT, "b")], {("b2", "parent"), ("b1", "last")}),
        ([("b1", PARENT, "a")], {("b1", "parent"), ("b", "last"), ("b", "cycle")}),
        ([("a1", NEXT, "zz")], [("a1", "missing"), ("a2", "unreached")]),
        ([("a", LAST, "a2")], [("a", "last")]),
        ([("a", COUNT, 4)], [("a", "count")]),
        ([("b", COUNT, None)], [("b", "count")]),
        ([("c", COUNT, 0)], [("c", "leaf")]),
        ([("c", LAST, "c")], [("c", "leaf")]),
        ([("b2", TITLE, "  ")], [("b2", "title")]),
        ([("a3", NEXT, "a1")], [("a", "cycle"), ("a", "last"), ("a1", "cycle"), ("a1", "prev"), ("a1", "shared"), ("a2", "cycle"), ("a3", "cycle")]),
        ([("b2", FIRST, "b1"), ("b2", LAST, "b1")], {("b", "cycle"), ("b1", "cycle"), ("b2", "cycle")}),
    ],
)
def test_problems(spark, changes, want):
    rows = linked(BASE)
    for node, field, value in changes:
        rows[node][field] = value
    got = found(spark, rows)
    if isinstance(want, set):  # and what follows from it
        assert want <= set(got)
    else:
        assert got == want


def test_repeated_and_nameless_entries(spark):
    rows = linked(BASE)
    twice = frame(spark, rows).unionByName(frame(spark, {"c": rows["c"]}))
    assert [(r.node, r.problem) for r in outlines.problems(twice).collect()] == [("c", "repeated")]
    with pytest.raises(Exception, match="without tree or node"):
        outlines.problems(frame(spark, rows).withColumn("node", F.lit(None).cast("string"))).collect()


def test_depth_limit(spark):
    assert found(spark, linked(BASE), deepest=2) == [("b2", "depth")]


def test_differences(spark):
    a, b = linked(BASE), linked({**BASE, "b1": []})
    b["a2"][TITLE] = "other"
    rows = outlines.differences(outlines.positions(frame(spark, a)), outlines.positions(frame(spark, b))).collect()
    assert sorted((r.position, r.expected_title, r.actual_title) for r in rows) == [(2, "title a2", "other"), (6, "title b2", "title c"), (7, "title c", None)]


def long_list(spark, n):
    i, name = F.col("id"), lambda c: F.format_string("e%07d", c)
    none = F.lit(None).cast("string")
    return spark.range(0, n, 1, 8).select(
        F.lit("t").alias("tree"), name(i).alias("node"), none.alias("parent"), F.when(i > 0, name(i - 1)).alias("prev"),
        F.when(i < n - 1, name(i + 1)).alias("next"), none.alias("first"), none.alias("last"), F.lit(None).cast("long").alias("count"), F.lit("x").alias("title"),
    )


def test_a_million_siblings_with_a_break_and_a_cycle(spark):
    n = 1_000_000
    rows = long_list(spark, n)
    i = F.substring("node", 2, 9).cast("int")
    bad = rows.withColumn("next", F.when(i == 400_000, "nowhere").when(i == n - 1, F.format_string("e%07d", F.lit(700_000))).otherwise(F.col("next")))
    got = {r.problem: r.n for r in outlines.problems(bad).groupBy("problem").agg(F.count("*").alias("n")).collect()}
    # all after the break run into the circle; those before it end at the break
    assert got == {"missing": 1, "unreached": 1, "cycle": n - 400_001, "shared": 1, "prev": 1}


def test_only_steps_that_other_chunks_lead_to_are_ranked(spark, monkeypatch):
    asked, rank = [], outlines.ranked
    monkeypatch.setattr(outlines, "ranked", lambda steps: asked.append(steps.count()) or rank(steps))
    rows = spark.range(0, 20000, 1, 1).select(F.format_string("e%05d", "id").alias("node"), F.when(F.col("id") > 0, F.format_string("e%05d", F.col("id") - 1)).alias("prev"), F.when(F.col("id") < 19999, F.format_string("e%05d", F.col("id") + 1)).alias("next"))
    none = {c: F.lit(None).cast("string") for c in ("parent", "first", "last")}
    list_ = rows.withColumns({"tree": F.lit("t"), "count": F.lit(None).cast("long"), "title": F.lit("x"), **none})
    got = outlines.positions(list_).agg(F.count_if(F.col("position") == F.substring("node", 2, 5).cast("long")).alias("right")).first()
    assert got.right == 20000 and asked[0] < 20
