"""Connected components of an edge list, by alternating star steps.

Each round replaces every vertex's links by links to the least neighbour
(large star on the greater neighbours, then small star on the others), which
needs a number of rounds that is logarithmic in practice. A round is two
aggregates and two joins over narrow rows; a vertex with very many links is
aggregated on the map side first, and its join is split by adaptive execution.
Rounds are written to the shared checkpoint folder.

As soon as no more than FINISH links are left, one task finishes the work by
union-find: a bounded number of rows (16 bytes each), checked by a count, in
place of further rounds whose many small files cost more than the links. The
result is the same either way. Nothing is collected but counts and a sum.

Defined cases: links with a null end and links of a vertex to itself are left
out; repeated and reversed links count once. Vertices without a link are not
in the result. An empty edge list gives an empty result. Columns other than u
and v are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored

#: Links that one task may finish.
FINISH = 1_000_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u, v. With m the least of u and its neighbours: large star links
    the neighbours above u to m, small star the others and u itself."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # dealt out once more, so that the join has exchanges of its own on both
    # sides and can split a vertex with very many links
    linked = both.join(least.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = list(root)
    for i in range(0, len(nodes), 100_000):
        part = nodes[i : i + 100_000]
        yield pa.record_batch([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], ["node", "component"])


def components(edges: DataFrame, rounds: int = 50, finish: int | None = None) -> DataFrame:
    """edges: u, v (long). Returns node, component: the least vertex that each
    vertex with a link can reach."""
    finish = FINISH if finish is None else finish
    mark = None
    edges = stored(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u != v"), "edges")
    for _ in range(rounds):
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now[0] <= finish:
            return stored(edges.coalesce(1).mapInArrow(_union_find, "node long, component long"), "components")
        if now == mark:
            break
        mark = now
        edges = stored(_star(_star(edges, True), False), "edges")
    else:
        raise RuntimeError("components did not settle")
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
