"""A Merkle manifest of a dataset: groups of sorted leaves under one root.

A leaf digests a row's fields, each framed by its byte count. Within a group
leaves ascend by key; while there are several nodes, every WIDTH consecutive
ones (the last run may be shorter, even one) become their digest. What remains
is the group's subroot; the subroots, by group, become the root likewise.
Digests are lower-case hex SHA-256 of what they cover, concatenated as text.

The leaves are range-sorted by group and key. One small row for each partition
(its first and last group and how many rows it has of them) gives every
partition the offset of its first group. Each partition then builds the
complete aligned subtrees of its rows, up to LEVELS levels, where they lie;
only the nodes at its ragged borders are shuffled, by their coordinate (group,
block), and so are the roots of the blocks above, LEVELS levels at a time. Each
of these shuffled groups has at most WIDTH ** LEVELS nodes. The proofs of the
upper nodes go back down by joins of the small tables and meet the subtrees,
which give every leaf its own proof.

A proof is the digests of the siblings, level by level up to the root and left
to right, as one text, and `slots`: for each level the position in the run
plus 8 times the number of siblings. `fold` recomputes the root from a leaf and
a proof; the JVM does it, apart from the code that builds the tree.

Scale: texts are read once, for their leaves; about 100 bytes a row are sorted.
Rows of one group or one key are cut by ranges like any other, as the leaf and
a row number are sort keys too. Nothing but one row for each partition and the
number of levels comes to the driver. Sorted leaves and subtrees are written to
the shared folder, so a lost executor repeats its own tasks.

Defined cases: null fields are framed as "-"; null keys come first, then rows
of equal keys by their leaf (equal rows stand beside each other, each with its
own proof); the null group comes first, before the empty one. A group of one
row has its leaf for subroot. An empty table gives an empty result. Fields are
taken by name, so other columns don't matter; carried columns must not have the
names of the results.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import discard, hash_partitions, prepare, shared_folder

#: Nodes of a run. Eight: a slot holds position and siblings as two octal digits.
WIDTH = 8
#: Levels that are built together: in a partition, or in one shuffled group.
LEVELS = 4
BLOCK = WIDTH**LEVELS

_WAY = "g string, level int, place long, block long, proof string, slots array<int>, root string, total long"


def framed(*fields: Column | str) -> Column:
    """The text that a leaf digests: each field as `-` if it is null, else its
    UTF-8 byte count, a colon and its value."""
    value = lambda f: (F.col(f) if isinstance(f, str) else f).cast("string")
    return F.concat(*(F.when(value(f).isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value(f)).cast("string"), F.lit(":"), value(f))) for f in fields))


def leaf(*fields: Column | str) -> Column:
    return F.sha2(framed(*fields), 256)


def fold(start: Column, proof: Column, slots: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    text = proof.cast("binary")

    def step(state: Column, slot: Column) -> Column:
        at, before = state["at"], slot % WIDTH * 64
        after = (F.floor(slot / WIDTH).cast("int") - slot % WIDTH) * 64
        left, right = F.substring(text, at, before), F.substring(text, at + before, after)
        return F.struct(F.sha2(F.concat(left, state["digest"].cast("binary"), right), 256).alias("digest"), (at + before + after).alias("at"))

    first = F.struct(start.alias("digest"), F.lit(1).alias("at"))
    return F.aggregate(slots, first, step, lambda s: s["digest"])


def _digest(nodes: Sequence[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


# --------------------------------------------------------------------------
# subtrees of one partition
# --------------------------------------------------------------------------


def aligned(start: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(from, to, level): the largest aligned subtrees of at most LEVELS levels
    that make up the places from start to end."""
    while start < end:
        level = 0
        while level < LEVELS and start % WIDTH ** (level + 1) == 0 and start + WIDTH ** (level + 1) <= end:
            level += 1
        yield start, start + WIDTH**level, level
        start += WIDTH**level


def _root(leaves: list[str]) -> str:
    while len(leaves) > 1:
        leaves = [_digest(leaves[i : i + WIDTH]) for i in range(0, len(leaves), WIDTH)]
    return leaves[0]


def _subtrees(shared):
    """From sorted rows to subtrees: (g, level, place, digest, rows). A
    partition's first group starts at its offset, any other at 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets = shared.value
        held: pa.RecordBatch | None = None  # rows of a block that may go on
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if held is not None:
                batch = pa.concat_batches([held, batch])
            place = _places(batch, offsets)
            code = batch.column("g").dictionary_encode().indices.to_numpy()
            new = np.flatnonzero((np.diff(code) != 0) | (np.diff(place) != 1) | (place[1:] % BLOCK == 0)) + 1
            cuts = [0, *new.tolist(), len(place)]
            held = batch.slice(cuts[-2])
            yield from _emit(batch, place, cuts[:-1])
        if held is not None:
            yield from _emit(held, _places(held, offsets), [0, held.num_rows])

    return run


def _places(batch: pa.RecordBatch, offsets: dict[int, tuple[str, int]]) -> np.ndarray:
    """Where each row stands in its group."""
    first = map(offsets.__getitem__, batch.column("part").to_pylist())
    more = [offset if group == g else 0 for (group, offset), g in zip(first, batch.column("g").to_pylist())]
    return batch.column("nth").to_numpy() + np.array(more, np.int64)


def _emit(batch: pa.RecordBatch, place: np.ndarray, cuts: list[int]) -> Iterator[pa.RecordBatch]:
    leaves = batch.column("leaf").to_pylist()
    out: dict[str, list] = {k: [] for k in ("g", "level", "place", "digest")}
    offsets = [0]
    for a, b in zip(cuts[:-1], cuts[1:]):
        base, g = int(place[a]), batch.column("g")[a].as_py()
        for start, end, level in aligned(base, base + b - a):
            out["g"].append(g)
            out["level"].append(level)
            out["place"].append(start // WIDTH**level)
            out["digest"].append(_root(leaves[a + start - base : a + end - base]))
            offsets.append(a + end - base)
    if not out["g"]:
        return
    held = [n for n in batch.schema.names if n not in ("g", "part", "nth")]
    rows = pa.StructArray.from_arrays([batch.column(n).slice(0, offsets[-1]) for n in held], held)
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)
    yield pa.record_batch([pa.array(out["g"], pa.string()), pa.array(out["level"], pa.int32()), pa.array(out["place"], pa.int64()), pa.array(out["digest"], pa.string()), lists], ["g", "level", "place", "digest", "rows"])


# --------------------------------------------------------------------------
# upper levels
# --------------------------------------------------------------------------


def climb(nodes: dict[int, dict[int, str]], base: int, whole: bool) -> tuple[str, dict[tuple[int, int], tuple[str, list[int]]]]:
    """The root of one block and the way to it from each of its nodes, which
    are given by level above base and place. With `whole`, the block is all of
    its group, and the climb ends at a single node; else after LEVELS levels."""
    level, now, run_of = base, dict(nodes.get(base, {})), {}
    while level < base + LEVELS:
        if whole and len(now) == 1 and not any(nodes.get(k) for k in range(level + 1, base + LEVELS + 1)):
            break
        above: dict[int, list[int]] = {}
        for place in sorted(now):
            above.setdefault(place // WIDTH, []).append(place)
        up = dict(nodes.get(level + 1, {}))
        for parent, places in above.items():
            up[parent] = _digest([now[p] for p in places])
            for i, p in enumerate(places):
                run_of[level, p] = ("".join(now[q] for q in places if q != p), i + WIDTH * (len(places) - 1))
        level, now = level + 1, up
    (root,) = now.values()
    ways = {}
    for k, places in nodes.items():
        for place in places:
            proof, slots, p = [], [], place
            for at in range(k, level):
                siblings, slot = run_of[at, p]
                proof.append(siblings)
                slots.append(slot)
                p //= WIDTH
            ways[k, place] = ("".join(proof), slots)
    return root, ways


def _climbed(base: int):
    """From all nodes of a block to their ways and the block's root."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        nodes: dict[int, dict[int, str]] = {}
        for level, place, digest in zip(rows["level"], rows["place"], rows["digest"]):
            nodes.setdefault(int(level), {})[int(place)] = digest
        g, block, total = rows["g"].iloc[0], int(rows["block"].iloc[0]), int(rows["total"].iloc[0])
        root, ways = climb(nodes, base, total <= WIDTH**base * BLOCK)
        out = [(g, k, p, block, proof, slots, root, total) for (k, p), (proof, slots) in ways.items()]
        return pd.DataFrame(out, columns=["g", "level", "place", "block", "proof", "slots", "root", "total"])

    return run


def _ways(nodes: DataFrame, most: int, keep) -> DataFrame:
    """The way of each node (g, level, place, digest, total: the leaves of its
    group) to its group's root: g, level, place, proof, slots, root. The largest
    group has `most` leaves; keep(df, name) stores a table."""
    tiers, base = [], 0
    while True:
        top = base + LEVELS
        blocks = nodes.withColumn("block", F.expr(f"shiftright(place, 3 * ({top} - level))"))
        alone = blocks.where(F.col("level") == top)  # a whole block
        alone = alone.select("g", "level", "place", "block", F.lit("").alias("proof"), F.array().cast("array<int>").alias("slots"), F.col("digest").alias("root"), "total")
        tiers.append(keep(blocks.where(F.col("level") < top).groupBy("g", "block").applyInPandas(_climbed(base), _WAY).unionByName(alone), f"merkle-ways-{base}"))
        if most <= WIDTH**top:
            break
        nodes = tiers[-1].select("g", F.col("block").alias("place"), F.col("root").alias("digest"), "total").distinct().withColumn("level", F.lit(top))
        base = top
    ways = tiers.pop()
    for lower in reversed(tiers):
        upper = ways.select("g", F.col("place").alias("block"), F.col("proof").alias("more"), F.col("slots").alias("further"), F.col("root").alias("end"))
        ways = lower.join(upper, ["g", "block"]).select("g", "level", "place", "block", F.concat("proof", "more").alias("proof"), F.concat("slots", "further").alias("slots"), F.col("end").alias("root"))
    return ways.select("g", "level", "place", "proof", "slots", "root")


# --------------------------------------------------------------------------
# the forest
# --------------------------------------------------------------------------


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with their partition and their number within it and their
    group."""
    part, last, so_far = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        g = batch.column("g")
        code = g.dictionary_encode().indices.to_numpy()
        first = np.concatenate(([0], np.flatnonzero(np.diff(code)) + 1))
        sizes = np.diff(first, append=len(code))
        nth = np.arange(len(code)) - np.repeat(first, sizes)
        if g[0].as_py() == last:
            nth[: sizes[0]] += so_far
        last, so_far = g[-1].as_py(), int(nth[-1]) + 1
        yield pa.record_batch([*batch.columns, pa.array(np.full(len(code), part, np.int32)), pa.array(nth, pa.int64())], [*batch.schema.names, "part", "nth"])


def partition_offsets(ends: list[tuple[int, str, int, str, int]]) -> dict[int, tuple[str, int]]:
    """For each partition (number, first group, its rows, last group, its rows):
    the first group and how many rows of it the partitions before hold."""
    out, group, held = {}, None, 0
    for part, first, n_first, last, n_last in sorted(ends):
        offset = held if first == group else 0
        out[part] = (first, offset)
        group, held = last, n_last + offset if last == first else n_last
    return out


def _forest(rows: DataFrame, keys: list[str], parts: int, keep) -> tuple[DataFrame, DataFrame]:
    """Subtrees (g, level, place, digest, rows) and their ways, of rows with a
    group g, a leaf and other columns, ordered by keys within the group."""
    order = ["g", *keys]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop(*(k for k in keys if k == "row"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema)
    ranked = keep(ranged.mapInArrow(_numbered, f"{kinds}, part int, nth long"), "merkle-sorted")
    counts = ranked.groupBy("part", "g").agg(F.count("*").alias("n"))
    ends = counts.groupBy("part").agg(F.min(F.struct("g", "n")).alias("a"), F.max(F.struct("g", "n")).alias("b"))
    offsets = rows.sparkSession.sparkContext.broadcast(partition_offsets([(r.part, r.a.g, r.a.n, r.b.g, r.b.n) for r in ends.collect()]))
    held = ", ".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in ranged.schema if f.name != "g")
    subtrees = keep(ranked.mapInArrow(_subtrees(offsets), f"g string, level int, place long, digest string, rows array<struct<{held}>>"), "merkle-subtrees")
    totals = keep(ranked.groupBy("g").agg(F.count("*").alias("total")), "merkle-totals")
    most = totals.agg(F.max("total")).first()[0] or 0
    return subtrees, _ways(subtrees.select("g", "level", "place", "digest").join(totals, "g"), most, keep)


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each leaf of a subtree, with its proof."""
    for batch in batches:
        for level, rows, proof, slots, subroot, root in zip(*(batch.column(c) for c in ("level", "rows", "proof", "slots", "subroot", "root"))):
            level, proof, slots, rows = level.as_py(), proof.as_py(), slots.as_py(), rows.values
            nodes, beside = rows.field("leaf").to_pylist(), []
            for _ in range(level):
                beside.append(["".join(nodes[k - k % WIDTH : k] + nodes[k + 1 : k - k % WIDTH + WIDTH]) for k in range(len(nodes))])
                nodes = [_digest(nodes[k : k + WIDTH]) for k in range(0, len(nodes), WIDTH)]
            proofs = [proof]
            for siblings in reversed(beside):
                proofs = [s + proofs[k // WIDTH] for k, s in enumerate(siblings)]
            full = WIDTH * (WIDTH - 1)
            places = [[full + k // WIDTH**j % WIDTH for j in range(level)] + slots for k in range(len(rows))]
            same = [pa.array([x.as_py()] * len(rows), pa.string()) for x in (subroot, root)]
            made = [*rows.flatten(), *same, pa.array(proofs, pa.string()), pa.array(places, pa.list_(pa.int32()))]
            yield pa.record_batch(made, [*(f.name for f in rows.type), "subroot", "root", "proof", "slots"])


def manifest(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group_col: str = "lang", key_col: str = "doc_id", carry: dict[str, Column] | None = None) -> DataFrame:
    """For every row: the key column, leaf, the carried columns, subroot, root,
    proof and slots. Carried expressions are computed with the leaves and go
    along with them."""
    spark, carry, made = docs.sparkSession, carry or {}, []

    def keep(df: DataFrame, name: str) -> DataFrame:
        made.append(shared_folder(spark, name))
        df.write.parquet(made[-1])
        return spark.read.schema(df.schema).parquet(made[-1])

    prepare(spark)
    group = F.col(group_col).cast("string")
    g = F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), group))
    leaves = keep(docs.select(g.alias("g"), F.col(key_col).alias("key"), leaf(*fields).alias("leaf"), *(c.alias(n) for n, c in carry.items()), F.monotonically_increasing_id().alias("row")), "merkle-leaves")
    subtrees, ways = _forest(leaves, ["key", "leaf", "row"], hash_partitions(leaves), keep)
    subroots = keep(ways.groupBy("g").agg(F.first("root").alias("leaf")), "merkle-subroots")
    tops, over = _forest(subroots.select(F.lit("").alias("g"), F.col("g").alias("key"), "leaf"), ["key"], max(1, min(subroots.count() // BLOCK, hash_partitions(leaves))), keep)
    ups = _expand(tops.join(over, ["g", "level", "place"]).withColumn("subroot", F.lit("")))
    ups = keep(ups.select(F.col("key").alias("g"), "root", F.col("proof").alias("more"), F.col("slots").alias("further")), "merkle-groups")
    found = ways.withColumnRenamed("root", "subroot").join(ups, "g")
    found = found.select("g", "level", "place", "subroot", "root", F.concat("proof", "more").alias("proof"), F.concat("slots", "further").alias("slots"))
    for path in made[:1]:
        discard(spark, path)
    out = _expand(subtrees.join(found, ["g", "level", "place"]))
    return out.select(F.col("key").alias(key_col), "leaf", *carry, "subroot", "root", "proof", "slots")


def _expand(rows: DataFrame) -> DataFrame:
    held = rows.schema["rows"].dataType.elementType
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held)
    return rows.select("level", "rows", "proof", "slots", "subroot", "root").mapInArrow(_expanded, f"{kinds}, subroot string, root string, proof string, slots array<int>")
