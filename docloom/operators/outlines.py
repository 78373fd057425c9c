"""Linked outlines: entries that name their parent, neighbours and children.

An outline is one list: enter an entry, go on to its first child or leave it,
then to its next sibling or leave its parent. Every step names the following
one, so pointer jumping ranks all of them in a logarithmic number of joins,
however long the lists and however deep the tree: in each round a step follows
the pointers of the steps it points to, HOPS in a row, and adds their sums. What
is left when HOPS ** rounds exceeds the number of steps runs in circles. The sums give
each entry its position in reading order, its depth and its descendants.

Scale: entries are numbered in the order of (tree, node), so neighbours mostly
lie in one chunk of some CHUNK rows. There references are resolved and steps
followed without a join; what goes on elsewhere is asked for once, however many
ask, and only those steps are ranked by pointer jumping. Names without any such
order make all steps jump: the result is the same, the work more by a logarithm.
Four longs a step; entries without children are one step.
Steps that have reached the end are written once and never sent again as the
asking side, so the end isn't a hot key. Each round is a table in the shared
folder, with its true size (a checkpoint keeps the planner's guess, which grows
with every join).

Input: rows (tree, node, parent, prev, next, first, last, count, title); null
for none. `count` is the number of entries below. Entries without parent are
the top of their tree. Defined cases: a node named twice in a tree is a problem
("repeated") and counts once; references to no entry are problems ("missing")
and end the list there. Null trees or nodes are an error. An empty table gives
empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored

REFERENCES = ("parent", "prev", "next", "first", "last")

#: Pointers that a round follows one after another.
HOPS = 4

#: Entries, and about as many bytes of them, that a worker looks at together;
#: rows that it sends together; rows of a table that may be broadcast.
CHUNK, CHUNK_BYTES, BATCH, FEW = 1 << 18, 64 << 20, 10_000, 500_000

#: Ends of a list: of its tree, and a reference to no entry; a circle within a
#: chunk; no reference (in arrays).
END, BROKEN, LOOP, NONE = -1, -2, -3, -4


def ranked(steps: DataFrame) -> DataFrame:
    """(id, to, sums...) with `to` followed to its end: each step's sums run
    over it and all that follow. `to` is negative at an end; where it isn't in
    the result, the step runs into a circle."""
    sums = [c for c in steps.columns if c not in ("id", "to")]
    now = stored(steps, "outline-steps")
    done, active = [now.where("to < 0")], now.where("to >= 0")
    left, reach = now.count(), 1
    while reach < 2 * left and active.limit(1).count():
        every = reduce(DataFrame.unionByName, [*done, active])
        next_ = every.select(F.col("id").alias("key"), F.col("to").alias("to_"), *(F.col(c).alias(f"{c}_") for c in sums))
        met = active
        for _ in range(HOPS - 1):  # steps at their end ask for nothing, each by a key of its own
            key = F.when(F.col("to") >= 0, F.col("to")).otherwise(BROKEN - 1 - F.col("id"))
            met = met.withColumn("key", key).join(next_, "key", "left")
            met = met.select("id", F.coalesce("to_", "to").alias("to"), *((F.col(c) + F.coalesce(f"{c}_", F.lit(0))).alias(c) for c in sums))
        met = stored(met, "outline-steps")
        done.append(met.where("to < 0"))
        active = met.where("to >= 0")
        reach *= HOPS
    return reduce(DataFrame.unionByName, [*done, active])


def small(df: DataFrame) -> DataFrame:
    """A stored table, broadcast if it has at most FEW rows: so that the large
    side of a join stays where it is."""
    return F.broadcast(df) if df.count() <= FEW else df


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Entries that are looked at together: some CHUNK rows, fewer long ones."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= CHUNK or size >= CHUNK_BYTES:
            yield pa.Table.from_batches(held)
            held, rows, size = [], 0, 0
    if rows:
        yield pa.Table.from_batches(held)


def _keys(tree: pa.ChunkedArray, node: pa.ChunkedArray) -> pa.ChunkedArray:
    """One text for each pair: the length of the first tells where it ends."""
    tree, node = tree.cast(pa.string()), node.cast(pa.string())
    return pc.binary_join_element_wise(pc.binary_length(tree).cast(pa.string()), tree, node, ":")


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """References to entries of the same chunk become numbers; the names of the
    others stay."""
    for t in _chunks(batches):
        known = _keys(t["tree"], t["node"]).combine_chunks()
        out = {c: t[c] for c in ("id", "tree", "node", "count", "title", "copies")}
        for r in REFERENCES:
            at = pc.index_in(_keys(t["tree"], t[r]), value_set=known)
            at = pc.if_else(pc.is_valid(t[r]), at, pa.scalar(None, pa.int32()))
            out[f"{r}_id"] = t["id"].take(at.combine_chunks())
            out[r] = pc.if_else(pc.is_valid(at), pa.scalar(None, t[r].type), t[r])
        yield from pa.table(out).to_batches(max_chunksize=BATCH)


def _resolved(rows: DataFrame) -> DataFrame:
    """Distinct entries with a number, and the numbers of what they name (null
    for none, BROKEN for no entry). Entries are numbered in the order of their
    names, so that most of what one names lies near it."""
    known = F.when(F.col("tree").isNull() | F.col("node").isNull(), F.raise_error(F.lit("an entry without tree or node"))).otherwise(F.col("node"))
    fields = [*REFERENCES, "count", "title"]
    dealt = rows.withColumn("node", known).repartitionByRange("tree", "node").sortWithinPartitions("tree", "node")
    distinct = dealt.groupBy("tree", "node").agg(F.min(F.struct(*fields)).alias("f"), F.count("*").alias("copies"))
    entries = distinct.select(F.monotonically_increasing_id().alias("id"), "tree", "node", F.col("f.count").alias("count"), "f.title", "copies", *(f"f.{r}" for r in REFERENCES))
    kind = {f.name: f.dataType.simpleString() for f in entries.schema}
    kinds = ", ".join([*(f"`{c}` {kind[c]}" for c in ("id", "tree", "node", "count", "title", "copies")), *(f"`{r}_id` long, `{r}` {kind[r]}" for r in REFERENCES)])
    near = stored(entries.mapInArrow(_near, kinds), "outline-entries")
    asked = stored(near.select("tree", F.explode(F.array_compact(F.array(*REFERENCES))).alias("ref")).distinct(), "outline-asked")
    found = stored(near.select("tree", F.col("node").alias("ref"), F.col("id").alias("ref_id")).join(small(asked), ["tree", "ref"]), "outline-found")
    others = [r for r in REFERENCES if r != "parent"]
    named = near.select("id", "tree", F.explode(F.map_from_arrays(F.array(*(F.lit(r) for r in others)), F.array(*others))).alias("kind", "ref")).where("ref is not null").join(small(found), ["tree", "ref"], "left")
    far = stored(named.groupBy("id").agg(*(F.max(F.when(F.col("kind") == r, F.coalesce("ref_id", F.lit(BROKEN)))).alias(f"{r}_far") for r in others)), "outline-far")
    parents = small(found).select("tree", F.col("ref").alias("parent"), F.col("ref_id").alias("parent_far"))
    met = near.join(parents, ["tree", "parent"], "left").withColumn("parent_far", F.coalesce("parent_far", F.when(F.col("parent").isNotNull(), BROKEN))).join(small(far), "id", "left")
    return met.select("id", "tree", "node", "count", "title", "copies", *(F.coalesce(f"{r}_id", f"{r}_far").alias(f"{r}_id") for r in REFERENCES))


def _steps(n: int, ids: np.ndarray, ref: dict[str, np.ndarray], at: dict[str, np.ndarray]):
    """The steps of a chunk followed until they leave it. Steps 0 to n - 1 enter
    an entry (2 * id), the others leave it (2 * id + 1, if it has children):
    (to, entries, depth)."""
    parent, next_, first = (ref[r] for r in ("parent", "next", "first"))
    up = np.where(parent == NONE, END, np.where(parent < 0, BROKEN, 2 * parent + 1))
    leave = np.where(next_ == NONE, up, np.where(next_ < 0, BROKEN, 2 * next_))
    inner = first != NONE
    to = np.concatenate([np.where(first >= 0, 2 * first, np.where(inner, BROKEN, leave)), leave])
    entries = np.concatenate([np.ones(n, np.int64), np.zeros(n, np.int64)])
    depth = np.concatenate([np.where(inner, -1, 0), np.ones(n, np.int64)])
    # where the next step lies in this chunk; a leaf has no step that leaves it
    above = np.where((at["parent"] >= 0) & inner[at["parent"]], at["parent"] + n, -1)
    after = np.where(next_ == NONE, above, at["next"])
    go = np.concatenate([np.where(inner, at["first"], after), after])
    for _ in range((2 * n).bit_length() + 1):
        on = np.flatnonzero(go >= 0)
        if not len(on):
            break
        j = go[on]
        entries[on], depth[on], to[on], go[on] = entries[on] + entries[j], depth[on] + depth[j], to[j], go[j]
    to[go >= 0] = LOOP
    return to, entries, depth


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries with their steps as far as the chunk goes, and what their
    neighbours in it say of them; far_: neighbours that lie elsewhere."""
    for t in _chunks(batches):
        n, ids = t.num_rows, t["id"].to_numpy()
        order = np.argsort(ids)
        ref = {r: t[f"{r}_id"].fill_null(NONE).to_numpy() for r in REFERENCES}
        at = {}
        for r, v in ref.items():
            i = order[np.minimum(np.searchsorted(ids, v, sorter=order), n - 1)]
            at[r] = np.where(ids[i] == v, i, -1)
        to, entries, depth = _steps(n, ids, ref, at)
        inner = ref["first"] != NONE
        visits, wrong_parent, wrong_prev = np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, bool)
        for r, owner, before in (("first", ids, np.full(n, NONE)), ("next", ref["parent"], ids)):
            on = np.flatnonzero(at[r] >= 0)
            j = at[r][on]
            np.add.at(visits, j, 1)
            wrong_parent[j[owner[on] != ref["parent"][j]]] = True
            wrong_prev[j[before[on] != ref["prev"][j]]] = True
        last = at["last"]
        last_ok = (last >= 0) & (ref["parent"][last] == ids) & (ref["next"][last] == NONE)
        out = {c: t[c] for c in t.column_names} | {"e_to": to[:n], "e_entries": entries[:n], "e_depth": depth[:n]}
        out |= {k: pa.array(v[n:], mask=~inner) for k, v in (("l_to", to), ("l_entries", entries), ("l_depth", depth))}
        out |= {"visits": visits, "wrong_parent": wrong_parent, "wrong_prev": wrong_prev, "last_ok": last_ok}
        out |= {f"far_{r}": (ref[r] >= 0) & (at[r] < 0) for r in ("first", "next", "last")}
        yield from pa.table(out).to_batches(max_chunksize=BATCH)


def _placed(rows: DataFrame) -> DataFrame:
    """Entries with their place. Only the steps that another chunk leads to are
    ranked by pointer jumping; all others add their sums."""
    entries = _resolved(rows)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema)
    more = "e_to long, e_entries long, e_depth long, l_to long, l_entries long, l_depth long, visits long, wrong_parent boolean, wrong_prev boolean, last_ok boolean, far_first boolean, far_next boolean, far_last boolean"
    joined = stored(entries.mapInArrow(_joined, f"{kinds}, {more}"), "outline-joined")
    asked = stored(joined.select(F.explode(F.array("e_to", "l_to")).alias("id")).where("id >= 0").distinct(), "outline-asked")
    step = lambda at, c: F.struct((2 * F.col("id") + at).alias("id"), F.col(f"{c}_to").alias("to"), F.col(f"{c}_entries").alias("entries"), F.col(f"{c}_depth").alias("depth"))
    steps = joined.select(F.inline(F.array(step(0, "e"), step(1, "l")))).where("to is not null").join(small(asked), "id")
    ranks = small(stored(ranked(steps), "outline-ranks"))
    enter = ranks.select(F.col("id").alias("e_to"), F.col("to").alias("e_end"), F.col("entries").alias("e_more"), F.col("depth").alias("e_above"))
    leave = ranks.select(F.col("id").alias("l_to"), F.col("to").alias("l_end"), F.col("entries").alias("l_more"))
    both = joined.join(enter, "e_to", "left").join(leave, "l_to", "left")
    end, left_end = F.coalesce("e_end", "e_to"), F.coalesce("l_end", "l_to", F.lit(END))
    after, left_after = (F.col(f"{c}_entries") + F.coalesce(f"{c}_more", F.lit(0)) for c in "el")
    below = F.when(F.col("first_id").isNull(), 0).otherwise(after - left_after - 1)
    places = [end.alias("end"), ((end == END) & (left_end == END)).alias("ends"), after.alias("after"), (F.col("e_depth") + F.coalesce("e_above", F.lit(0)) + 1).alias("depth"), below.alias("below")]
    return both.select(*entries.columns, *places, "visits", "wrong_parent", "wrong_prev", "last_ok", "far_first", "far_next", "far_last")


def positions(rows: DataFrame) -> DataFrame:
    """(tree, node, title, position from 0 in reading order, depth from 1,
    descendants) of the entries whose list comes to the end of their tree. Of a
    sound outline these are all; `problems` says where one is not sound."""
    placed = _placed(rows).where("ends")
    totals = stored(placed.groupBy("tree").agg(F.max("after").alias("total")), "outline-totals")
    return placed.join(small(totals), "tree").select("tree", "node", "title", (F.col("total") - F.col("after")).alias("position"), "depth", F.col("below").alias("descendants"))


def problems(rows: DataFrame, deepest: int = 100) -> DataFrame:
    """(tree, node, problem), one row each: where an outline's links, counts or
    titles do not agree. `parent` and `prev` are found at the entry that a
    first or next link leads to."""
    placed = _placed(rows)
    far = placed.where("far_first").select(F.col("first_id").alias("id"), F.col("id").alias("owner"), F.lit(None).cast("long").alias("before"))
    far = stored(far.unionByName(placed.where("far_next").select(F.col("next_id").alias("id"), F.col("parent_id").alias("owner"), F.col("id").alias("before"))), "outline-far-visits")
    met = placed.select("id", "parent_id", "prev_id").join(small(far), "id").groupBy("id").agg(
        F.count("*").alias("far_visits"),
        F.bool_or(~F.col("owner").eqNullSafe(F.col("parent_id"))).alias("far_wrong_parent"),
        F.bool_or(~F.col("before").eqNullSafe(F.col("prev_id"))).alias("far_wrong_prev"),
    )
    lasts = stored(placed.where("far_last").select("id", "last_id"), "outline-far-last")
    ends = placed.select(F.col("id").alias("last_id"), F.col("parent_id").alias("last_parent"), F.col("next_id").alias("last_next"))
    ends = ends.join(small(lasts), "last_id").select("id", ((F.col("last_parent") == F.col("id")) & F.col("last_next").isNull()).alias("far_last_ok"))
    tops = stored(placed.where("parent_id is null and prev_id is null").groupBy("tree").agg(F.min("id").alias("top")), "outline-tops")
    all_ = placed.join(small(stored(met, "outline-far-visits")), "id", "left").join(small(stored(ends, "outline-far-last")), "id", "left").join(small(tops), "tree", "left")
    leaf, top = F.col("first_id").isNull(), F.col("id") == F.col("top")
    visits = F.col("visits") + F.coalesce("far_visits", F.lit(0))
    checks = {
        "repeated": F.col("copies") > 1,
        "missing": reduce(lambda a, b: a | b, (F.coalesce(F.col(f"{r}_id") == BROKEN, F.lit(False)) for r in REFERENCES)),
        "cycle": (F.col("end") >= 0) | (F.col("end") == LOOP),
        "shared": visits > 1,
        "unreached": (visits == 0) & ~F.coalesce(top, F.lit(False)),
        "parent": F.col("wrong_parent") | F.coalesce("far_wrong_parent", F.lit(False)),
        "prev": F.col("wrong_prev") | F.coalesce("far_wrong_prev", F.lit(False)),
        "last": ~leaf & ~(F.col("last_ok") | F.coalesce("far_last_ok", F.lit(False))),
        "leaf": leaf & (F.col("last_id").isNotNull() | F.col("count").isNotNull()),
        "count": ~leaf & F.col("ends") & ~F.col("count").cast("long").eqNullSafe(F.col("below")),
        "depth": F.col("ends") & (F.col("depth") > deepest),
        "title": F.coalesce(F.trim("title"), F.lit("")) == "",
    }
    found = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in checks.items())))
    return all_.select("tree", "node", F.explode(found).alias("problem"))


def differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Two outlines (rows as of `positions`) compared entry by entry in reading
    order: the positions (tree, position) at which depth or title differ or one
    has no entry."""
    sides = [df.select("tree", "position", F.struct("depth", "title").alias(name)) for df, name in ((expected, "expected"), (actual, "actual"))]
    both = sides[0].join(sides[1], ["tree", "position"], "full").where(~F.col("expected").eqNullSafe(F.col("actual")))
    return both.select("tree", "position", F.col("expected.depth").alias("expected_depth"), F.col("expected.title").alias("expected_title"), F.col("actual.depth").alias("actual_depth"), F.col("actual.title").alias("actual_title"))
