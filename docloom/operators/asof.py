"""As-of joins by ranges: each left row with the nearest right row of its key.

Both sides are sorted together by ranges of (key, time), so that a key of any
size lies in many partitions. One pass carries the last right row along. What a
partition's first rows need from before it comes from the boundary states: one
row for each partition, its last right row if that still holds at its end, is
handed on from partition to partition.

Memory is one Arrow batch and one right row. Each row is sent once.

Defined cases: a left row without a match has nulls. Null keys and null times
match nothing; such left rows stay. Of right rows at one time, the greatest by
the values counts. Left rows that are equal are matched each. Empty sides give
an empty result or no matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored

LEFT, STATE = 1, 2


def _same(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Whether each row has the key of the row before (False for the first)."""
    out = np.ones(batch.num_rows, bool)
    out[:1] = False
    for n in names:
        out[1:] &= np.diff(batch.column(n).dictionary_encode("encode").indices.to_numpy()) == 0
    return out


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: Column, right_time: Column, values: dict[str, str], forward: bool = False, strict: bool = False, partitions: int | None = None) -> DataFrame:
    """left with the values (a right column for each new name) of the right row
    of the same key whose time is nearest at or before the left row's (forward:
    at or after; strict: not at)."""
    spark, names = left.sparkSession, left.columns
    count = partitions or max(left.rdd.getNumPartitions(), right.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [f"key{i}_" for i in range(len(by))]
    own = [F.col(b).alias(k) for b, k in zip(by, keys)]
    kept, got = [f"l{i}_" for i in range(len(names))], ["hit_", *(f"r{i}_" for i in range(len(values)))]
    rows = left.select(*own, left_time.alias("time_"), F.lit(LEFT).alias("side_"), *(F.col(n).alias(k) for n, k in zip(names, kept)))
    others = right.select(*own, right_time.alias("time_"), F.lit(0).alias("side_"), F.lit(True).alias("hit_"), *(F.col(v).alias(g) for v, g in zip(values.values(), got[1:])))
    others = others.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in [*keys, "time_"])))
    both = rows.unionByName(others, allowMissingColumns=True)
    # right rows stand before the left rows that they may serve; the last one counts
    side = F.col("side_").desc() if strict else F.col("side_").asc()
    time = F.col("time_").desc() if forward else F.col("time_").asc()
    order = [*(F.col(k) for k in keys), time, side, *(F.col(g) for g in got)]
    dealt = both.repartitionByRange(count, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last, held, shape = TaskContext.get().partitionId(), None, None, None, None
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            shape = batch
            same, at = _same(batch, keys), np.arange(n)
            begin = tuple(batch.column(k)[0].as_py() for k in keys)
            if first is None:
                first = begin
            # where the row's key begins: -1 if in the batch before
            start = np.maximum.accumulate(np.where(same, -1, at))
            goes_on = begin == last
            if goes_on:
                start[start == 0] = -1
            side = batch.column("side_").to_numpy()
            match = np.maximum.accumulate(np.where(side == 0, at, -1))
            match = np.where(match >= np.maximum(start, 0), match, -1)
            match = np.where((match < 0) & (start < 0) & (held is not None), n, match)
            match[batch.column("time_").is_null().to_numpy(zero_copy_only=False)] = -1
            mine = np.flatnonzero(side == LEFT)
            index = pa.array(match[mine], mask=match[mine] < 0)
            pool = lambda g: pa.concat_arrays([batch.column(g), *([held.column(g)] if held is not None else [])])
            columns = [(pool(g).take(index) if g in got else batch.column(g).take(pa.array(mine))) for g in batch.schema.names]
            # unmatched rows of the partition's first key ask the partitions before
            asks = (start <= 0) & (match < 0) if begin == first else np.zeros(n, bool)
            yield pa.record_batch([*columns, pa.array(np.full(len(mine), part, np.int32)), pa.array(asks[mine])], [*batch.schema.names, "part_", "open_"])
            last = tuple(batch.column(k)[-1].as_py() for k in keys)
            end = int(np.max(np.where(side == 0, at, -1)))
            if end >= max(start[-1], 0):
                held = batch.select(got).slice(end, 1)
            elif start[-1] >= 0:  # another key began, without a right row
                held = None
        if shape is not None:  # the state at the partition's end
            row = shape.slice(shape.num_rows - 1)
            state = {"side_": pa.array([STATE], pa.int32())} | {g: held.column(g) for g in (got if held is not None else [])}
            columns = [state.get(c, row.column(c) if c in keys else pa.nulls(1, row.schema.field(c).type)) for c in row.schema.names]
            # open: the state of the partitions before still holds, if it is of this key
            yield pa.record_batch([*columns, pa.array([part], pa.int32()), pa.array([held is None and first == last])], [*row.schema.names, "part_", "open_"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema)
    local = stored(dealt.mapInArrow(run, f"{kinds}, part_ int, open_ boolean"), "asof")
    state, carried = None, []
    for r in local.where(F.col("side_") == STATE).orderBy("part_").select("part_", "open_", *keys, *got).collect():  # one row for each partition
        if state is not None:
            carried.append((r.part_, *state))
        if r.hit_:
            state = (*(r[k] for k in keys), *(r[g] for g in got))
        elif not r.open_ or state is None or state[: len(keys)] != tuple(r[k] for k in keys):
            state = None
    schema = local.select(F.col("part_").alias("part"), *(F.col(k).alias(f"{k}c") for k in keys), *(F.col(g).alias(f"{g}c") for g in got)).schema
    before = F.broadcast(spark.createDataFrame(carried, schema))
    on = [F.col("part_") == F.col("part"), F.col("open_"), F.col("time_").isNotNull(), *(F.col(k) == F.col(f"{k}c") for k in keys)]
    filled = local.where(F.col("side_") == LEFT).join(before, reduce(lambda a, b: a & b, on), "left")
    return filled.select(*(F.col(k).alias(n) for k, n in zip(kept, names)), *(F.when(F.col("part").isNotNull(), F.col(f"{g}c")).otherwise(F.col(g)).alias(v) for g, v in zip(got[1:], values)))
