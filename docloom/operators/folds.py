"""Order-dependent work on groups of any size, without a group in one cell.

`numbered` sorts rows by ranges of (group, order), so that a large group lies in
many partitions, and joins the partitions by their boundary states: one row for
each partition says how many rows of its last group came before. `fold_sorted`
streams the sorted rows of each group through a running state. `sorted_parts`
cuts a group's text into parts of a fixed number of rows by those numbers, where
the sorted rows lie; only what lies on the border of two tasks moves again.
`sorted_digest` hashes a group of any size segment by segment: a task takes up
the state that the task of the segment before has left.

Memory is one state and one Arrow batch. Equal rows may change places among
themselves. Null groups are groups like any other and come first. An empty
table gives an empty result.
"""

from __future__ import annotations

import _hashlib
import ctypes
import uuid
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..sources.shared import shared_root, stored

#: Rows of a part of a sorted text.
PART_ROWS = 1000
#: Bytes of a group's text that one task hashes, and of a piece of them; pieces
#: that are dealt out together.
SEGMENT, PIECE, PIECES = 128 << 20, 64 << 10, 256
#: Bytes of OpenSSL's SHA256_CTX, which is plain memory.
CONTEXT = 112
#: Result rows, and about as many bytes of texts in them, that a fold sends
#: together; rows that it takes from a batch at a time.
BATCH, BATCH_BYTES, ROWS = 4096, 4 << 20, 1000
#: How sorted rows are written: running numbers and what a value shares with the
#: one before take next to no room.
SORTED = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0"}


def _kinds(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _changes(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Where the values of some columns differ from the row before."""
    new = np.zeros(batch.num_rows, bool)
    for name in columns:
        new[1:] |= np.diff(batch.column(name).dictionary_encode("encode").indices.to_numpy()) != 0
    return new


def numbered(rows: DataFrame, group: list[str], order: list[str | Column], name: str = "nth", partitions: int | None = None, weight: str | None = None) -> DataFrame:
    """rows with their number in their group (no columns: all rows), from 0, in
    the given order; with a weight (a column of longs), the sum of the weights
    before them. No window, and no group in one task."""
    return _numbered(rows, group, order, name, partitions, weight).select(*rows.columns, name)


def _numbered(rows: DataFrame, group: list[str], order: list[str | Column], name: str, partitions: int | None = None, weight: str | None = None) -> DataFrame:
    """As numbered, with the sorted partition (part_) in which a row lies and
    its place there (at_)."""
    spark = rows.sparkSession
    count = partitions or max(rows.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, begin, last, total, index = TaskContext.get().partitionId(), None, None, 0, 0
        key = lambda batch, i: tuple(batch.column(g)[i].as_py() for g in group)
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            begin = key(batch, 0) if begin is None else begin
            new = _changes(batch, group)
            new[0] = key(batch, 0) != last
            weights = batch.column(weight).to_numpy() if weight else np.ones(n, np.int64)
            before = np.cumsum(weights) - weights + total
            # where a row's group begins in this batch, what came before it; else 0
            starts = np.flatnonzero(new)
            sums = np.concatenate(([0], before[starts]))[np.cumsum(new)]
            nth = before - sums
            first = np.full(n, key(batch, 0) == begin) & (np.cumsum(new) <= (1 if new[0] else 0))
            last, total = key(batch, n - 1), int(nth[-1] + weights[-1])
            at = pa.array(np.arange(index, index + n))
            index += n
            yield pa.record_batch([*batch.columns, pa.array(np.full(n, part, np.int32)), at, pa.array(nth), pa.array(first)], [*batch.schema.names, "part_", "at_", "nth_", "first_"])

    dealt = rows.repartitionByRange(count, *group, *order).sortWithinPartitions(*group, *order)
    local = stored(dealt.mapInArrow(run, f"{_kinds(rows)}, part_ int, at_ long, nth_ long, first_ boolean"), "numbered", **SORTED)
    per = local.groupBy("part_", *group).agg((F.sum(weight) if weight else F.count("*")).alias("n_"), F.min("at_").alias("low_"))
    held = F.struct("n_", *group)
    ends = per.groupBy("part_").agg(F.min_by(held, "low_").alias("first_"), F.max_by(held, "low_").alias("last_"))
    offsets, last, before = [], None, 0
    for r in ends.orderBy("part_").collect():  # one row for each partition
        first, end = tuple(r.first_)[1:], tuple(r.last_)[1:]
        offset = before if first == last else 0
        offsets.append((r.part_, offset))
        last, before = end, r.last_.n_ + (offset if first == end else 0)
    known = F.broadcast(spark.createDataFrame(offsets, "part_ int, offset_ long"))
    nth = F.col("nth_") + F.when(F.col("first_"), F.col("offset_")).otherwise(0)
    return local.join(known, "part_").withColumn(name, nth).select(*rows.columns, "part_", "at_", name)


def _folded(batches: Iterator[pa.RecordBatch], by: list[str], columns: list[str], state: Callable) -> Iterator[list[tuple]]:
    """The result rows of fold_sorted, some at a time."""
    key, now, out, held = None, None, [], 0
    for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
        keys, values = (zip(*(batch.column(c).to_pylist() for c in names)) for names in (by, columns))
        for k, row in zip(keys, values):
            if now is None or k != key:
                if now is not None and (r := now.done()) is not None:
                    out.append((*key, *r))
                    held += sum(len(v) for v in r if isinstance(v, (str, bytes)))
                key, now = k, state()
            if (r := now.add(*row)) is not None:
                out.append((*k, *r))
                held += sum(len(v) for v in r if isinstance(v, (str, bytes)))
            if len(out) >= BATCH or held >= BATCH_BYTES:
                yield out
                out, held = [], 0
    if now is not None and (r := now.done()) is not None:
        out.append((*key, *r))
    if out:
        yield out


def fold_sorted(rows: DataFrame, by: list[str], order: list[str], state: Callable, columns: list[str], results: str) -> DataFrame:
    """One pass over the rows of each group in order. `state()` makes an object
    whose add(*values of columns) takes a row and may return a result row, and
    whose done() returns the last one (None: no row). Result rows stand beside
    the group's columns."""
    kinds = f"{_kinds(rows.select(*by))}, {results}"
    schema = to_arrow_schema(StructType(_parse_datatype_string(kinds).fields))

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(made, _folded(batches, by, columns, state))

    used = [*dict.fromkeys([*by, *order, *columns])]
    return rows.select(*used).repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, kinds)


class _Joined:
    def __init__(self, between: str):
        self.texts, self.between = [], between

    def add(self, text: str | None) -> None:
        if text is not None:
            self.texts.append(text)

    def done(self):
        return (self.between.join(self.texts),)


class _Sha256:
    """SHA-256 by the OpenSSL that hashlib is linked with, as its state can be
    stored and taken up again by another process."""

    def __init__(self, state: bytes | None = None):
        self.library, self.context = ctypes.CDLL(_hashlib.__file__), ctypes.create_string_buffer(2 * CONTEXT)
        if state is None:
            self.library.SHA256_Init(self.context)
        else:
            ctypes.memmove(self.context, state, CONTEXT)

    def update(self, data: bytes) -> None:
        self.library.SHA256_Update(self.context, data, ctypes.c_size_t(len(data)))

    def state(self) -> bytes:
        return self.context.raw[:CONTEXT]

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        self.library.SHA256_Final(out, ctypes.create_string_buffer(self.context.raw))
        return out.raw.hex()


def _resumable() -> bool:
    """Whether states can be handed on: some builds hide OpenSSL's functions."""
    try:
        first = _Sha256()
        first.update(b"a" * 100)
        second = _Sha256(first.state())
        second.update(b"b" * 100)
        return second.hexdigest() == sha256(b"a" * 100 + b"b" * 100).hexdigest()
    except (OSError, AttributeError):
        return False


class _Digest:
    """SHA-256 of texts with something between them: its state after them, and
    the digest if nothing follows. A state that comes first is taken up; without
    texts there is no row. Where states can't be handed on, there is none."""

    def __init__(self, between: str, resumable: bool):
        self.hash, self.between, self.resumable, self.before, self.some = None, between.encode(), resumable, False, False

    def add(self, text: str | None, state: bytes | None) -> None:
        if self.hash is None:
            self.hash, self.before = _Sha256(state) if self.resumable else sha256(), state is not None
        if text is not None:
            if self.before or self.some:
                self.hash.update(self.between)
            self.some = True
            self.hash.update(text.encode())

    def done(self):
        return (self.hash.state() if self.resumable else None, self.hash.hexdigest()) if self.some else None


def _pieces(batches: Iterator[pa.RecordBatch], group: list[str], between: str, size: int, whole: bool) -> Iterator[list[tuple]]:
    """Over sorted rows with `part`: (group, part, number of the first row,
    joined text) of the stretches of one part that lie together, either those
    that are their whole part, or the others. A stretch that the end of a file
    or of a task cuts off is not known to be whole."""
    key, place, first, n, texts, out, held = None, None, 0, 0, [], [], 0

    def ended(followed: bool) -> None:
        nonlocal held
        if whole == (first % size == 0 and (followed or n == size)):
            text = between.join(texts) if texts else None
            out.append((*key, first, text))
            held += len(text or "")

    for batch in batches:
        if batch.num_rows == 0:
            continue
        part, at, nth, own = (batch.column(c).to_numpy() for c in ("part_", "at_", "nth_in_group", "part"))
        new = _changes(batch, group)
        new[1:] |= np.diff(own) != 0
        apart = np.zeros(len(new), bool)  # another file, or rows between
        apart[1:] = (np.diff(part) != 0) | (np.diff(at) != 1)
        starts = np.union1d([0], np.flatnonzero(new | apart))
        text = batch.column("text_")
        valid = np.concatenate(([0], np.cumsum(text.is_valid().to_numpy(zero_copy_only=False))))
        offsets = valid[np.append(starts, len(new))]
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), text.drop_null()), between)
        for i, (start, end) in enumerate(zip(starts.tolist(), [*starts.tolist()[1:], len(new)])):
            now = (*(batch.column(g)[start].as_py() for g in group), int(own[start]))
            follows = not apart[start] if start else place == (part[0], at[0] - 1)
            if key is None or not follows or now != key:
                if key is not None:
                    ended(bool(follows))
                key, first, n, texts = now, int(nth[start]), 0, []
            n += end - start
            if offsets[i + 1] > offsets[i]:
                texts.append(joined[i].as_py())
            if len(out) >= BATCH or held >= BATCH_BYTES:
                yield out
                out, held = [], 0
        place = (part[-1], at[-1])
    if key is not None:
        ended(False)
    if out:
        yield out


def sorted_parts(rows: DataFrame, group: list[str], order: list[str | Column], text: Column, between: str = "", size: int = PART_ROWS, partitions: int | None = None) -> DataFrame:
    """A group's texts in order, `size` of them joined to a part: the group's
    columns, part (from 0) and text; null texts are passed over. A group of any
    size is spread by parts. All columns of rows are sorted and written once,
    so they should be those that order and text need: the texts are made of
    them afterwards, and a part is joined by the task that reads its rows. Only
    parts that two tasks share, two for each task at most, are shuffled."""
    ranked = _numbered(rows, group, order, "nth_in_group", partitions)
    ranked = ranked.select(*group, "part_", "at_", "nth_in_group", F.expr(f"nth_in_group div {size}").alias("part"), text.alias("text_"))
    kinds = f"{_kinds(rows.select(*group))}{', ' * bool(group)}part long, nth_in_group long, text_ string"
    schema = to_arrow_schema(StructType(_parse_datatype_string(kinds).fields))

    def pieces(whole: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for out in _pieces(batches, group, between, size, whole):
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        return ranked.mapInArrow(run, kinds)

    shared = fold_sorted(pieces(False), [*group, "part"], ["nth_in_group"], lambda: _Joined(between), ["text_"], "text string")
    return pieces(True).select(*group, "part", F.coalesce("text_", F.lit("")).alias("text")).unionByName(shared)


def sorted_digest(rows: DataFrame, group: list[str], order: list[str], text: Column, between: str = "", partitions: int | None = None) -> DataFrame:
    """The SHA-256 of each group's texts in order with `between` between them;
    null texts are left out. A group is cut into segments of about SEGMENT
    bytes, whose texts are joined to pieces in parallel. The digest of a whole
    group is sequential: segments are hashed one after another, those of
    different groups together, by tasks that read one segment of a group and
    the state before it. Where states can't be handed on (see _resumable), a
    group is one segment, and one task reads all of its pieces."""
    spark, resumable = rows.sparkSession, _resumable()
    narrow = rows.select(*dict.fromkeys([*group, *order]), text.alias("text_")).where("text_ is not null")
    placed = numbered(narrow.withColumn("bytes_", F.octet_length("text_").cast("long") + 1), group, order, "before_", partitions, "bytes_")
    segment = F.expr(f"before_ div {SEGMENT}") if resumable else F.lit(0).cast("long")
    placed = placed.select(*group, "before_", "text_", segment.alias("segment_"), F.expr(f"before_ div {PIECE * PIECES}").alias("chunk_"), F.expr(f"before_ div {PIECE}").alias("piece_"))
    dealt = placed.repartition(*group, "segment_", "chunk_")
    held = F.sort_array(F.collect_list(F.struct("before_", "text_")))
    pieces = dealt.groupBy(*group, "segment_", "chunk_", "piece_").agg(F.array_join(F.transform(held, lambda x: x["text_"]), between).alias("text_"))
    folder, states = (f"{shared_root(spark)}/digest-{kind}-{uuid.uuid4().hex}" for kind in ("pieces", "states"))
    pieces = pieces.drop("chunk_")
    pieces.write.partitionBy("segment_").parquet(folder)
    pieces = spark.read.schema(pieces.schema).parquet(folder)
    last = pieces.agg(F.max("segment_")).first()[0] or 0
    made = None
    for k in range(last + 1):
        now = pieces.where(F.col("segment_") == k).select(*group, "piece_", "text_", F.lit(None).cast("binary").alias("state_"))
        if made is not None:
            now = now.unionByName(made.select(*group, F.lit(-1).cast("long").alias("piece_"), F.lit(None).cast("string").alias("text_"), "state_"))
        hashed = fold_sorted(now, group, ["piece_"], lambda: _Digest(between, resumable), ["text_", "state_"], "state_ binary, digest string")
        hashed.write.parquet(f"{states}/segment_={k}")
        made = spark.read.schema(hashed.schema).parquet(f"{states}/segment_={k}")
    ends = spark.read.schema(hashed.withColumn("segment_", F.lit(0).cast("long")).schema).parquet(states)
    return ends.groupBy(*group).agg(F.max_by("digest", "segment_").alias("digest"))


def framed_parts(parts: DataFrame, group: list[str], head: DataFrame, tail: Column | str, between: str = "") -> DataFrame:
    """A document for each group as rows (group, part, text) whose texts in the
    order of part make it up: the group's head (a column `head`), the parts
    with `between` between them, the tail."""
    low, high = F.lit(-1).cast("long"), F.lit((1 << 62)).cast("long")
    end = F.lit(tail) if isinstance(tail, str) else tail
    body = parts.select(*group, F.col("part").cast("long").alias("part"), F.when(F.col("part") > 0, F.concat(F.lit(between), "text")).otherwise(F.col("text")).alias("text"))
    return head.select(*group, low.alias("part"), F.col("head").alias("text")).unionByName(body).unionByName(head.select(*group, high.alias("part"), end.alias("text")))


class _Budget:
    """Takes pages in order while they fit: none over its own cap, none that
    would take the sum over the group's; later smaller ones may fit."""

    def __init__(self, page_cap: int, group_cap: int):
        self.page_cap, self.group_cap, self.used = page_cap, group_cap, 0

    def add(self, order, n: int):
        if n > self.page_cap or self.used + n > self.group_cap:
            return None
        self.used += n
        return (order,)

    def done(self) -> None:
        return None


def within_budget(sizes: DataFrame, group: str, order: str, n: str, page_cap: int, group_cap: int) -> DataFrame:
    """The (group, order) of the pages that are taken. Every page's decision
    hangs on all before it, so a group's sizes (narrow rows) stream through one
    task; pages over their own cap don't take part."""
    kind = sizes.schema[order].dataType.simpleString()
    rows = sizes.where(F.col(n) <= page_cap)
    return fold_sorted(rows, [group], [order], lambda: _Budget(page_cap, group_cap), [order, n], f"`{order}` {kind}")
