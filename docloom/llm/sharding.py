"""Sharding by sampled splitters; law `bytes`: shards of near-equal size.

Draw a size-weighted sample of record keys, choose quantile boundaries of it,
range-partition the records, measure the ranges, subdivide those that are
overfull, and cut the ranges' running byte total at equal parts. A group of
equal texts that is smaller than a 64th of a shard's share goes where its
first record goes; larger groups are divided. Every shard then holds its share
of the bytes to within one record or one such group.

The key is (md5 of the text, id): equal texts are neighbours, and a hot text
is divisible by id. Identical rows (same id and text) cannot be told apart by
key; they share a range and are cut by their running number.

Only DataFrame functions are used. Scale: there are 256 ranges, or one for
each million rows if that is more. What reaches the driver is the sample (32
keys a range in expectation) and one row per range; the windows that number
records hold narrow keys of one range, not of one shard, and no text.

Defined cases: a null text has no bytes and an md5 of the empty text; null
ids sort first. A record's size is its UTF-8 bytes plus 1. Fewer records than
shards leave shards empty. Extra columns pass through shard_records.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import constant, fresh, stored

#: Ranges at least, and rows of a range on average where there are more.
RANGES, ROWS_PER_RANGE = 256, 1_000_000
#: Keys that are drawn for each range.
DRAWN = 32
#: A group of equal texts stays whole up to this part of a shard.
WHOLE = 64
LEAST = -(1 << 63)


@dataclass(frozen=True)
class Plan:
    """Splitters (sorted distinct keys), and rows and bytes before each range."""

    splitters: list[tuple]
    rows: list[int]
    sizes: list[int]
    total: int


def _md5(text_col: str) -> Column:
    return F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def _size(text_col: str) -> Column:
    return F.coalesce(F.octet_length(F.col(text_col).cast("string")).cast("long"), F.lit(0).cast("long")) + 1


def _sorts(key: Column, doc: Column) -> Column:
    return F.struct(key.alias("key"), F.coalesce(doc, F.lit(LEAST)).alias("doc"))


def _range_of(at: Column, splitters: list[tuple]) -> Column:
    """How many splitters are not above the key: first among the heads of
    blocks of equal length, then within one block."""
    if not splitters:
        return F.lit(0)
    keys = [{"key": k, "doc": d} for k, d in splitters]
    wide = max(16, math.isqrt(len(keys)))
    blocks = [keys[i : i + wide] for i in range(0, len(keys), wide)]
    kind = "struct<key:string,doc:bigint>"
    block = F.size(F.filter(constant([b[0] for b in blocks], f"array<{kind}>"), lambda s: s <= at))
    inner = F.element_at(constant(blocks, f"array<array<{kind}>>"), F.greatest(block, F.lit(1)))
    return F.when(block == 0, 0).otherwise((block - 1) * wide + F.size(F.filter(inner, lambda s: s <= at)))


def _draw(rows: DataFrame, rate: Column) -> list[tuple]:
    """Keys drawn with a probability of `rate` for each byte; a key draws the
    same number each time, so a repeated task repeats the sample."""
    number = F.shiftrightunsigned(F.xxhash64("key", "doc"), 11) / float(1 << 53)
    return sorted({(r.key, r.doc) for r in rows.where(number < F.col("size") * rate).select("key", "doc").distinct().collect()})


def plan_ranges(rows: DataFrame, shards: int, ranges: int | None = None) -> Plan:
    """rows: key, doc, size. The ranges' splitters, measured and subdivided
    until no range that may be divided holds twice its share. Groups of equal
    texts that are to stay whole (see place) are not divided."""
    whole = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.count("*").alias("n")).first()
    total = whole.size
    if not total:
        return Plan([], [0], [0], 0)
    ranges = ranges or max(RANGES, whole.n // ROWS_PER_RANGE)
    drawn = _draw(rows, F.lit(DRAWN * ranges / total))
    # before a key's first record, so that equal texts share a range
    splitters = sorted({(drawn[len(drawn) * i // ranges][0], LEAST) for i in range(1, ranges)}) if drawn else []
    tried: set[tuple] = set()
    while True:
        at = _range_of(_sorts(F.col("key"), F.col("doc")), splitters)
        measured = {r.range: (r.n, r.size) for r in rows.groupBy(at.alias("range")).agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()}
        low = [("", LEAST), *splitters]
        over = [i for i, (_, size) in measured.items() if size > 2 * total // ranges and low[i] not in tried]
        if not over:
            break
        inside = rows.withColumn("range", at).where(F.col("range").isin(over))
        sizes = constant({str(i): float(measured[i][1]) for i in over}, "map<string,double>")
        found: dict[int, list] = {}
        for r in _draw(inside, 64 / F.element_at(sizes, F.col("range").cast("string"))):
            found.setdefault(sum(s <= r for s in splitters), []).append(r)
        lone = {i: found[i][0][0] for i in over if i in found and len({k for k, _ in found[i]}) == 1}
        heavy = {r.key: r.size for r in rows.where(F.col("key").isin(list(lone.values()))).groupBy("key").agg(F.sum("size").alias("size")).collect()} if lone else {}
        new = set()
        for i in over:
            keys = found.get(i, [])
            parts = min(len(keys), max(2, -(-measured[i][1] * ranges // total)))
            cuts = {(keys[len(keys) * j // parts][0], LEAST) for j in range(parts)}
            if i in lone:  # mostly one key: cut before and after it, and by id
                cuts.add((lone[i] + " ", LEAST))
                if heavy[lone[i]] * shards * WHOLE > total:
                    cuts |= {keys[len(keys) * j // parts] for j in range(parts)}
            if cuts <= {*splitters}:  # nothing to divide it by
                tried.add(low[i])
            new |= cuts
        splitters = sorted({*splitters, *new})
    n, size = [0], [0]
    for i in range(len(splitters)):
        n.append(n[-1] + measured.get(i, (0, 0))[0])
        size.append(size[-1] + measured.get(i, (0, 0))[1])
    return Plan(splitters, n, size, total)


def place(rows: DataFrame, plan: Plan, shards: int, key: str, doc: str, size: str, shard: str, number: str) -> DataFrame:
    """rows with their shard and their number among all records. The cut of the
    running bytes decides; a small group of equal texts goes where it starts."""
    names = [*rows.columns, shard, number]
    span, before, nth, group, least = (fresh(names, x) for x in ("range", "before", "nth", "group", "least"))
    each = Window.partitionBy(span).orderBy(key, F.coalesce(F.col(doc), F.lit(LEAST)))
    upto = each.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy(span, key)
    offsets = lambda values: F.element_at(constant(values, "array<bigint>"), F.col(span) + 1)
    placed = rows.withColumn(span, _range_of(_sorts(F.col(key), F.col(doc)), plan.splitters))
    placed = placed.withColumns({before: F.sum(size).over(upto) - F.col(size), nth: F.row_number().over(each).cast("long") - 1})
    placed = placed.withColumns({group: F.sum(size).over(same), least: F.min(before).over(same)})
    small = F.col(group) * (shards * WHOLE) <= max(plan.total, 1)
    placed = placed.withColumns({before: F.when(small, F.col(least)).otherwise(F.col(before)) + offsets(plan.sizes), number: F.col(nth) + offsets(plan.rows)})
    return placed.withColumn(shard, F.expr(f"cast(`{before}` * {shards} div {max(plan.total, 1)} as int)")).drop(span, before, nth, group, least)


def _numbered(placed: DataFrame, shard: str, number: str, slot: str) -> DataFrame:
    firsts = {r[0]: r[1] for r in placed.groupBy(shard).agg(F.min(number)).collect()}
    start = F.element_at(F.create_map(*(x for k, v in firsts.items() for x in (F.lit(k), F.lit(v).cast("long")))), F.col(shard)) if firsts else F.lit(0).cast("long")
    return placed.withColumn(slot, F.col(number) - start).drop(number)


def assign_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: the assignment without texts."""
    doc = F.col(id_col).cast("long")
    rows = docs.select(doc.alias("doc_id"), F.coalesce(doc, F.lit(LEAST)).alias("doc"), _md5(text_col).alias("key"), _size(text_col).alias("size"), F.crc32(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_crc32"))
    rows = stored(rows, "shard-keys")
    placed = stored(place(rows, plan_ranges(rows, shards, ranges), shards, "key", "doc", "size", "shard", "number"), "shard-placed")
    return _numbered(placed, "shard", "number", "slot").select("doc_id", "size", "text_crc32", "shard", "slot")


def shard_records(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """The whole records with shard and slot, to be written by shard. Narrow
    keys are numbered; records meet their numbers by key, id and copy."""
    names = [c for c in docs.columns if c not in (shard_col, slot_col)]
    key, doc, copy = (fresh([*names, shard_col, slot_col], x) for x in ("key", "doc", "copy"))
    wide = docs.select(*names, _md5(text_col).alias(key), F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias(doc))
    # rows that share id and text are numbered among themselves, by all their
    # columns: a task that is tried again must number them alike
    repeated = Window.partitionBy(key, doc).orderBy(F.sha2(F.to_json(F.struct(*names)), 256))
    wide = wide.withColumn(copy, F.row_number().over(repeated))
    narrow = stored(docs.select(_md5(text_col).alias("key"), F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("doc"), _size(text_col).alias("size")), "shard-keys")
    placed = stored(place(narrow, plan_ranges(narrow, shards), shards, "key", "doc", "size", "shard", "number"), "shard-placed")
    numbered = _numbered(placed, "shard", "number", "slot").withColumn("copy", F.row_number().over(Window.partitionBy("key", "doc").orderBy("slot", "shard")))
    found = numbered.select(F.col("key").alias(f"{key}_"), F.col("doc").alias(f"{doc}_"), F.col("copy").alias(f"{copy}_"), F.col("shard").alias(shard_col), F.col("slot").alias(slot_col))
    return wide.join(found, (F.col(key) == F.col(f"{key}_")) & (F.col(doc) == F.col(f"{doc}_")) & (F.col(copy) == F.col(f"{copy}_"))).select(*names, shard_col, slot_col)
