"""Packing: optimal length buckets, and token-budget batches inside each.

The histogram of all lengths is aggregated; dynamic programming chooses the
bucket boundaries that minimise the padding of all documents (each is padded
to its bucket's boundary). Inside a bucket documents are dealt into batches of
as many rows as the token budget allows at the padded length, one at least.

Only DataFrame functions touch the rows. Scale: the histogram is exact. It is
bounded by the corpus in a way that a driver can hold: texts of L distinct
lengths have L * L / 2 tokens at least, so 10 ** 13 tokens have 4.5 million
distinct lengths at most, 16 bytes each; the table is filled level by level in
arrays. Who wants a smaller histogram sets DISTINCT: beyond that many lengths,
those above EXACT share cells 1/64 of their size wide, whose bound is the
greatest length in the cell. Numbering the documents of a bucket, which may
hold most rows, is dealt out over sub-ranges of a hash, whose counts give the
offsets.

Defined cases: a null or negative length counts as 0 tokens. Documents longer than the
budget are alone in their batch. Fewer distinct lengths than buckets give
fewer buckets. Repeated rows, of the same id and length too, are packed each,
in any order among themselves. An empty table packs nothing. Extra columns
pass through, but for columns named as the result's own, which it replaces.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WHITE_TEXT, constant, fresh, stored

BUCKETS, BUDGET = 16, 16_384
EXACT = 16_384
#: Distinct lengths beyond which long ones share cells; None: never.
DISTINCT: int | None = None
#: Costs that are compared together while the table is filled.
COSTS = 1 << 21
#: Rows of a sub-range that one window numbers, on average.
ROWS_PER_RANGE = 20_000


def n_words(text_col: str) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` and one end: a length in words, not in
    tokens of a tokenizer."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    for w in WHITE_TEXT[1:]:
        text = F.replace(text, F.lit(w), F.lit(" "))
    return (F.size(F.array_remove(F.split(text, " "), "")) + 1).cast("long")


def _length(length_col: str) -> Column:
    return F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))


def _cell(length: Column) -> Column:
    """The grid's cell of a length: itself, or rounded up to a multiple of
    1/64 of the power of two below it."""
    step = F.greatest(F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double"))) - 6).cast("long"), F.lit(1).cast("long"))
    return F.when(length <= EXACT, length).otherwise(F.ceil(length / step).cast("long") * step)


def _best_splits(best: np.ndarray, upto: np.ndarray, size: np.ndarray, mid: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each mid the least cost of one more bucket that ends there, over the
    splits from first to last, and the first split that has it."""
    cost, cut = np.empty(len(mid), best.dtype), np.empty(len(mid), np.int64)
    sizes = last - first + 1
    ends = np.cumsum(sizes)
    at = 0
    while at < len(mid):  # so many splits at a time, or those of one mid
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + COSTS, "right")))
        n, m = sizes[at:to], mid[at:to]
        begin = np.cumsum(n) - n
        i = np.arange(n.sum()) - np.repeat(begin - first[at:to], n)
        each = best[i] + (np.repeat(upto[m], n) - upto[i]) * np.repeat(size[m - 1], n)
        least = np.minimum.reduceat(each, begin)
        hits = np.flatnonzero(each == np.repeat(least, n))
        cost[at:to], cut[at:to] = least, i[hits[np.searchsorted(hits, begin)]]
        at = to
    return cost, cut


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The upper bounds (some of `lengths`, sorted) of at most `buckets`
    buckets with the least total padding. The cost of a range satisfies the
    quadrangle inequality, so each row of the table is filled by halving the
    range of best splits, all middles of a level together: O(buckets * n log n)."""
    n = len(lengths)
    if n <= buckets:
        return lengths.tolist()
    # whole numbers as far as they go: no padded total is larger than this
    kind = np.int64 if float(counts.sum(dtype=float)) * float(lengths[-1]) < 2.0**62 else np.float64
    upto = np.concatenate(([0], np.cumsum(counts.astype(kind))))
    size = lengths.astype(kind)
    # padded tokens of lengths[i:j] in one bucket, less a sum that is the same for all
    best = np.concatenate((np.zeros(1, kind), upto[1:] * size))
    cuts = []
    for _ in range(1, buckets):
        now, cut = np.zeros(n + 1, kind), np.zeros(n + 1, np.int32)
        lo, hi, first, last = (np.array([x]) for x in (1, n, 0, n - 1))
        while len(lo):
            mid = (lo + hi) // 2
            now[mid], found = _best_splits(best, upto, size, mid, first, np.minimum(last, mid - 1))
            cut[mid] = found
            lo, hi, first, last = np.concatenate((lo, mid + 1)), np.concatenate((mid - 1, hi)), np.concatenate((first, found)), np.concatenate((found, last))
            some = lo <= hi
            lo, hi, first, last = lo[some], hi[some], first[some], last[some]
        best = now
        cuts.append(cut)
    out, at = [], n
    for cut in reversed(cuts):
        out.append(int(lengths[at - 1]))
        at = int(cut[at])
        if at == 0:
            break
    if at:
        out.append(int(lengths[at - 1]))
    return sorted(set(out))


def choose(docs: DataFrame, length_col: str = "n_tokens", buckets: int = BUCKETS) -> list[tuple[int, int]]:
    """(upper bound, documents) of each bucket, from the global histogram."""
    length = _length(length_col)
    exact = stored(docs.groupBy(length.alias("length")).count(), "packing-lengths")
    if DISTINCT is not None and exact.count() > DISTINCT:
        exact = exact.groupBy(_cell(F.col("length"))).agg(F.max("length").alias("length"), F.sum("count").alias("count"))
    table = exact.select("length", "count").toArrow()
    lengths, counts = (table.column(c).to_numpy().astype(np.int64) for c in ("length", "count"))
    order = np.argsort(lengths)
    lengths, counts = lengths[order], counts[order]
    bounds = boundaries(lengths, counts, buckets) if len(lengths) else []
    owner = np.searchsorted(bounds, lengths)
    return [(b, int(counts[owner == i].sum())) for i, b in enumerate(bounds)]


def pack(docs: DataFrame, id_col: str = "doc_id", length_col: str = "n_tokens", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """docs with bucket, bucket_tokens (the padded length), batch (numbered
    within the bucket), slot (within the batch) and padding."""
    made = ("bucket", "bucket_tokens", "batch", "slot", "padding")
    names = [c for c in docs.columns if c not in made]
    docs = stored(docs.select(*names), "packing-rows")  # the length may be dear to compute and is read several times
    chosen = choose(docs, length_col, buckets)
    if not chosen:
        return docs.select(*names, *(F.lit(0).cast("long").alias(m) for m in made))
    bounds = constant([b for b, _ in chosen], "array<bigint>")
    ranges = constant([max(1, n // ROWS_PER_RANGE) for _, n in chosen], "array<bigint>")
    taken = [*names, *made]
    length, part, nth, before = (fresh(taken, x) for x in ("length", "part", "nth", "before"))
    rows = docs.select(*names, _length(length_col).alias(length))
    rows = rows.withColumn("bucket", sum((F.when(F.col(length) > b, 1).otherwise(0) for b, _ in chosen), F.lit(0)).cast("long"))
    rows = rows.withColumns({"bucket_tokens": F.element_at(bounds, F.col("bucket").cast("int") + 1), part: F.pmod(F.xxhash64(F.col(id_col), F.col(length)), F.element_at(ranges, F.col("bucket").cast("int") + 1))})
    sizes = rows.groupBy("bucket", part).agg(F.count("*").alias(nth))
    upto = Window.partitionBy("bucket").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("bucket"), F.col(part), F.coalesce(F.sum(nth).over(upto), F.lit(0)).alias(before))
    each = Window.partitionBy("bucket", part).orderBy(F.col(id_col), F.col(length))
    numbered = rows.withColumn(nth, F.row_number().over(each).cast("long") - 1).join(offsets, ["bucket", part])
    per = F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("bucket_tokens"), F.lit(1))).cast("long"), F.lit(1).cast("long"))
    at = F.col(nth) + F.col(before)
    out = numbered.withColumns({"batch": F.floor(at / per).cast("long"), "slot": (at % per).cast("long"), "padding": F.col("bucket_tokens") - F.col(length)})
    return out.select(*names, *made)
