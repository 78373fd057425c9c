"""An inverted index of character trigrams, for searches that contain a text.

Every position of a row's searched text starts one gram (the end is padded), so
that a term of three or more characters is found by its own grams and a shorter
one by the range of grams that begin with it. Rows are numbered by their
ordinal; 65,536 of them make a segment. The posting list of a gram is cut by
segment into containers: sorted 16-bit numbers, or a bitmap where that is
smaller. Containers lie in buckets of their gram (folders) and are sorted by
gram, so a query reads the folders and row groups of its grams only.

A query takes the rarest grams of its terms by their counts, intersects their
containers segment by segment, the rarest first, and looks for the whole terms
in the candidates alone. What the index spares decides nothing: the rows are
those of the scan.

Scale: the index is built in one pass over the texts; each batch sends one
partial container for each gram and segment, which are merged where they meet.
A frequent gram has a row for every segment, spread over files by ranges of
segments. Intersections are grouped by segment: at most MOST containers each.
Rows lie in folders by ranges of ordinals, and the join with the candidates
prunes the folders without any.

Defined cases: a null field of the text is left out, as in the scan; null and
empty texts have no grams (they hold no term). Rows that share an ordinal are
found each on its own. Rows without an ordinal are an error, as results are in
their order. An empty index finds nothing; so does a query without terms.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Characters of a gram; a code point has 21 bits, so three fill a long.
GRAM = 3
#: Rows of a segment, as a power of two.
SEGMENT_BITS = 16
#: Segments whose containers of one bucket share a file, as a power of two.
FILE_BITS = 8
#: Rows whose texts share a folder, as a power of two.
FOLDER_BITS = 20
#: Grams of a query that are intersected.
MOST = 8
#: Rows that build partial containers together, and the grams (once for each
#: row) after which they are full.
BATCH, BATCH_GRAMS = 4096, 1 << 20
#: Rows of containers, of at most 8 KB each, that are looked at or sent together.
HELD = 256

_POSTING = "gram long, segment long, n int, held binary"


def packed(points: Sequence[int]) -> int:
    """A gram as one number, the first character highest."""
    out = 0
    for p in points:
        out = out << 21 | p
    return out


def grams_of(term: str) -> list[int]:
    """The grams inside a term of three or more characters."""
    points = list(map(ord, term))
    return sorted({packed(points[i : i + GRAM]) for i in range(len(points) - GRAM + 1)})


def range_of(term: str) -> tuple[int, int]:
    """The grams, from and before, that begin with a shorter term."""
    free = 21 * (GRAM - len(term))
    low = packed(list(map(ord, term)))
    return low << free, (low + 1) << free


def text_grams(text: str) -> np.ndarray:
    """The sorted distinct grams of a text; its end is padded with zeros."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points = np.concatenate((points, np.zeros(GRAM - 1, np.int64)))
    out = points[: len(points) - GRAM + 1].copy()
    for k in range(1, GRAM):
        out = out << 21 | points[k : len(points) - GRAM + 1 + k]
    return np.unique(out)


def to_container(low: np.ndarray) -> bytes:
    """Sorted distinct numbers below 65,536."""
    if len(low) * 2 <= 8192:
        return low.astype("<u2").tobytes()
    bits = np.zeros(1 << SEGMENT_BITS, np.uint8)
    bits[low] = 1
    return b"\1" + np.packbits(bits).tobytes()  # an odd size marks a bitmap


def from_container(held: bytes) -> np.ndarray:
    if len(held) % 2 == 0:
        return np.frombuffer(held, "<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(held, np.uint8, offset=1))).astype("<u2")


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ord, text) to one container for each gram and segment of some rows."""

    def full() -> Iterator[tuple[list, list]]:
        rows, each, size = [], [], 0
        for batch in batches:
            for ord_, text in zip(batch.column(0), batch.column(1)):  # a text at a time leaves Arrow
                grams = text_grams(t) if (t := text.as_py()) else np.empty(0, np.int64)
                rows.append(ord_.as_py())
                each.append(grams)
                size += len(grams)
                if len(rows) >= BATCH or size >= BATCH_GRAMS:
                    yield rows, each
                    rows, each, size = [], [], 0
        if rows:
            yield rows, each

    for rows, each in full():
        row = np.repeat(np.array(rows, np.int64), [len(g) for g in each])
        gram = np.concatenate(each)
        if not len(gram):
            continue
        order = np.lexsort((row, gram))
        gram, row = gram[order], row[order]
        segment, low = row >> SEGMENT_BITS, row & ((1 << SEGMENT_BITS) - 1)
        new = np.ones(len(gram), bool)
        new[1:] = (np.diff(gram) != 0) | (np.diff(segment) != 0)
        first = np.flatnonzero(new)
        held = [np.unique(low[a:b]) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(gram)])]
        yield pa.record_batch([pa.array(gram[first]), pa.array(segment[first]), pa.array([len(h) for h in held], pa.int32()), pa.array([to_container(h) for h in held], pa.binary())], ["gram", "segment", "n", "held"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted partial containers to one for each gram and segment."""
    key, parts, out = None, [], []

    def close() -> None:
        if key is not None:
            held = parts[0] if len(parts) == 1 else to_container(np.unique(np.concatenate([from_container(p) for p in parts])))
            out.append((*key, (len(held) // 2) if len(held) % 2 == 0 else len(from_container(held)), held))

    def batch() -> pa.RecordBatch:
        g, s, b, n, h = zip(*out)
        return pa.record_batch([pa.array(g, pa.int64()), pa.array(s, pa.int64()), pa.array(b, pa.int32()), pa.array(n, pa.int32()), pa.array(h, pa.binary())], ["gram", "segment", "bucket", "n", "held"])

    for rows in (b.slice(at, HELD) for b in batches for at in range(0, b.num_rows, HELD)):
        for k, held in zip(zip(*(rows.column(c).to_pylist() for c in ("gram", "segment", "bucket"))), rows.column("held").to_pylist()):
            if k != key:
                close()
                key, parts = k, []
            parts.append(held)
        if len(out) >= HELD:
            yield batch()
            out.clear()
    close()
    if out:
        yield batch()


def _intersected(chosen: Sequence[int]):
    """The containers of one segment to the ordinals that all grams hold."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = None
        if set(rows["gram"]) >= set(chosen):
            for held in rows.sort_values("n")["held"]:
                low = from_container(held)
                found = low if found is None else np.intersect1d(found, low, assume_unique=True)
                if not len(found):
                    break
        low = np.empty(0, np.int64) if found is None else found.astype(np.int64)
        return pd.DataFrame({"ord": (int(rows["segment"].iloc[0]) << SEGMENT_BITS) + low})

    return run


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for segment, held in zip(batch.column("segment").to_pylist(), batch.column("held").to_pylist()):
            yield pa.record_batch([pa.array((segment << SEGMENT_BITS) + from_container(held).astype(np.int64))], ["ord"])


class GramIndex:
    """An index in a folder: `rows` (all columns and the searched text `hay`)
    and `postings`."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.buckets, kind = spark.read.parquet(f"{folder}/settings").first()
        self.rows = spark.read.schema(StructType.fromJson(json.loads(kind))).parquet(f"{folder}/rows")
        self.postings = spark.read.schema(f"{_POSTING}, bucket int").parquet(f"{folder}/postings")

    @classmethod
    def build(cls, rows: DataFrame, hay: Column, folder: str, buckets: int = 16) -> GramIndex:
        """Write the index of rows, which have a column `ord`, over a text."""
        spark = rows.sparkSession
        span = F.shiftright(F.col("ord"), FOLDER_BITS)
        known = F.when(F.col("ord").isNull(), F.raise_error(F.lit("a row without an ordinal"))).otherwise(F.col("ord"))
        wide = rows.withColumn("ord", known).withColumns({"hay": hay, "span": span})
        wide.write.partitionBy("span").parquet(f"{folder}/rows")
        spark.createDataFrame([(buckets, wide.schema.json())], "buckets int, kind string").coalesce(1).write.parquet(f"{folder}/settings")
        texts = spark.read.schema(wide.schema).parquet(f"{folder}/rows").select(F.col("ord").cast("long").alias("ord"), "hay")
        partial = texts.mapInArrow(_partial, _POSTING).withColumn("bucket", F.pmod(F.hash("gram"), F.lit(buckets)))
        dealt = partial.repartition(F.col("bucket"), F.shiftright("segment", FILE_BITS)).sortWithinPartitions("bucket", "gram", "segment")
        made = dealt.select("gram", "segment", "bucket", "n", "held").mapInArrow(_merged, "gram long, segment long, bucket int, n int, held binary")
        made.write.partitionBy("bucket").parquet(f"{folder}/postings")
        return cls(spark, folder)

    def read(self, grams: Sequence[int]) -> DataFrame:
        """The containers of some grams: only their buckets are listed, and
        only row groups that can hold them are read."""
        if not grams:
            return self.postings.limit(0)
        keys = self.spark.createDataFrame([(g,) for g in grams], "gram long").select(F.pmod(F.hash("gram"), F.lit(self.buckets)))
        buckets = sorted({r[0] for r in keys.collect()})
        return self.postings.where(F.col("bucket").isin(buckets) & F.col("gram").isin(list(grams)))

    def counts(self, grams: Sequence[int]) -> dict[int, int]:
        """Rows that hold each gram; their containers aren't read."""
        return {r.gram: r.n for r in self.read(grams).groupBy("gram").agg(F.sum("n").alias("n")).collect()}

    def chosen(self, terms: Sequence[str]) -> list[int] | None:
        """The rarest grams of the terms, at least one of each term as far as
        MOST allows; None if a gram occurs nowhere, so nothing matches."""
        each = [g for t in terms if (g := grams_of(t))]
        every = sorted({g for gs in each for g in gs})
        n = self.counts(every)
        if len(n) < len(every):
            return None
        first = sorted({min(gs, key=lambda g: (n[g], g)) for gs in each}, key=lambda g: (n[g], g))
        rest = sorted(set(every) - set(first), key=lambda g: (n[g], g))
        return [*first, *rest][:MOST]

    def candidates(self, terms: Sequence[str]) -> DataFrame:
        """A column `ord` of the rows that may hold all terms, which are texts
        of at least one character."""
        long = [t for t in terms if len(t) >= GRAM]
        if not terms:
            return self.spark.createDataFrame([], "ord long")
        if not long:  # the rows of one short term: the longest, as the narrowest range
            low, high = range_of(max(terms, key=len))
            rows = self.postings.where((F.col("gram") >= low) & (F.col("gram") < high))
            return rows.select("segment", "held").mapInArrow(_united, "ord long").distinct()
        grams = self.chosen(long)
        if grams is None:
            return self.spark.createDataFrame([], "ord long")
        rows = self.read(grams).select("gram", "segment", "n", "held")
        return rows.groupBy("segment").applyInPandas(_intersected(grams), "ord long")

    def holding(self, terms: Sequence[str]) -> DataFrame:
        """The rows whose text holds every term, with `hay`."""
        found = self.candidates(terms).withColumn("span", F.shiftright("ord", FOLDER_BITS).cast(self.rows.schema["span"].dataType))
        rows = self.rows.join(found, ["span", "ord"], "left_semi").drop("span")
        for term in terms:
            rows = rows.where(F.contains("hay", F.lit(term)))
        return rows
