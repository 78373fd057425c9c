"""An incremental library: batches of a stream, upserted into key ranges.

The library at a target is a set of key ranges, each in a folder of its own,
and one manifest for each batch that names the folders in force. A batch reads
and rewrites the ranges that its keys lie in and no other; a range that grows
beyond `range_rows` is divided at its own quantiles. A manifest is one small file
with a new name, put in place by a rename: readers take the newest one, so they
find the state before a batch or after it, never none and never half of one. A
batch whose manifest is there is done, so a restarted stream repeats nothing
(a library belongs to one stream and its checkpoint).

With each batch goes its change set: for every key of the batch whether it was
added, changed or is the same (an older or equal record included).

Scale: state is read and written by touched ranges; the driver holds one bound
and one path for each range. Folders that no manifest of the last `keep` names
are deleted, with the change sets kept.

Defined cases: of a key's records the one greatest by the order column counts,
then by its other values. Records without key are an error. An empty batch
writes a manifest and no folder. A library without any batch is an error to read.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.folds import numbered
from ..sources.shared import stored
from ..sources.sinks import write_text

CHANGES = ("added", "changed", "same")


class Library:
    def __init__(self, spark: SparkSession, target: str, key: str, order: str, range_rows: int = 1_000_000, keep: int = 3):
        self.spark, self.target, self.key, self.order = spark, target.rstrip("/"), key, order
        self.range_rows, self.keep = range_rows, keep

    # -- manifests ---------------------------------------------------------

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.target).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifests(self) -> dict[int, str]:
        """The manifest of each batch."""
        path, fs = self._files()
        found = fs.globStatus(path(f"{self.target}/manifests/batch-*.json")) or []
        return {int(s.getPath().getName()[6:-5]): s.getPath().toString() for s in found}

    def manifest(self, batch: int | None = None) -> dict:
        """The newest manifest, or that of a batch."""
        every = self.manifests()
        if not every:
            raise FileNotFoundError(f"no library at {self.target}")
        path, fs = self._files()
        source = fs.open(path(every[max(every) if batch is None else batch]))
        try:
            return json.loads(bytes(source.readAllBytes()))
        finally:
            source.close()

    # -- reading -----------------------------------------------------------

    def read(self, ranges: set[int] | list[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """The library's rows, or those of some ranges."""
        state = manifest or self.manifest()
        schema = StructType.fromJson(state["schema"])
        paths = [f"{self.target}/{p}" for i, p in enumerate(state["paths"]) if p and (ranges is None or i in ranges)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def changes(self) -> DataFrame:
        """The change sets of all batches: batch, key, change."""
        kind = StructType.fromJson(self.manifest()["schema"])[self.key].dataType.simpleString()
        return self.spark.read.schema(f"`{self.key}` {kind}, change string, batch long").parquet(f"{self.target}/changes")

    # -- writing -----------------------------------------------------------

    def _range(self, bounds: list) -> Column:
        """The range of a key: ranges begin at their bounds, the first one below
        all of them. The bounds, however many, are searched by halves."""
        if not bounds:
            return F.lit(0)

        @F.arrow_udf("int")
        def place(keys: pa.Array) -> pa.Array:
            return pa.array([0 if k is None else bisect_right(bounds, k) for k in keys.to_pylist()], pa.int32())

        return place(F.col(self.key))

    def _newest(self, rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c != self.key]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*others), F.struct(self.order, *others)).alias("row_")).select(self.key, "row_.*").select(*rows.columns)

    def upsert(self, batch: DataFrame, number: int) -> bool:
        """Take in a batch; False if that has been done before."""
        every = self.manifests()
        if number in every:
            return False
        old = self.manifest() if every else {"bounds": [], "paths": [None], "schema": json.loads(batch.schema.json())}
        known = F.when(F.col(self.key).isNull(), F.raise_error(F.lit("a record without key"))).otherwise(F.col(self.key))
        new = stored(self._newest(batch.withColumn(self.key, known)), "library-batch")
        touched = {r[0] for r in new.select(self._range(old["bounds"]).alias("r")).distinct().collect()}
        state = self.read(touched, old).select(*new.columns)
        self._compare(new, state).write.mode("overwrite").parquet(f"{self.target}/changes/batch={number}")
        bounds, paths = list(old["bounds"]), list(old["paths"])
        if touched:
            merged = stored(self._newest(state.unionByName(new)), "library-merged")
            places = self._divided(merged, bounds, touched)
            folder = f"data-{uuid.uuid4().hex}"
            merged.withColumn("range", self._range(places)).repartition("range").write.partitionBy("range").parquet(f"{self.target}/{folder}")
            filled = {r[0] for r in merged.select(self._range(places)).distinct().collect()}
            # untouched ranges keep their folders; the bounds of divided ones are new
            before = {b: i + 1 for i, b in enumerate(bounds)}
            held, now = 0, []
            for i, b in enumerate([None, *places]):
                held = before.get(b, held)  # the old range that this one is or was cut from
                now.append(f"{folder}/range={i}" if i in filled and held in touched else (None if held in touched else paths[held]))
            bounds, paths = places, now
        write_text(self.spark, f"{self.target}/manifests/batch-{number}.json", json.dumps({"bounds": bounds, "paths": paths, "schema": old["schema"]}))
        self._clean()
        return True

    def _compare(self, new: DataFrame, state: DataFrame) -> DataFrame:
        others = [c for c in new.columns if c != self.key]
        before = state.select(self.key, F.struct(*others).alias("before_"))
        after = new.select(self.key, F.struct(*others).alias("after_"), F.col(self.order).alias("order_")).join(before, self.key, "left")
        stale = (F.col("before_").isNotNull()) & (F.struct("order_", "after_") <= F.struct(F.col(f"before_.{self.order}"), "before_"))
        change = F.when(F.col("before_").isNull(), CHANGES[0]).when(stale, CHANGES[2]).otherwise(CHANGES[1])
        return after.select(self.key, change.alias("change"))

    def _divided(self, merged: DataFrame, bounds: list, touched: set[int]) -> list:
        """The bounds, with more of them inside ranges that have grown."""
        slot = merged.select(self.key, self._range(bounds).alias("slot"))
        large = [r.slot for r in slot.groupBy("slot").count().where(F.col("count") > self.range_rows).collect()]
        if not large:
            return bounds
        ranked = numbered(slot.where(F.col("slot").isin(large)), ["slot"], [self.key], "nth")
        half = max(1, self.range_rows // 2)  # rooms for growth
        cuts = [r[0] for r in ranked.where((F.col("nth") > 0) & (F.col("nth") % half == 0)).select(self.key).collect()]
        return sorted({*bounds, *cuts})

    def _clean(self) -> None:
        """Delete manifests but the last ones, and folders that none names."""
        path, fs = self._files()
        every = self.manifests()
        for number in sorted(every)[: -self.keep]:
            fs.delete(path(every.pop(number)), False)
        named = {p.split("/")[0] for number in every for p in self.manifest(number)["paths"] if p}
        for status in fs.globStatus(path(f"{self.target}/data-*")) or []:
            if status.getPath().getName() not in named:
                fs.delete(status.getPath(), True)

    def each_batch(self) -> Callable[[DataFrame, int], None]:
        """A function for foreachBatch."""

        def write(batch: DataFrame, number: int) -> None:
            self.upsert(batch, number)

        return write


def run_stream(stream: DataFrame, library: Library, checkpoint: str) -> None:
    """Take in all that the stream has; started again, it goes on behind its
    last batch."""
    query = stream.writeStream.foreachBatch(library.each_batch()).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
