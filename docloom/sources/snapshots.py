"""Published tables as snapshots that readers never find missing or half there.

A snapshot is a folder that is written once and never changed, with a list of
its files (path, size, SHA-256) beside them. What is in force is told by
pointers: small numbered files, each put in place by one rename; the highest
number counts. A run that is cut off leaves a folder that no pointer names.

A pointer holds the digest of its snapshot's file list. Reading compares the
list with the pointer and the sizes of the files with the list, and on demand
their contents; a snapshot that differs is refused, never shown. `recover` goes
back to the newest snapshot that is whole and says so by a new pointer; where
none is, it raises and changes nothing.

Scale: files are hashed by Spark where they lie, one file a row (bounded by
`rows_per_file`); the list is a table and its digest a sorted fold. Two writers
at a time are told by the rename: the second one fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.folds import sorted_digest


class Corrupt(ValueError):
    """A snapshot that is not as its pointer says."""


class Snapshots:
    def __init__(self, spark: SparkSession, target: str, keep: int = 3, rows_per_file: int = 5_000_000):
        self.spark, self.target, self.keep, self.rows_per_file = spark, target.rstrip("/"), keep, rows_per_file

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.target).getFileSystem(self.spark._jsc.hadoopConfiguration())

    # -- pointers ----------------------------------------------------------

    def pointers(self) -> dict[int, dict]:
        """All pointers by number. A file that is no pointer is Corrupt."""
        path, fs = self._fs()
        out = {}
        for status in fs.globStatus(path(f"{self.target}/pointer-*.json")) or []:
            source = fs.open(status.getPath())
            try:
                out[int(status.getPath().getName()[8:-5])] = json.loads(bytes(source.readAllBytes()))
            except ValueError:
                raise Corrupt(f"not a pointer: {status.getPath().getName()}") from None
            finally:
                source.close()
        return out

    def _point(self, number: int, pointer: dict) -> None:
        path, fs = self._fs()
        name, new = f"{self.target}/pointer-{number}.json", f"{self.target}/new-{uuid.uuid4().hex}"
        out = fs.create(path(new), False)
        out.write(bytearray(json.dumps(pointer).encode()))
        out.close()
        # renames onto a file differ by store, so a name that is there is told first
        if fs.exists(path(name)) or not fs.rename(path(new), path(name)):
            fs.delete(path(new), False)
            raise OSError(f"another run has published {name}")

    # -- files -------------------------------------------------------------

    def _found(self, folder: str, contents: bool) -> DataFrame:
        """The data files of a snapshot as they lie there."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
        name = F.substring_index("path", "/", -1).alias("name")
        return files.select(name, F.col("length").alias("size"), *([F.sha2("content", 256).alias("sha256")] if contents else []))

    def _digest(self, files: DataFrame) -> str:
        line = F.concat_ws("\t", "name", F.col("size").cast("string"), "sha256")
        found = sorted_digest(files.withColumn("all", F.lit(1)), ["all"], ["name"], line, "\n").first()
        return found.digest if found else ""

    def problems(self, pointer: dict, contents: bool = False) -> list[str]:
        """How a snapshot differs from its pointer: a few findings, or none."""
        path, fs = self._fs()
        folder = f"{self.target}/{pointer['snapshot']}"
        if not fs.exists(path(f"{folder}/_files")):
            return ["no list of files"]
        listed = self.spark.read.schema("name string, size long, sha256 string").parquet(f"{folder}/_files")
        if self._digest(listed) != pointer["digest"]:
            return ["another list of files"]
        found = self._found(folder, contents).withColumnRenamed("size", "size_").withColumn("sha_", F.col("sha256") if contents else F.lit(None).cast("string")).drop("sha256")
        both = listed.join(found, "name", "full")
        wrong = F.when(F.col("size_").isNull(), "missing").when(F.col("size").isNull(), "unknown").when(F.col("size") != F.col("size_"), "size").when(F.col("sha_") != F.col("sha256"), "content")
        bad = both.select("name", wrong.alias("problem")).where("problem is not null").orderBy("name").limit(5).collect()
        return [f"{r.name}: {r.problem}" for r in bad]

    # -- publishing and reading --------------------------------------------

    def publish(self, df: DataFrame, validate: Callable[[DataFrame], str | None] | None = None) -> int:
        """Write a snapshot, check it and put it in force: its number. What
        validate(rows read back) says, or a failure on the way, leaves the old
        state in force."""
        before = self.pointers()
        folder = f"snapshot-{uuid.uuid4().hex}"
        place = f"{self.target}/{folder}"
        try:
            df.write.option("maxRecordsPerFile", self.rows_per_file).parquet(place)
            problem = validate(self.spark.read.schema(df.schema).parquet(place)) if validate else None
            if problem:
                raise ValueError(problem)
            files = self._found(place, True)
            files.write.parquet(f"{place}/_files")
            listed = self.spark.read.schema(files.schema).parquet(f"{place}/_files")
            number = max(before, default=0) + 1
            self._point(number, {"snapshot": folder, "digest": self._digest(listed), "schema": df.schema.json()})
        except BaseException:
            path, fs = self._fs()
            fs.delete(path(place), True)
            raise
        self._clean()
        return number

    def read(self, contents: bool = False) -> DataFrame:
        """The rows in force. Raises Corrupt if the snapshot is not whole."""
        every = self.pointers()
        if not every:
            raise FileNotFoundError(f"nothing is published at {self.target}")
        pointer = every[max(every)]
        found = self.problems(pointer, contents)
        if found:
            raise Corrupt("; ".join(found))
        return self.spark.read.schema(StructType.fromJson(json.loads(pointer["schema"]))).parquet(f"{self.target}/{pointer['snapshot']}")

    def recover(self) -> int:
        """The number in force, after going back, by a new pointer, to the newest
        snapshot whose contents are whole. Raises Corrupt if there is none."""
        every = self.pointers()
        for number in sorted(every, reverse=True):
            if not self.problems(every[number], contents=True):
                if number == max(every):
                    return number
                self._point(max(every) + 1, every[number])
                return max(every) + 1
        raise Corrupt(f"no whole snapshot at {self.target}")

    def _clean(self) -> None:
        """Delete pointers but the last ones, and the snapshots that only those
        named. Folders that no pointer ever named may belong to a run that is
        under way and stay."""
        path, fs = self._fs()
        every = self.pointers()
        old = [every.pop(n) | {"number": n} for n in sorted(every)[: -self.keep]]
        held = {p["snapshot"] for p in every.values()}
        for p in old:
            fs.delete(path(f"{self.target}/pointer-{p['number']}.json"), False)
            if p["snapshot"] not in held:
                fs.delete(path(f"{self.target}/{p['snapshot']}"), True)
