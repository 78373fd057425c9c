"""Sinks: search indexes, manifests, staged publication."""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.folds import framed_parts, sorted_parts

#: Control and format characters and line and paragraph separators from DEL on.
CONTROLS = re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x7F, sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Cc", "Cf", "Zl", "Zp")) + "]")


def guide_index(pages: DataFrame) -> DataFrame:
    """Search records in page order: title, url, text, source_url."""
    return pages.select("ord", "title", "url", "text", "source_url")


def manifest_json(files: DataFrame, by: str) -> DataFrame:
    """One JSON document per guide with its files and status."""
    parts = F.sort_array(F.collect_list(F.struct("path", "sha256", "size")))
    return files.groupBy(by).agg(F.to_json(F.struct(F.count("*").alias("count"), F.sum("size").alias("bytes"), parts.alias("files"))).alias("manifest"))


def manifest_parts(files: DataFrame, by: str) -> DataFrame:
    """manifest_json as rows (guide, part, text): in the order of part, the
    texts of a guide are its document. No guide is in one cell."""
    head = files.groupBy(by).agg(F.to_json(F.struct(F.count("*").alias("count"), F.sum("size").alias("bytes"))).alias("h"))
    head = head.select(by, F.concat(F.expr("left(h, length(h) - 1)"), F.lit(',"files":[')).alias("head"))
    # digests in lower-case hex are sorted and stored as bytes, half as many
    binary = F.unhex("sha256")
    narrow = files.select(by, "path", F.when(F.lower(F.hex(binary)) == F.col("sha256"), binary).alias("digest_"), "sha256", "size")
    narrow = narrow.withColumn("sha256", F.when(F.col("digest_").isNull(), F.col("sha256")))
    sha256 = F.coalesce("sha256", F.lower(F.hex("digest_")))
    parts = sorted_parts(narrow, [by], ["path", sha256, "size"], F.to_json(F.struct("path", sha256.alias("sha256"), "size")), ",")
    return framed_parts(parts, [by], head, "]}", ",")


@F.pandas_udf(StringType())
def _escaped(texts: pd.Series) -> pd.Series:
    def one(m: re.Match) -> str:
        code = m[0].encode("utf-16-be")
        return "".join(f"\\u{code[i : i + 2].hex()}" for i in range(0, len(code), 2))

    return texts.map(lambda t: None if t is None else CONTROLS.sub(one, t))


def escaped_json(value: Column) -> Column:
    """JSON text in which control and format characters, which a terminal
    would obey, are written as escapes."""
    return _escaped(F.to_json(value))


def _files(spark: SparkSession, target: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(target).getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, target: str, text: str) -> None:
    """Write a new file, then rename it. A target that is there goes first, so
    there is none for a moment; with a new name the rename is one step."""
    path, fs = _files(spark, target)
    new = f"{target}.{uuid.uuid4().hex}"
    out = fs.create(path(new), False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(path(target)):
        fs.delete(path(target), False)
    if not fs.rename(path(new), path(target)):
        raise OSError(f"cannot write {target}")


def publish(df: DataFrame, target: str, validate=None) -> str:
    """Write to a staging folder, validate, then rename. Between the two renames
    there is no target; where readers must always find one, use `snapshots`. A
    journal beside the target names the folders until
    all is done, so that `recover` can finish or undo a run that was cut off."""
    spark = df.sparkSession
    path, fs = _files(spark, target)
    parent = os.path.dirname(target.rstrip("/"))
    run = uuid.uuid4().hex
    stage, journal = f"{parent}/_staging-{run}", f"{parent}/_journal-{run}.json"
    names = {"target": target, "stage": stage, "old": f"{stage}-old"}
    write_text(spark, journal, json.dumps(names))
    try:
        df.write.parquet(stage)
        problem = validate(spark.read.parquet(stage)) if validate is not None else None
        if problem:
            raise ValueError(problem)
        if fs.exists(path(target)) and not fs.rename(path(target), path(names["old"])):
            raise OSError(f"cannot set {target} aside")
        if not fs.rename(path(stage), path(target)):
            raise OSError(f"cannot publish {target}")
    finally:
        _settle(spark, journal, names)
    return target


def _settle(spark: SparkSession, journal: str, names: dict[str, str]) -> None:
    """Put the old state back if no new one has taken its place, and delete
    what is left over."""
    path, fs = _files(spark, journal)
    if not fs.exists(path(names["target"])) and fs.exists(path(names["old"])) and not fs.rename(path(names["old"]), path(names["target"])):
        raise OSError(f"cannot restore {names['target']}")
    for name in ("stage", "old"):
        fs.delete(path(names[name]), True)
    fs.delete(path(journal), False)


def recover(spark: SparkSession, parent: str) -> list[str]:
    """Settle every publication of the folder that was cut off; the targets."""
    path, fs = _files(spark, parent)
    found = fs.globStatus(path(f"{parent}/_journal-*.json"))
    out = []
    for status in found or []:
        journal = status.getPath().toString()
        source = fs.open(status.getPath())  # Spark's readers pass over names with an underscore
        names = json.loads(bytes(source.readAllBytes()))
        source.close()
        _settle(spark, journal, names)
        out.append(names["target"])
    return out


def write_document(sections: DataFrame, target: str, order: str = "ord", html: str = "html") -> None:
    """The combined document's sections as text files whose names and rows are
    in reading order: a range sort, no section meets another in one task."""
    sections.orderBy(order).select(html).write.text(target, lineSep="\n")
