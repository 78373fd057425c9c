"""ZIP archives of guides: listing with the members' policy, verified export.

An archive is one row with its bytes; a guide's files must fit in a task."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Every member has the same time, so that equal files give equal archives.
TIME = (1980, 1, 1, 0, 0, 0)
MEMBERS = "name string, size long, sha256 string, problem string"


def _problem(info: zipfile.ZipInfo, seen: set[str], limit: int) -> str | None:
    """Why a member is refused (null: it is not)."""
    kind = info.external_attr >> 28 if info.create_system == 3 else 0
    parts = info.filename.rstrip("/").split("/")
    if info.flag_bits & 0x2041:
        return "encrypted"
    if info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        return "compression"
    if kind == 0xA:
        return "link"
    if info.filename.startswith(("/", "\\")) or "\\" in info.filename or {"", ".", ".."} & set(parts) or ":" in parts[0]:
        return "name"
    if info.filename.casefold() in seen:
        return "repeated name"
    if info.file_size > limit:
        return "size"
    return "directory with content" if info.is_dir() and info.file_size else None


def members(archives: DataFrame, key: str, body: str = "body", limit: int = 1 << 30) -> DataFrame:
    """The members of each archive row: key, name, size, sha256 and problem.
    Only members without a problem are unpacked and hashed; a body that is no
    archive gives one row without a name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, data in zip(batch["k"], batch["b"]):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(data or b""))
                except zipfile.BadZipFile:
                    out.append((k, None, None, None, "no archive"))
                    continue
                seen: set[str] = set()
                for info in archive.infolist():
                    problem, sha = _problem(info, seen, limit), None
                    seen.add(info.filename.casefold())
                    if problem is None and not info.is_dir():
                        try:
                            sha = hashlib.sha256(archive.read(info)).hexdigest()
                        except (zipfile.BadZipFile, OSError):
                            problem = "content"
                    out.append((k, info.filename, info.file_size, sha, problem))
            yield pd.DataFrame(out, columns=["k", "name", "size", "sha256", "problem"])

    kind = archives.schema[key].dataType.simpleString()
    return archives.select(F.col(key).alias("k"), F.col(body).alias("b")).mapInPandas(run, f"k {kind}, {MEMBERS}").withColumnRenamed("k", key)


def export(files: DataFrame, key: str, name: str = "name", body: str = "body") -> DataFrame:
    """One archive row (key, body) of each key's files, in the order of names."""
    kind = files.schema[key].dataType.simpleString()

    def pack(table: pa.Table) -> pa.Table:
        out = io.BytesIO()
        rows = sorted(zip(table.column("name").to_pylist(), table.column("body").to_pylist()))
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for n, data in rows:
                info = zipfile.ZipInfo(n, TIME)
                info.compress_type = zipfile.ZIP_DEFLATED
                archive.writestr(info, data or b"")
        return pa.table({"k": table.column("k").slice(0, 1), "body": pa.array([out.getvalue()], pa.binary())})

    rows = files.select(F.col(key).alias("k"), F.col(name).alias("name"), F.col(body).cast("binary").alias("body"))
    return rows.groupBy("k").applyInArrow(pack, f"k {kind}, body binary").withColumnRenamed("k", key)


def verified_export(files: DataFrame, key: str, name: str = "name", body: str = "body") -> DataFrame:
    """key, body and whether the archive, read back, holds exactly the files:
    names, sizes and hashes, and no member with a problem."""
    made = export(files, key, name, body)
    data = F.coalesce(F.col(body).cast("binary"), F.lit(b""))
    wanted = files.select(F.col(key), F.col(name).alias("name"), F.octet_length(data).cast("long").alias("size"), F.sha2(data, 256).alias("sha256"))
    found = members(made, key)
    met = wanted.withColumn("w_", F.lit(1)).join(found.withColumn("f_", F.lit(1)), [key, "name", "size", "sha256"], "full")
    wrong = met.where("w_ is null or f_ is null or problem is not null").select(key).distinct().withColumn("bad_", F.lit(True))
    return made.join(wrong, key, "left").select(key, "body", F.col("bad_").isNull().alias("verified"))
