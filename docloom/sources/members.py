"""Folders and archives as tables of their files.

`FolderSource` is a Python data source whose partitions are subtrees: the driver
opens the upper levels only until there are enough of them. `zip_members` reads
the central directories, one archive a task; `read_members` then streams each
member from its own offset, so that one archive's members are read by many
tasks. A tar.gz has no directory and is one stream, read by one task for each
archive. No archive, and unless asked for no member, lies in a cell.

What the policy refuses is a row with its problem and is never unpacked: names
that are not canonical, links, special files, encrypted or oddly packed
members, sizes beyond the limits, and names that collide (repeated, equal but
for case or composition, a file where others need a folder).

Archives must lie where executors can open files: a mounted folder. Writers name
each attempt's file anew, so a task that is tried again overwrites nothing.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import os
import stat
import tarfile
import unicodedata
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shared import stored

#: Every member has the same time, so that equal files give equal archives.
TIME = (1980, 1, 1, 0, 0, 0)
#: Bytes that are read, unpacked and hashed together.
BLOCK = 1 << 18
#: Subtrees that a folder listing aims at.
SUBTREES = 64


@dataclass(frozen=True)
class Limits:
    members: int = 100_000
    path_bytes: int = 4 << 10
    file_bytes: int = 4 << 30
    total_bytes: int = 8 << 30
    trailing_bytes: int = 1 << 20  # behind the last member of a tar.gz


# -- folders ---------------------------------------------------------------


def _entry(root: str, entry: os.DirEntry) -> tuple[str, int | None, str | None]:
    mode = entry.stat(follow_symlinks=False)
    name = os.path.relpath(entry.path, root)
    if stat.S_ISREG(mode.st_mode):
        return name, mode.st_size, None
    return name, None, "link" if stat.S_ISLNK(mode.st_mode) else "special file"


@dataclass
class _Subtree(InputPartition):
    folder: str
    deep: bool


class _FolderReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[_Subtree]:
        """Open folders, level by level, until there are enough subtrees; an
        opened folder's own files are a partition too."""
        opened, level = [], [self.root]
        while level and len(level) < SUBTREES:
            below = [e.path for f in level for e in os.scandir(f) if e.is_dir(follow_symlinks=False)]
            opened += level
            level = below
        return [_Subtree(f, False) for f in opened] + [_Subtree(f, True) for f in level]

    def read(self, partition: _Subtree) -> Iterator[tuple]:
        open_ = [partition.folder]
        while open_:
            for entry in sorted(os.scandir(open_.pop()), key=lambda e: e.name):
                if not entry.is_dir(follow_symlinks=False):
                    yield _entry(self.root, entry)
                elif partition.deep:
                    open_.append(entry.path)


class FolderSource(DataSource):
    """spark.read.format("folder").load(path): the files below a folder, with
    their size; links and special files are rows with a problem. Links are never
    followed."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return "path string, size long, problem string"

    def reader(self, schema) -> _FolderReader:
        return _FolderReader(_local(self.options["path"]))


def list_folder(spark, path: str) -> DataFrame:
    spark.dataSource.register(FolderSource)
    return spark.read.format("folder").load(path)


def _local(path: str) -> str:
    parts = urlsplit(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"not a mounted folder: {path}")
    return unquote(parts.path) if parts.scheme else path


# -- policy ----------------------------------------------------------------


def name_problem(name: str, directory: bool, limits: Limits = Limits()) -> str | None:
    """Whether a member's name is canonical: relative, without empty, dot or
    parent parts, backslashes, control or format characters."""
    plain = name.removesuffix("/") if directory else name
    wrong = (
        not name
        or len(name.encode("utf-8", "surrogatepass")) > limits.path_bytes
        or name.startswith("/")
        or "\\" in name
        or any(unicodedata.category(c) in ("Cc", "Cf", "Cs") for c in name)
        or {"", ".", ".."} & set(plain.split("/"))
    )
    return "name" if wrong else None


def _judged(members: DataFrame, key: str, limits: Limits) -> DataFrame:
    """members (key, ord, name, folded, directory, size, problem) with the
    problems that only a whole archive shows. They are stored first, as they
    are read several times. A name's ancestors and their folded forms meet in
    aggregates, so no archive is in one cell."""
    members = stored(members, "members")
    parts = lambda c: F.split(F.regexp_replace(c, "/$", ""), "/")
    upto = lambda c: F.array_join(F.slice(c, F.lit(1), F.col("n")), "/")
    good = members.where("problem is null")
    paths = good.select(key, "ord", parts("name").alias("parts"), parts("folded").alias("folds"), "directory")
    ups = paths.select(key, "ord", "directory", "parts", "folds", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("n"))
    ups = ups.select(key, "ord", upto("parts").alias("at"), upto("folds").alias("folded"), (F.col("n") == F.size("parts")).alias("own"), "directory")
    spelt = ups.groupBy(key, "folded").agg(
        (F.min("at") != F.max("at")).alias("fold"),
        (F.count_if("own") > 1).alias("twice"),
        (F.bool_or(F.col("own") & ~F.col("directory")) & F.bool_or(~F.col("own") | F.col("directory"))).alias("prefix"),
    )
    bad = spelt.where("fold or twice or prefix").withColumn("p", F.when(F.col("fold"), "folded name").when(F.col("twice"), "repeated name").otherwise("file and folder"))
    hit = ups.join(bad.select(key, "folded", "p"), [key, "folded"]).groupBy(key, "ord").agg(F.min("p").alias("p"))
    whole = good.groupBy(key).agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    over = F.when(F.col("n") > limits.members, "too many members").when(F.col("total") > limits.total_bytes, "total size")
    large = whole.select(key, over.alias("archive_p")).where("archive_p is not null")
    out = members.drop("folded").join(hit, [key, "ord"], "left").join(large, key, "left")
    return out.withColumn("problem", F.coalesce("problem", "p", "archive_p")).drop("p", "archive_p")


def _folded(name: str, problem: str | None) -> str | None:
    """The form in which names collide. No composition or case folding makes or
    takes a slash, so a prefix of it is the form of the name's prefix."""
    return None if problem else unicodedata.normalize("NFC", name).casefold()


# -- ZIP -------------------------------------------------------------------

_ZIP = "ord int, name string, folded string, directory boolean, size long, problem string, at long, packed long, method int, crc long"


def _zip_problem(info: zipfile.ZipInfo, limits: Limits) -> str | None:
    kind = stat.S_IFMT(info.external_attr >> 16) if info.create_system == 3 else 0
    if info.flag_bits & 0x2041:
        return "encrypted"
    if info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        return "compression"
    if kind == stat.S_IFLNK:
        return "link"
    if kind not in (0, stat.S_IFREG, stat.S_IFDIR) or (kind and (kind == stat.S_IFDIR) != info.is_dir()):
        return "special file"
    if info.external_attr >> 16 & 0o7000 and info.create_system == 3:
        return "permissions"
    if info.is_dir() and info.file_size:
        return "directory with content"
    return name_problem(info.filename, info.is_dir(), limits) or ("size" if info.file_size > limits.file_bytes else None)


def _zip_rows(infos: list[zipfile.ZipInfo] | None, limits: Limits) -> Iterator[tuple]:
    if infos is None:
        yield 0, None, None, False, None, "no archive", None, None, None, None
    for n, m in enumerate(infos or ()):
        problem = _zip_problem(m, limits)
        yield n, m.filename, _folded(m.filename, problem), m.is_dir(), m.file_size, problem, m.header_offset, m.compress_size, m.compress_type, m.CRC


def zip_members(archives: DataFrame, key: str, path: str = "path", limits: Limits = Limits()) -> DataFrame:
    """The members of each archive file, from its central directory: the key,
    path, ord, name, directory, size, problem and where the member lies. A file
    that is no archive is one row without a name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, file in enumerate(batch.column(1).to_pylist()):
                try:
                    with zipfile.ZipFile(_local(file)) as z:
                        infos = z.infolist()
                except (zipfile.BadZipFile, OSError):
                    infos = None
                for some in batched(_zip_rows(infos, limits), 4096):
                    same = [pa.array([c[i].as_py()] * len(some), c.type) for c in batch.columns]
                    yield pa.record_batch([*same, *(pa.array(c, t) for c, t in zip(zip(*some), types))], [*batch.schema.names, *names])

    names, types = [*_ZIP_NAMES[:2], "folded", *_ZIP_NAMES[2:]], [*_ZIP_TYPES[:2], pa.string(), *_ZIP_TYPES[2:]]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in archives.select(key, path).schema)
    return _judged(archives.select(key, path).mapInArrow(run, f"{kinds}, {_ZIP}"), key, limits)


_ZIP_NAMES = ["ord", "name", "directory", "size", "problem", "at", "packed", "method", "crc"]
_ZIP_TYPES = [pa.int32(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]


def _streamed(source, packed: int, method: int, size: int) -> Iterator[bytes]:
    """A member's bytes, block by block; ValueError if they are not as said."""
    unpack, made = zlib.decompressobj(-15), 0
    while packed > 0 or (method == zipfile.ZIP_DEFLATED and unpack.unconsumed_tail):
        if method == zipfile.ZIP_DEFLATED and unpack.unconsumed_tail:
            data = unpack.decompress(unpack.unconsumed_tail, BLOCK)
        else:
            data = source.read(min(BLOCK, packed))
            if not data:
                raise ValueError("cut off")
            packed -= len(data)
            if method == zipfile.ZIP_DEFLATED:
                data = unpack.decompress(data, BLOCK)
        made += len(data)
        if made > size:  # before more is unpacked
            raise ValueError("larger than said")
        yield data
    if made != size:
        raise ValueError("smaller than said")


def read_members(members: DataFrame, key: str, path: str = "path", body_limit: int | None = None) -> DataFrame:
    """members (of zip_members) with sha256, null for folders and what has a
    problem; content that isn't as the directory says is a problem too. With a
    body limit, also the body of members of at most that size."""
    names = [key, path, *_ZIP_NAMES]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in members.select(key, "ord", "name", "directory", "size").schema)
    bodies = ", body binary" if body_limit is not None else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in names}
            shas, problems, held = [], columns["problem"], []
            for i, file in enumerate(columns[path]):
                sha, body = None, None
                if problems[i] is None and not columns["directory"][i]:
                    sha, body = hashlib.sha256(), [] if body_limit is not None and columns["size"][i] <= body_limit else None
                    try:
                        with open(_local(file), "rb") as source:
                            source.seek(columns["at"][i])
                            head = source.read(30)
                            source.seek(int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"), 1)
                            crc = 0
                            for data in _streamed(source, columns["packed"][i], columns["method"][i], columns["size"][i]):
                                sha.update(data)
                                crc = zlib.crc32(data, crc)
                                if body is not None:
                                    body.append(data)
                        if crc != columns["crc"][i]:
                            raise ValueError("checksum")
                    except (ValueError, zlib.error, OSError):
                        problems[i], sha, body = "content", None, None
                shas.append(sha.hexdigest() if sha else None)
                held.append(b"".join(body) if body is not None else None)
            made = [pa.array(shas, pa.string()), pa.array(problems, pa.string()), *([pa.array(held, pa.binary())] if bodies else [])]
            kept = [batch.column(n) for n in (key, "ord", "name", "directory", "size")]
            yield pa.record_batch([*kept, *made], [key, "ord", "name", "directory", "size", "sha256", "problem", *(["body"] if bodies else [])])

    count = max(8, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = members.select(*names).repartition(count, path, F.expr("ord div 64")).sortWithinPartitions(path, "at")
    return dealt.mapInArrow(run, f"{kinds}, sha256 string, problem string{bodies}")


# -- tar.gz ----------------------------------------------------------------


def tar_members(archives: DataFrame, key: str, path: str = "path", limits: Limits = Limits()) -> DataFrame:
    """key, ord, name, directory, size, sha256, problem of each tar.gz: one
    stream for each archive. Links and special files are problems; a stream that
    breaks off gives one more row without a name, after those of whole blocks."""

    def members(file: str) -> Iterator[tuple]:
        n, total = 0, 0
        try:
            with gzip.open(_local(file)) as unpacked, tarfile.open(fileobj=unpacked, mode="r|", bufsize=BLOCK) as tar:
                for m in tar:
                    sha, problem = None, None
                    if m.issym() or m.islnk():
                        problem = "link"
                    elif not (m.isreg() or m.isdir()):
                        problem = "special file"
                    elif m.mode & 0o7000:
                        problem = "permissions"
                    elif m.isdir() and m.size:
                        problem = "directory with content"
                    else:
                        problem = name_problem(m.name, m.isdir(), limits) or ("size" if m.size > limits.file_bytes else None)
                    total += m.size if m.isreg() else 0
                    if n >= limits.members or total > limits.total_bytes:
                        yield n, None, False, None, None, "too many members" if n >= limits.members else "total size"
                        return
                    if problem is None and m.isreg():
                        sha, source = hashlib.sha256(), tar.extractfile(m)
                        while data := source.read(BLOCK):
                            sha.update(data)
                        sha = sha.hexdigest()
                    yield n, m.name, m.isdir(), m.size, sha, problem
                    n += 1
                rest = 0  # to the end of the stream, whose checksum tells that all is there
                while data := unpacked.read(BLOCK):
                    rest += len(data)
                    if rest > limits.trailing_bytes:
                        yield n, None, False, None, None, "trailing data"
                        return
        except EOFError:
            yield n, None, False, None, None, "cut off"
        except (tarfile.TarError, OSError, zlib.error):
            yield n, None, False, None, None, "no archive" if n == 0 else "cut off"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for i, file in enumerate(batch.column(1).to_pylist()):
                for rows in batched(members(file), 4096):
                    same = pa.array([batch.column(0)[i].as_py()] * len(rows), batch.column(0).type)
                    folds = pa.array([_folded(r[1], r[5]) for r in rows], pa.string())
                    yield pa.record_batch([same, folds, *(pa.array(c, t) for c, t in zip(zip(*rows), types))], [key, "folded", "ord", "name", "directory", "size", "sha256", "problem"])

    kind = archives.schema[key].dataType.simpleString()
    count = max(8, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = archives.select(key, path).repartition(count, path).mapInArrow(run, f"`{key}` {kind}, folded string, ord int, name string, directory boolean, size long, sha256 string, problem string")
    out = _judged(found, key, limits)
    return out.withColumn("sha256", F.when(F.col("problem").isNull(), F.col("sha256")))


# -- writing ---------------------------------------------------------------


class _Zip:
    def __init__(self, file: str):
        self.archive = zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED)

    def add(self, name: str, body: bytes) -> None:
        info = zipfile.ZipInfo(name, TIME)
        info.compress_type = zipfile.ZIP_DEFLATED
        self.archive.writestr(info, body)


class _Tar:
    def __init__(self, file: str):
        self.archive = tarfile.open(file, "w:gz", compresslevel=6)

    def add(self, name: str, body: bytes) -> None:
        info = tarfile.TarInfo(name)
        info.size = len(body)
        self.archive.addfile(info, io.BytesIO(body))


def write_archives(files: DataFrame, key: str, folder: str, kind: str = "zip", name: str = "name", body: str = "body") -> DataFrame:
    """An archive file (zip or tar.gz) below a folder for each key, its files in
    the order of names: key, path, members. Files stream into it; a task holds
    one file. To be stored at once, as each evaluation writes anew."""
    target, make = _local(folder), {"zip": _Zip, "tar.gz": _Tar}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(target, exist_ok=True)
        now, file, out, n = None, None, None, 0

        def close() -> pa.RecordBatch:
            out.archive.close()
            return pa.record_batch([pa.array([now[0]], keys), pa.array([file]), pa.array([n], pa.int64())], [key, "path", "members"])

        for batch in batches:
            keys = batch.column(0).type
            for i in range(batch.num_rows):
                k, member, data = (batch.column(c)[i].as_py() for c in range(3))
                if now != (k,):
                    if out is not None:
                        yield close()
                    now, n, file = (k,), 0, f"{target}/{uuid.uuid4().hex}.{kind}"
                    out = make(file)
                out.add(member, data or b"")
                n += 1
        if out is not None:
            yield close()

    kinds = files.schema[key].dataType.simpleString()
    rows = files.select(F.col(key), F.col(name).alias("name"), F.col(body).cast("binary").alias("body"))
    return rows.repartition(key).sortWithinPartitions(key, "name").mapInArrow(run, f"`{key}` {kinds}, path string, members long")


def write_files(files: DataFrame, folder: str, name: str = "name", body: str = "body") -> DataFrame:
    """Each row's body as a file below a folder: name, size, problem. Names are
    judged as members' are; refused ones are not written. A file is written
    beside its place and renamed, so a task that is tried again is harmless."""
    target = _local(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                problem = name_problem(n or "", False)
                if problem is None:
                    place = os.path.join(target, n)
                    os.makedirs(os.path.dirname(place), exist_ok=True)
                    new = f"{place}.{uuid.uuid4().hex}"
                    with open(new, "wb") as f:
                        f.write(data or b"")
                    os.replace(new, place)
                out.append((n, len(data or b""), problem))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string()))], ["name", "size", "problem"])

    rows = files.select(F.col(name).alias("name"), F.col(body).cast("binary").alias("body"))
    return rows.mapInArrow(run, "name string, size long, problem string")


def verified_archives(files: DataFrame, key: str, folder: str, name: str = "name", body: str = "body", limits: Limits = Limits()) -> DataFrame:
    """A ZIP file below a folder for each key, read back member by member: key,
    path, members and whether it holds exactly the files (names, sizes, hashes)
    and no member with a problem."""
    made = stored(write_archives(files, key, folder, "zip", name, body), "archives")
    data = F.coalesce(F.col(body).cast("binary"), F.lit(b""))
    wanted = files.select(F.col(key), F.col(name).alias("name"), F.octet_length(data).cast("long").alias("size"), F.sha2(data, 256).alias("sha256"))
    found = read_members(zip_members(made, key, limits=limits), key).select(key, "name", "size", "sha256", "problem")
    side = lambda df, n: df.groupBy(key, "name", "size", "sha256").agg(F.count("*").alias(n))
    met = side(wanted, "w").join(side(found.where("problem is null"), "f"), [key, "name", "size", "sha256"], "full")
    wrong = met.where("not (w <=> f)").select(key).unionByName(found.where("problem is not null").select(key)).distinct().withColumn("bad", F.lit(True))
    return made.join(wrong, key, "left").select(key, "path", "members", F.col("bad").isNull().alias("verified"))
