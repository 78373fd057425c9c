"""Helpers that the corpus operators share.

Text reaches Python workers as Arrow batches; everything below works on the
batch's own byte buffer in segments of bounded size, so a worker's memory does
not follow the number of rows or the length of one text.
"""

from __future__ import annotations

import json
import os
import sys
import uuid
from collections.abc import Callable, Iterable, Iterator
from types import ModuleType
from urllib.parse import unquote, urlsplit
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all word contracts: [\x20\x09-\x0D].
WHITE = b" \t\n\x0b\x0c\r"
WHITE_TEXT = WHITE.decode()
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Bytes of text that a worker looks at together (one longer word extends it).
SEGMENT = 1 << 20


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows and bytes: texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder (URI or path) under spark.checkpoint.dir. Where the session
    has no such setting it is made here if Spark is local, as in tests; a
    cluster must name a folder that its executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        root = os.path.join(os.getcwd(), "spark-warehouse", "shared")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that shared_folder named and nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet under the shared folder and read it again: cheaper
    to scan by column than a checkpoint, and it survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def worker_state() -> dict:
    """A dictionary that lives as long as the worker process. Functions travel
    by value, so the globals of their module are new for each task."""
    return sys.modules.setdefault("docloom_worker_state", ModuleType("docloom_worker_state")).__dict__


class Files:
    """Files of a shared folder, opened from any executor.

    Local and mounted folders are opened as such (so arrays can be mapped);
    other schemes go through pyarrow's file systems.
    """

    def __init__(self, folder: str):
        self.folder = folder
        parts = urlsplit(folder)
        self.local = parts.scheme in ("", "file")
        self.base = unquote(parts.path) if self.local else folder
        self.maps: dict[str, np.ndarray] = {}  # one mapping for each file

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def _fs(self, name: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path(name))

    def write(self, name: str, parts: Iterable[bytes]) -> int:
        """Write the parts one after another; returns the bytes written.
        Names must be new for each attempt: a retried task never overwrites."""
        size = 0
        with self.create(name) as out:
            for part in parts:
                out.write(part)
                size += memoryview(part).nbytes
        return size

    def create(self, name: str):
        """A writer, to be closed by the caller; names as in write."""
        if self.local:
            os.makedirs(self.base, exist_ok=True)
            return open(self.path(name), "wb")
        system, path = self._fs(name)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        return system.open_output_stream(path)

    def open(self, name: str):
        """A seekable reader."""
        if self.local:
            return open(self.path(name), "rb")
        system, path = self._fs(name)
        return system.open_input_file(path)

    def array(self, name: str, dtype, count: int, offset: int = 0) -> np.ndarray:
        """`count` items from byte `offset`: memory-mapped where possible."""
        if not count:
            return np.empty(0, dtype)
        if self.local:
            if name not in self.maps:
                self.maps[name] = np.memmap(self.path(name), np.uint8, "r").view(np.ndarray)
            return self.maps[name][offset : offset + count * np.dtype(dtype).itemsize].view(dtype)
        with self.open(name) as f:
            f.seek(offset)
            return np.frombuffer(f.read(count * np.dtype(dtype).itemsize), dtype)


def hash_partitions(df: DataFrame, least: int = 8) -> int:
    """Reduce tasks for what df's own tasks emit: as many as read it, or the
    session's shuffle setting if that is higher."""
    spark = df.sparkSession
    return max(least, df.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_group(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with groups, which have one row for each key and n, the
    number of rows of that key among all `total`. Keys that hold a share of
    1 / (2 * partitions) or more, at most 2 * partitions of them, are broadcast,
    so that their rows stay where they are; the rest meet by a shuffle."""
    limit = -(-total // (2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))) if total else 1
    hot, rest = F.broadcast(groups.where(F.col("n") >= limit)), groups.where(F.col("n") < limit)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key))


#: Bits of a Bitmap: 8 MB, whatever it holds.
BITMAP_BITS = 1 << 26


def bitmap(keys: DataFrame) -> np.ndarray:
    """A bitmap of fixed size in which every key (one binary column) has its
    bit set. It may let other keys through, the more the more keys there are:
    use it only to spare work."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = np.unique(np.array([crc32(k) for k in batch.column(0).to_pylist()], np.int64) % BITMAP_BITS)
        first = np.flatnonzero(np.concatenate(([True], at[1:] >> 6 != at[:-1] >> 6)))
        bits = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first)
        return pa.record_batch([pa.array((at >> 6)[first]), pa.array(bits.view(np.int64))], ["word", "bits"])

    words = in_arrow(keys, step, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITMAP_BITS >> 6, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def in_bitmap(bits: np.ndarray, keys: list[bytes]) -> np.ndarray:
    at = np.array([crc32(k) for k in keys], np.int64) % BITMAP_BITS
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def fresh(columns: Iterable[str], name: str) -> str:
    """`name`, or a variant that no column has (names compare without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def constant(value, kind: str) -> Column:
    """A constant array or map of any size: one JSON text that the optimizer
    folds, where thousands of literals would swell the generated code."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def text_or_empty(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col.cast("string"), F.lit(""))


# --------------------------------------------------------------------------
# Arrow text buffers
# --------------------------------------------------------------------------


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """The texts of a column one by one, as bytes."""
    body, offsets = buffers(column)
    view = body.tobytes() if len(body) <= SEGMENT else None
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield view[a:b] if view is not None else body[a:b].tobytes()


_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[list(WHITE)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240611)
_VALUE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_VALUE_LOWER = _VALUE[_LOWER]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        size = max(n, SEGMENT + 4096)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            _tables[name] = np.multiply.accumulate(t)
    return _tables["up"], _tables["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finish 64-bit hashes so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _segment_hashes(seg: np.ndarray, breaks: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and word starts of one segment; breaks: offsets at which a
    text begins (a word never crosses one)."""
    return _segment_words(seg, breaks, lower)[:2]


def _segment_words(seg: np.ndarray, breaks: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(seg)
    word = ~_IS_WHITE[seg]
    first = word.copy()
    first[1:] &= ~word[:-1]
    at = breaks[(breaks > 0) & (breaks < n)]
    first[at] = word[at]
    starts = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[at - 1] = word[at - 1]
    ends = np.flatnonzero(last) + 1
    up, down = _powers(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_VALUE_LOWER if lower else _VALUE)[seg] * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts, ends


def word_hashes(body: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yield (hashes, counts) for runs of whole texts: 64-bit hashes of the
    words `[^\\x20\\x09-\\x0D]+` in order, and the number of words of each text.

    A run holds about SEGMENT bytes, or one longer text (its segments are cut
    at white space, so only hashes, not byte tables, grow with it).
    """
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SEGMENT, "right")) - 1)
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= SEGMENT:
            rel = offsets[i : j + 1] - lo
            h, starts = _segment_hashes(body[lo:hi], rel, lower) if hi > lo else (np.empty(0, np.uint64), np.empty(0, np.int64))
            yield h, np.diff(np.searchsorted(starts, rel))
        else:  # one long text
            parts, a = [], lo
            while a < hi:
                b = min(a + SEGMENT, hi)
                while b < hi and not _IS_WHITE[body[b]]:
                    step = body[b : min(b + 65536, hi)]
                    white = np.flatnonzero(_IS_WHITE[step])
                    b += int(white[0]) if len(white) else len(step)
                parts.append(_segment_hashes(body[a:b], np.empty(0, np.int64), lower)[0])
                a = b
            h = np.concatenate(parts)
            yield h, np.array([len(h)])
        i = j


def segment_words(body: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Yield (bytes, hashes, starts, ends, text) for segments of about SEGMENT
    bytes that end at white space or at the end of a text: the words in order,
    where they lie in the bytes, and the number of each word's text."""
    a, end = 0, len(body)
    while a < end:
        b = min(a + SEGMENT, end)
        while b < end and not _IS_WHITE[body[b]]:
            after = int(offsets[np.searchsorted(offsets, b, "left")])  # where the next text begins
            step = body[b : min(b + 65536, after)]
            white = np.flatnonzero(_IS_WHITE[step])
            b += int(white[0]) if len(white) else len(step)
            if b == after:
                break
        first = int(np.searchsorted(offsets, a, "right"))
        breaks = offsets[first : np.searchsorted(offsets, b, "left")] - a
        h, starts, ends = _segment_words(body[a:b], breaks, False)
        yield body[a:b], h, starts, ends, np.searchsorted(offsets, starts + a, "right") - 1
        a = b


# --------------------------------------------------------------------------
# blocks of sorted 64-bit keys
# --------------------------------------------------------------------------


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct uint64 keys with positive counts, delta coded and
    compressed by byte plane."""
    deltas = np.diff(keys, prepend=np.uint64(0))
    planes = np.ascontiguousarray(deltas.view(np.uint8).reshape(-1, 8).T)
    small = np.minimum(counts, 255).astype(np.uint8)
    big = counts[counts >= 255].astype(np.int64)
    raw = np.int64([len(keys), len(big)]).tobytes() + planes.tobytes() + small.tobytes() + big.tobytes()
    return pa.Codec("zstd", 1).compress(raw, asbytes=True) + np.int64(len(raw)).tobytes()


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = int(np.frombuffer(block, np.int64, 1, len(block) - 8)[0])
    raw = pa.Codec("zstd").decompress(memoryview(block)[:-8], size, asbytes=True)
    n, big = np.frombuffer(raw, np.int64, 2)
    planes = np.frombuffer(raw, np.uint8, 8 * n, 16).reshape(8, n)
    keys = np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)
    counts = np.frombuffer(raw, np.uint8, n, 16 + 8 * n).astype(np.int64)
    if big:
        counts[counts == 255] = np.frombuffer(raw, np.int64, big, 16 + 9 * n)
    return keys, counts


def pack_pairs(high: np.ndarray, low: np.ndarray, counts: np.ndarray) -> bytes:
    """As pack, for keys of two uint64 columns sorted by both."""
    planes = lambda x: np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()
    big = counts[counts >= 255].astype(np.int64)
    raw = np.int64([len(high), len(big)]).tobytes() + planes(np.diff(high, prepend=np.uint64(0))) + planes(low) + np.minimum(counts, 255).astype(np.uint8).tobytes() + big.tobytes()
    return pa.Codec("zstd", 1).compress(raw, asbytes=True) + np.int64(len(raw)).tobytes()


def unpack_pairs(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = int(np.frombuffer(block, np.int64, 1, len(block) - 8)[0])
    raw = pa.Codec("zstd").decompress(memoryview(block)[:-8], size, asbytes=True)
    n, big = np.frombuffer(raw, np.int64, 2).tolist()
    column = lambda at: np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T).view(np.uint64).ravel()
    counts = np.frombuffer(raw, np.uint8, n, 16 + 16 * n).astype(np.int64)
    if big:
        counts[counts == 255] = np.frombuffer(raw, np.int64, big, 16 + 17 * n)
    return np.cumsum(column(16), dtype=np.uint64), column(16 + 8 * n), counts


def summed_pairs(high: np.ndarray, low: np.ndarray, counts: np.ndarray | None = None, inverse: bool = False):
    """As summed, for keys of two uint64 columns; with inverse, also the
    position of each row's key."""
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    new = np.ones(len(order), bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    first = np.flatnonzero(new)
    if counts is None:
        total = np.diff(first, append=len(order))
    else:
        total = np.add.reduceat(counts[order], first) if len(first) else np.empty(0, np.int64)
    if not inverse:
        return high[first], low[first], total
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    return high[first], low[first], total, back


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts (1 each if None)."""
    if not len(keys):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    if counts is None:
        return keys[first], np.diff(first, append=len(keys))
    return keys[first], np.add.reduceat(counts, first)


def in_arrow(df: DataFrame, step: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = step(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.mapInArrow(run, schema)
