"""WARC archives: a writer, and a splittable reader.

The writer makes one gzip member for each record. Of records with equal
payloads of at least `min_bytes` bytes the one with the largest page id is a
response; the others are revisits without a payload.

The reader cuts every file into byte ranges. A task scans its range for the
gzip magic, decodes the head of the candidate member, and takes it if a WARC
version line is found there; from then on members follow one another. A
record belongs to the range in which its member starts, wherever it ends, so
each record is read exactly once. A member that begins well and cannot be read
to its end, or whose payload has another digest than its head says, is damaged:
reading fails, or gives a row with the problem. Damage that hides a member's
head is told by the manifest, which knows each file's records.

Scale: deduplication aggregates narrow rows (digest, id); pages shuffle once,
by digest, and adaptive execution splits a digest that many pages share, as
its other side is one row. The manifest is a table, not a list at the driver.
Archive files have a name of their own for each attempt of a task and count
only if the task that wrote them was kept, so retries leave no double records.

Limits: archives must lie where executors can open files at an offset: a
mounted folder, or a store that pyarrow's file systems know. A false start
would need WARC text inside the compressed bytes of another member, which
UTF-8 payloads cannot hold uncompressed (0x8B never follows 0x1F there).

Defined cases: a null payload is empty; a null url an empty target; control
characters of a url are percent-encoded in the header. A null page id sorts
below all others and comes back as null. Rows that share the largest page id
of a group are all responses; repeated page ids have a record each. Other
columns of the pages are not archived, whatever their names. An empty table
gives an empty archive.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Files, prepare, shared_folder, stored, texts

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
MIN_BYTES = 1000
FILE_BYTES = 64 << 20
SPLIT_BYTES = 8 << 20
BLOCK = 1 << 18
#: Records carry no crawl time of their own.
DATE = "1970-01-01T00:00:00Z"


def _gzip(data: bytes, level: int = 4) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _urn(page: int | None) -> str:
    return f"<urn:x-page:{'null' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None = None) -> bytes:
    """One record as a gzip member; payload None: a revisit of refers_to."""
    target = quote(url or "", safe="!#$%&'()*+,/:;=?@[]~", encoding="utf-8", errors="replace")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC-Type: " + ("response" if payload is not None else "revisit"), f"WARC-Record-ID: {_urn(page)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    return _gzip(VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def _digests(batch: pa.RecordBatch) -> pa.RecordBatch:
    sizes, shas = [], []
    for body in texts(batch.column(1)):
        sizes.append(len(body))
        shas.append(hashlib.sha1(body).digest())
    return pa.record_batch([batch.column(0), pa.array(shas, pa.binary()), pa.array(sizes, pa.int64())], ["page", "sha", "size"])


def _writer(folder: str, file_bytes: int):
    files = Files(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []

        def close() -> pa.RecordBatch:
            name = f"part-{uuid.uuid4().hex}.warc.gz"
            size = files.write(name, parts)
            out = pa.record_batch([pa.array([name]), pa.array([size], pa.int64()), pa.array([len(parts)], pa.int64())], ["file", "bytes", "records"])
            parts.clear()
            return out

        held = 0
        for batch in batches:
            pages, urls, last = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for page, url, body, top in zip(pages, urls, texts(batch.column(2)), last):
                again = top is not None and page != top
                parts.append(record(page, url, None if again else body, hashlib.sha1(body).hexdigest(), len(body), top if again else None))
                held += len(parts[-1])
                if held >= file_bytes:
                    held = 0
                    yield close()
        if parts:
            yield close()

    return run


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the pages under folder; returns the manifest: file, bytes, records."""
    prepare(pages.sparkSession)
    page, body = F.col(id_col).cast("long"), F.col(body_col).cast("string")
    narrow = pages.select(page.alias("page"), body.alias("body")).mapInArrow(lambda batches: (_digests(b) for b in batches), "page long, sha binary, size long")
    shared = narrow.where(F.col("size") >= min_bytes).groupBy("sha").agg(F.max("page").alias("top"), F.count("*").alias("n")).where("n > 1 and top is not null").select("sha", "top")
    rows = pages.select(page.alias("page"), F.col(url_col).cast("string").alias("url"), body.alias("body"), F.unhex(F.sha1(F.coalesce(body, F.lit("")))).alias("sha"))
    joined = rows.join(shared, "sha", "left").select("page", "url", "body", "top")
    return stored(joined.mapInArrow(_writer(folder, file_bytes), "file string, bytes long, records long"), "warc-manifest")


# -- reading ---------------------------------------------------------------


class _Window:
    """Bytes of a file from some offset on, read block by block."""

    def __init__(self, source, size: int):
        self.source, self.size, self.at, self.held = source, size, 0, b""

    def get(self, start: int, length: int) -> bytes:
        if not (self.at <= start and start + length <= self.at + len(self.held)):
            self.source.seek(start)
            self.at, self.held = start, self.source.read(max(length, BLOCK))
        return self.held[start - self.at : start - self.at + length]


class Damaged(ValueError):
    """A member that cannot be read to its end."""


def _member(window: _Window, start: int) -> tuple[bytes, int] | None:
    """The record in the member at start, and the member's end; None if there
    is no member with a WARC version line."""
    unpack = zlib.decompressobj(31)
    try:
        head = unpack.decompress(window.get(start, 512), 16)
    except zlib.error:
        return None
    if not head.startswith(b"WARC/"):
        return None
    out, at = [head], start + min(512, window.size - start)
    try:
        out.append(unpack.decompress(unpack.unconsumed_tail))
        while not unpack.eof:
            data = window.get(at, min(BLOCK, window.size - at))
            if not data:
                raise Damaged("cut off")
            at += len(data)
            out.append(unpack.decompress(data))
    except zlib.error as e:
        raise Damaged(str(e)) from None
    return b"".join(out), at - len(unpack.unused_data)


def members(source, size: int, start: int, end: int, problems: list[tuple[int, str]] | None = None) -> Iterator[bytes]:
    """The records whose members start in [start, end). Damaged members are
    added to problems (place, text) and passed over; without, they raise."""
    window, at = _Window(source, size), start
    while at < end:
        try:
            found = _member(window, at) if window.get(at, 3) == MAGIC else None
        except Damaged as e:
            if problems is None:
                raise Damaged(f"member at {at}: {e}") from None
            problems.append((at, str(e)))
            found = None
        if found:
            data, at = found
            yield data
            continue
        # scan on; two more bytes let a magic cross the end of what is held
        at += 1
        while at < end:
            piece = window.get(at, min(BLOCK, end - at + 2))
            hit = piece.find(MAGIC)
            if hit >= 0:
                at += hit
                break
            at += max(len(piece) - 2, 1)


_FIELD = re.compile(rb"([!-9;-~]+):[ \t]*([^\r\n]*)")


def parse(data: bytes) -> dict:
    """Header fields (lower-case names) and the block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {m[1].decode().lower(): m[2].decode("utf-8", "replace").strip() for m in _FIELD.finditer(head)}
    return fields | {"block": rest[: int(fields.get("content-length", 0))]}


def _page(urn: str | None) -> int | None:
    value = (urn or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(value) if re.fullmatch(r"-?\d+", value) else None


def _reader(folder: str, with_payload: bool, report: bool):
    files = Files(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                rows, held, problems = [], 0, []
                with files.open(name) as source:
                    for data in members(source, size, start, end, problems):
                        r = parse(data)
                        http, _, payload = r["block"].partition(b"\r\n\r\n")
                        kind, digest = r.get("warc-type"), r.get("warc-payload-digest", "").removeprefix("sha1:")
                        length = re.search(rb"(?i)content-length: *(\d+)", http)
                        if kind == "response":
                            told, digest, n = digest, hashlib.sha1(payload).hexdigest(), len(payload)
                            if told != digest:
                                problems.append((0, f"payload of {r.get('warc-record-id')} has another digest"))
                                continue
                        else:
                            n = int(length[1]) if length else 0
                        rows.append((_page(r.get("warc-record-id")), r.get("warc-target-uri"), n, digest, kind, _page(r.get("warc-refers-to")), payload if with_payload and kind == "response" else None, name, None))
                        held += len(data) if with_payload else 200
                        if held > 4 << 20:
                            yield _rows(rows)
                            rows, held = [], 0
                if problems and not report:
                    raise Damaged(f"{name}: " + "; ".join(f"{text} at {at}" for at, text in problems))
                rows += [(*[None] * 7, name, f"{text} at {at}") for at, text in problems]
                if rows:
                    yield _rows(rows)

    return run


_KINDS = [("page_id", pa.int64()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("file", pa.string()), ("problem", pa.string())]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(_KINDS)], [n for n, _ in _KINDS])


def read_archive(manifest: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES, payloads: bool = True, report: bool = False) -> DataFrame:
    """The records of the manifest's files (columns file and bytes): page_id,
    target_uri, payload_bytes, payload_digest, record_type, refers_to, payload,
    file, problem. Damaged members fail the run; with `report`, each is a row of
    its file and problem only."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start")
    splits = manifest.where("bytes > 0").select("file", "bytes", starts).withColumn("end", F.least(F.col("start") + split_bytes, F.col("bytes")))
    splits = splits.repartition(max(8, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "file", "start")
    return splits.mapInArrow(_reader(folder, payloads, report), "page_id long, target_uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, file string, problem string")


def incomplete(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """The manifest's files (file, records, found) of which another number of
    records was read than was written."""
    read = records.where("problem is null").groupBy("file").agg(F.count("*").alias("found"))
    files = manifest.select("file", "records").join(read, "file", "left").fillna(0, ["found"])
    return files.where("found <> records")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages to a new shared folder and read the archives back; every
    file must give as many records as went into it."""
    folder = shared_folder(spark, "warc")
    if Files(folder).local:
        os.makedirs(Files(folder).base, exist_ok=True)
    manifest = write_archive(pages, folder)
    records = stored(read_archive(manifest, folder, payloads=False), "warc-records")
    bad = incomplete(manifest, records).limit(5).collect()
    if bad:
        raise Damaged(", ".join(f"{r.file}: {r.found} of {r.records} records" for r in bad))
    return records
