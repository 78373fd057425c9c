"""Exact dedup: one row stays of texts that are equal but for white space.

Group by a 128-bit hash of the text without `[\\x20\\x09-\\x0D]`, choose the
row that stays, and compare the bytes of the texts of every group of two or
more; texts that only share the hash (a collision) are grouped apart.

Scale: grouping works on narrow rows (hash, id, length, digest). Bytes are
compared by an aggregate on (hash, bytes), in which equal texts become one row
on the map side, so a hot group sends one text per task. Texts of single
documents are not shuffled: a bitmap of fixed size (8 MB) tells most of them.
The groups that hold most rows, of bounded number, are broadcast to their rows.

Defined cases: a null text counts as empty. The row with the most code points
in the original text stays, then the smallest id (null ids last). Repeated
rows with the same id and text: exactly one is kept. Empty tables give empty
results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WHITE, bitmap, fresh, in_arrow, in_bitmap, prepare, stored, texts, with_group


def _normalised(digest: Callable[[bytes], bytes]):
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        chars, hashes, shas = [], [], []
        for text in texts(batch.column(1)):
            body = text.translate(None, WHITE)
            chars.append(len(text) if text.isascii() else int(np.count_nonzero(np.frombuffer(text, np.uint8) & 0xC0 != 0x80)))
            hashes.append(digest(body))
            shas.append(hashlib.sha256(body).digest())
        return pa.record_batch([batch.column(0), pa.array(chars, pa.int64()), pa.array(hashes, pa.binary()), pa.array(shas, pa.binary())], ["doc_id", "chars", "hash", "sha"])

    return step


def _bodies(digest: Callable[[bytes], bytes], wanted: np.ndarray):
    """(hash, sha, normalised bytes) of texts whose hash is in a bitmap."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        bodies = [text.translate(None, WHITE) for text in texts(batch.column(0))]
        hashes = [digest(b) for b in bodies]
        keep = np.flatnonzero(in_bitmap(wanted, hashes)).tolist()
        columns = [[hashes[i] for i in keep], [hashlib.sha256(bodies[i]).digest() for i in keep], [bodies[i] for i in keep]]
        return pa.record_batch([pa.array(c, pa.binary()) for c in columns], ["hash", "sha", "body"])

    return step


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[bytes], bytes] = xxhash.xxh3_128_digest) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept,
    text_sha256 (of the normalised text) and n_chars (of the original)."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    narrow = stored(in_arrow(rows, _normalised(digest), "doc_id long, chars long, hash binary, sha binary"), "exact-rows")
    groups = _groups(narrow)
    # the bytes of the rows of larger groups: equal ones become one row
    wanted = bitmap(groups.where("n > 1").select("hash"))
    bodies = in_arrow(rows.select("text"), _bodies(digest, wanted), "hash binary, sha binary, body binary").distinct()
    kinds = stored(bodies.groupBy("hash", "sha").agg(F.count("*").alias("bodies")), "exact-bodies")
    if kinds.where("bodies > 1").limit(1).count():
        raise ValueError("different texts share a 128-bit hash and a SHA-256 digest")
    if kinds.groupBy("hash").count().where("count > 1").limit(1).count():
        # texts that only share the hash: told apart by their digests, which
        # have just been found to stand for one text each
        narrow = narrow.withColumn("hash", F.concat("hash", "sha"))
        groups = _groups(narrow)
    alone = groups.where("n = 1").select(F.col("best.doc_id").alias("doc_id"), F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), F.lit(True).alias("kept"), "sha", (-F.col("best.less")).alias("n_chars"))
    same = narrow.groupBy("hash", "doc_id", "chars").agg(F.count("*").alias("copies"), F.min("sha").alias("sha"))
    placed = with_group(same, groups.where("n > 1").select("hash", "n", "best"), "hash", narrow.count())
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("chars") == -F.col("best.less")) & (F.col("copy") == 1)
    out = alone.unionByName(placed.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), "sha", F.col("chars").alias("n_chars")))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"), "n_chars")


def _groups(narrow: DataFrame) -> DataFrame:
    order = F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id")
    return stored(narrow.groupBy("hash").agg(F.count("*").alias("n"), F.min(order).alias("best"), F.min("sha").alias("sha")), "exact-groups")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the copies: the same columns, one row of each group."""
    groups = exact_groups(docs, id_col, text_col)
    doc = F.col(id_col).cast("long")
    if not docs.groupBy(doc).count().where("count > 1").limit(1).count():  # an id names its row
        gone = fresh(docs.columns, "gone")
        away = groups.where("not kept").select(F.col("doc_id").alias(gone))
        return docs.join(away, doc.eqNullSafe(away[gone]), "left_anti")
    return rows_of(docs, groups.where("kept").select("doc_id", "text_sha256"), id_col, text_col)


def rows_of(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs whose id and normalised text `kept` names, one each."""
    key, sha = fresh(docs.columns, "kept_id"), fresh(docs.columns, "kept_sha")
    own = F.sha2(F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"[\x20\x09-\x0D]", ""), 256)
    named = kept.select(F.col("doc_id").alias(key), F.col("text_sha256").alias(sha))
    many = docs.groupBy(F.col(id_col).cast("long").alias(key)).count().where("count > 1").select(key)
    left = docs.join(many, F.col(id_col).cast("long").eqNullSafe(many[key]), "left_anti").withColumn(sha, own)
    repeated = docs.join(many, F.col(id_col).cast("long").eqNullSafe(many[key]), "left_semi").withColumn(sha, own).dropDuplicates([id_col, sha])
    both = left.unionByName(repeated)
    return both.join(named, F.col(id_col).cast("long").eqNullSafe(named[key]) & (both[sha] == named[sha]), "left_semi").select(*docs.columns)
