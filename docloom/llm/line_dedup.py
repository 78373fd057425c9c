"""Line dedup: lines that several documents share stay in the first one only.

Explode normalised lines, hash them (128 bits), count the distinct documents
of each hash, drop lines found in `min_docs` documents or more, and put the
rest together again by position.

Scale: line keys are computed once and stored as narrow (hash, id) rows. The
counts are pre-aggregated on the map side, so a line that every document holds
shuffles one row per task; the verdicts of the most frequent lines, whose
number is bounded, are broadcast to the rows, and the others meet them by a
shuffle of narrow rows. Texts shuffle once, by document.

Defined cases: a null or empty text is one empty line. All rows with a null id
count as one document that comes after all others, also after the greatest id
there is. Rows that share an id count as one document and are all treated
alike. Keys shorter than `min_chars` code points are never dropped. An empty
table gives an empty result. Extra columns pass through untouched, but for
columns named kept_text, n_lines or n_dropped, which the result replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WHITE, fresh, in_arrow, prepare, stored, texts, with_group


def _key(line: bytes, min_chars: int) -> bytes | None:
    """The hash of a line's key, None if the key is too short."""
    key = line.strip(WHITE).lower()
    if len(key) < min_chars or (not key.isascii() and sum(b & 0xC0 != 0x80 for b in key) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def _keys(min_chars: int):
    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, hashes = [], []
        for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
            found = {k for line in text.split(b"\n") if (k := _key(line, min_chars))}
            ids += [doc] * len(found)
            hashes += found
            if len(ids) > 100_000:
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(hashes, pa.binary())], ["doc", "line"])
                ids, hashes = [], []
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(hashes, pa.binary())], ["doc", "line"])

    return step


def _reassemble(min_chars: int):
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, n_lines, n_dropped = [], [], []
        for text, drops in zip(texts(batch.column(0)), batch.column(1).to_pylist()):
            lines = text.split(b"\n")
            n_lines.append(len(lines))
            if drops:
                gone = set(drops)
                lines = [x for x in lines if _key(x, min_chars) not in gone]
            n_dropped.append(n_lines[-1] - len(lines))
            kept.append(b"\n".join(lines))
        return pa.record_batch([*batch.columns[2:], pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*batch.schema.names[2:], "kept_text", "n_lines", "n_dropped"])

    return step


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_chars: int = 10, keep: list[str] | None = None) -> DataFrame:
    """`keep` columns of docs (all by default), then kept_text, n_lines and
    n_dropped; a column of docs with such a name is left out."""
    prepare(docs.sparkSession)
    doc = F.col(id_col).cast("long")
    pairs = stored(in_arrow(docs.select(doc.alias("doc"), F.col(text_col).cast("string").alias("text")), _keys(min_chars), "doc long, line binary"), "line-keys")
    # documents with an id, and one more for all without
    unnamed = F.count("*") > F.count("doc")
    if min_docs == 2:  # two documents: the least and the greatest id differ
        known = F.when(F.min("doc") < F.max("doc"), 2).when(F.min("doc").isNotNull(), 1).otherwise(0)
    else:
        known = F.count_distinct("doc")
    seen = pairs.groupBy("line").agg(F.min("doc").alias("first"), (known + F.when(unnamed, 1).otherwise(0)).alias("docs"), F.count("*").alias("n"))
    shared = stored(seen.where(F.col("docs") >= min_docs).select("line", "first", "n"), "line-shared")
    judged = with_group(pairs, shared, "line", pairs.count())
    drops = judged.where("first is not null and (doc is null or doc > first)").groupBy("doc").agg(F.collect_set("line").alias("drops"))
    names = [c for c in (keep or docs.columns) if c not in ("kept_text", "n_lines", "n_dropped")]
    key, lines, body = (fresh(names, x) for x in ("doc", "drops", "body"))
    drops = drops.select(F.col("doc").alias(key), F.col("drops").alias(lines))
    texts_of = docs.select(*names, doc.alias(fresh([*names, key], "own")), F.col(text_col).cast("string").alias(body))
    wide = texts_of.join(drops, texts_of[texts_of.columns[-2]].eqNullSafe(drops[key]), "left")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    return in_arrow(wide.select(body, lines, *names), _reassemble(min_chars), f"{schema}, kept_text string, n_lines long, n_dropped long")
