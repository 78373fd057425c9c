"""LM scoring: an interpolated modified Kneser-Ney trigram model.

1. Words are counted over all training texts. The vocabulary is stored as
   sorted arrays of 64-bit word hashes with their counts; a word's id is its
   rank among all hashes.
2. Trigrams (u, v, w) of the text's start, its words and one end are counted
   over all training texts and dealt out by the middle word v. All trigrams of
   a middle word together give what the lower orders need: the contexts (u, v)
   with their followers, and of each pair (v, w) the number of distinct u that
   come before it. After the start nothing comes before: such a pair keeps its
   own count.
3. Words' continuation counts come from the distinct pairs; discounts from the
   counts of counts of each order.
4. Workers memory-map the arrays and score whole texts:
   p(w|uv) = max(c(uvw) - D3(c), 0) / c(uv) + g(uv) * p2(w|v), with p2 the same
   form over the pairs' counts of distinct u, p1 over the words' continuation
   counts, ending in 1 / (V + 1) for every word, unknown ones included. The
   first word of a text is scored by p2, as no trigram ends in it.

Scale: counts travel as compressed sorted blocks that each task has added up
first; no row per token is shuffled. There are at most MAX_BUCKETS buckets,
whatever the corpus, and one file of arrays for each. A bucket is cut into
cells of about TOKENS_PER_TASK tokens, of which a reduce task holds one at a
time: blocks are split by cell and sorted by Spark, which spills. A word that
holds more than half of a cell's share of all tokens is hot: its trigrams
are dealt out by u, and by w where u is hot as well (only then can the pair be
hot), and the partial sums of its pairs and contexts are added up in a second
step. The driver gets one row for each bucket file and one for each hot word
(at most two a cell); the manifest of files is itself a file.
Array files have a new name for each attempt; only files that a kept task
reports are read.

Limits: ids have 32 bits; more than 2^32 - 3 distinct words raise an
OverflowError. Counts have no limit below 2^63. Workers must be able to map
files of the shared folder (other stores are read into memory). The arrays
take 5 bytes for each distinct trigram and 13 for each distinct bigram.

Defined cases: a null or empty text is its end alone. A null id has the
crc32 of the empty text. A corpus without training rows gives uniform scores.
Repeated rows count as often as they occur. Other columns of docs are not
looked at, whatever their names.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Files, buffers, mix, pack, pack_pairs, prepare, shared_folder, stored, summed, summed_pairs, unpack, unpack_pairs, word_hashes

#: Stands for the end of a text in the vocabulary.
END = np.uint64(0x8A5CD789635D2DFF)
#: Tokens of a cell, on average.
TOKENS_PER_TASK = 3_000_000
#: Tokens that a map task adds up before it sends blocks on.
TOKENS_HELD = 3_000_000
MAX_BUCKETS = 4096
#: Words whose continuation counts one task adds up.
WORDS_PER_RANGE = 250_000
#: Ids are packed in 32 bits; two stand for the start and what is before it.
MAX_WORDS = (1 << 32) - 3
#: Bytes of blocks that are split by cell together.
BYTES_SPLIT = 32 << 20
#: Contexts with more followers than this have their sums stored.
FOLLOWERS = 8

LOW = np.uint64(0xFFFFFFFF)
HALF = np.uint64(32)


def _runs(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word hashes with an END after each text, tokens of each text)."""
    for h, counts in word_hashes(*buffers(column)):
        yield np.insert(h, np.cumsum(counts), END), counts + 1


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens of whole texts, and the texts' sizes, TOKENS_HELD at a time."""
    held, sizes, n = [], [], 0
    for batch in batches:
        for h, counts in _runs(batch.column(0)):
            held.append(h)
            sizes.append(counts)
            n += len(h)
            if n >= TOKENS_HELD:
                yield np.concatenate(held), np.concatenate(sizes)
                held, sizes, n = [], [], 0
    if held:
        yield np.concatenate(held), np.concatenate(sizes)


# -- blocks and cells ------------------------------------------------------


def _dealt(columns: tuple, place: np.ndarray, packer) -> tuple[list[int], list[bytes]]:
    """Packed blocks by place, from sorted columns."""
    if len(place) and np.any(place[1:] < place[:-1]):
        order = np.argsort(place, kind="stable")
        columns, place = tuple(c[order] for c in columns), place[order]
    if not len(place):
        return [], []
    edges = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1, [len(place)]))
    return place[edges[:-1]].tolist(), [packer(*(c[a:b] for c in columns)) for a, b in zip(edges[:-1], edges[1:])]


def _block_rows(places: list[int], blocks: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(places, pa.int64()), pa.array(blocks, pa.binary())], ["place", "block"])


def _by_cell(blocks: DataFrame, buckets: int, cells: int, place, packer, unpacker, adder) -> DataFrame:
    """Blocks (place: a bucket) dealt out by bucket and sorted by cell. place
    gives the cells of a block's columns; with one cell a bucket, a block is
    of one cell already."""
    dealt = blocks.repartition(buckets, "place")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def send() -> pa.RecordBatch:
            columns = adder(*(np.concatenate(c) for c in zip(*parts)))
            return _block_rows(*_dealt(columns, place(*columns[:-1]), packer))

        for batch in batches:
            for block in batch.column(1).to_pylist():
                parts.append(unpacker(block))
                size += sum(c.nbytes for c in parts[-1])
                if size >= BYTES_SPLIT:
                    yield send()
                    parts, size = [], 0
        if parts:
            yield send()

    if cells > buckets:
        dealt = dealt.mapInArrow(split, "place long, block binary")
    return dealt.sortWithinPartitions("place")


def _cells(batches: Iterator[pa.RecordBatch], unpacker, adder) -> Iterator[tuple[int, tuple]]:
    """(cell, added columns) from blocks that are sorted by cell."""
    now, parts = None, []
    for batch in batches:
        for cell, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if cell != now and parts:
                yield now, adder(*(np.concatenate(c) for c in zip(*parts)))
                parts = []
            now = cell
            parts.append(unpacker(block))
    if parts:
        yield now, adder(*(np.concatenate(c) for c in zip(*parts)))


class Writer:
    """Arrays of consecutive cells in one file, with a directory at its end."""

    def __init__(self, files: Files, kind: str):
        self.name = f"{kind}-{uuid.uuid4().hex}"
        self.out, self.at, self.rows = files.create(self.name), 0, []

    def add(self, cell: int, arrays: list[np.ndarray]) -> None:
        row = [cell]
        for a in arrays:
            data = np.ascontiguousarray(a).tobytes()
            self.out.write(data + bytes(-len(data) % 8))
            row += [self.at, len(a)]
            self.at += len(data) + -len(data) % 8
        self.rows.append(row)

    def close(self) -> tuple[str, int, int]:
        self.out.write(np.array(self.rows, np.int64).tobytes())
        self.out.close()
        return self.name, self.at, len(self.rows)


class Reader:
    """The cells' arrays of all files of one kind."""

    def __init__(self, files: Files, manifest: np.ndarray, per: int, dtypes: list):
        # manifest rows: bucket, file (as bytes), directory's offset, cells
        self.files, self.dtypes, self.per = files, dtypes, per
        self.of = {int(r["bucket"]): r for r in manifest}
        self.directories: dict[int, dict] = {}
        self.open: dict[int, list[np.ndarray] | None] = {}

    def cell(self, cell: int) -> list[np.ndarray] | None:
        if cell not in self.open:
            bucket = cell // self.per
            if bucket not in self.directories:
                r = self.of.get(bucket)
                width = 1 + 2 * len(self.dtypes)
                rows = self.files.array(r["file"].decode(), np.int64, int(r["cells"]) * width, int(r["at"])).reshape(-1, width) if r is not None else []
                self.directories[bucket] = {int(row[0]): row for row in rows}
            row = self.directories[bucket].get(cell)
            name = self.of[bucket]["file"].decode() if row is not None else ""
            self.open[cell] = None if row is None else [self.files.array(name, d, int(row[2 + 2 * i]), int(row[1 + 2 * i])) for i, d in enumerate(self.dtypes)]
        return self.open[cell]


MANIFEST = [("bucket", np.int64), ("file", "S64"), ("at", np.int64), ("cells", np.int64)]
_FILE_ROW = "bucket long, file string, at long, cells long, numbers array<bigint>"


def _file_row(bucket: int, made: tuple[str, int, int], numbers: list[int]) -> list[pa.Array]:
    name, at, cells = made
    return [pa.array([bucket], pa.int64()), pa.array([name]), pa.array([at], pa.int64()), pa.array([cells], pa.int64()), pa.array([numbers], pa.list_(pa.int64()))]


def _small(counts: np.ndarray) -> list[np.ndarray]:
    """Counts as bytes, and the positions and values of those from 255 on."""
    big = np.flatnonzero(counts >= 255)
    return [np.minimum(counts, 255).astype(np.uint8), big.astype(np.int64), counts[big].astype(np.int64)]


def _whole(small: np.ndarray, at: np.ndarray, big_at: np.ndarray, big: np.ndarray) -> np.ndarray:
    """The counts at positions."""
    out = small[at].astype(np.int64)
    wide = np.flatnonzero(out == 255)
    if len(wide):
        out[wide] = big[np.searchsorted(big_at, at[wide])]
    return out


SMALL = [np.uint8, np.int64, np.int64]


def _moments(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum, ones, twos and more of each group of counts."""
    return np.stack([np.add.reduceat(x.astype(np.int64), starts) for x in (counts, counts == 1, counts == 2, counts > 2)], 1)


def _times(counts: np.ndarray) -> list[int]:
    return [int(np.count_nonzero(counts == k)) for k in (1, 2, 3, 4)]


def _starts(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate((np.ones(min(len(sorted_values), 1), bool), sorted_values[1:] != sorted_values[:-1])))


def _within(values: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The position of wanted[i] in the sorted values[low[i]:high[i]], or -1.
    Neighbours that look in one range are searched for together if many."""
    wanted, out = wanted.astype(values.dtype), np.full(len(wanted), -1, np.int64)
    at = low.copy()
    start = _starts(low)
    end = np.append(start[1:], len(low))
    alone = np.ones(len(low), bool)
    for a, b in zip(*(x[end - start >= 32].tolist() for x in (start, end))):
        at[a:b] += np.searchsorted(values[low[a] : high[a]], wanted[a:b])
        alone[a:b] = False
    rows = np.flatnonzero(alone & (high - low > 1))
    left, right, x = low[rows], high[rows], wanted[rows]
    while len(rows):
        middle = (left + right) >> 1
        less = values[middle] < x
        left, right = np.where(less, middle + 1, left), np.where(less, right, middle)
        more = left < right
        if not more.all():
            at[rows] = left
            rows, left, right, x = rows[more], left[more], right[more], x[more]
    found = np.flatnonzero(at < high)
    hit = found[values[at[found]] == wanted[found]]
    out[hit] = at[hit]
    return out


def _member(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in sorted values, whether it is there)."""
    if not len(values):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    wanted = wanted.astype(values.dtype)  # -1 becomes a number that is no id
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    return at, values[at] == wanted


# -- the model -------------------------------------------------------------


@dataclass
class Model:
    """What workers need to score; arrays and manifests stay in files."""

    folder: str
    buckets: int
    cells: int
    tokens: int = 0
    words: int = 0
    manifest: str = ""  # the file of all manifests and of the hot words
    pairs: int = 0  # distinct bigrams
    discounts: tuple[tuple[float, float, float], ...] = ((0.5, 1.0, 1.5),) * 3  # of orders 1 to 3
    lower_counts: tuple[int, int, int] = (0, 0, 0)  # words that continue one, two, more contexts
    hot: list[int] = field(default_factory=list)

    @property
    def ranges(self) -> int:
        return min(self.buckets, 1 + self.words // WORDS_PER_RANGE)

    @property
    def ranges_hot(self) -> int:
        return -(-self.buckets // 8)

    @property
    def start(self) -> int:
        return self.words

    @property
    def none(self) -> int:
        """Stands before the start."""
        return self.words + 1


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the counts of counts 1 to 4; where
    they are undefined or out of range, 0.5, 1 and 1.5 bounded by the count."""
    out = []
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else None
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if y is not None and n[k - 1] and n[k] else None
        out.append(d if d is not None and 0 < d < k else 0.5 * k)
    return tuple(out)


def _by_hash(hashes: np.ndarray, cells: int) -> np.ndarray:
    """The cell of a hash: equal ranges of its upper 32 bits, in order."""
    return (((hashes >> HALF) * np.uint64(cells)) >> HALF).astype(np.int64)


def _by_id(ids: np.ndarray, model: Model) -> np.ndarray:
    """The cell of an id: equal ranges (ids are ranks of hashes, so even)."""
    return ids * model.cells // (model.words + 2)


def _by_mix(ids: np.ndarray, cells: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) % np.uint64(cells)).astype(np.int64)


def _place(hi: np.ndarray, w: np.ndarray, model: Model, hot: np.ndarray) -> np.ndarray:
    """The cell of a trigram (hi: v and u): by v; of a hot v, by u; of hot v
    and u, by w."""
    v, u = (hi >> HALF).astype(np.int64), hi & LOW
    out = _by_id(v, model)
    at = np.flatnonzero(_member(hot, v)[1])
    if len(at):
        both = _member(hot, u[at].astype(np.int64))[1]
        out[at] = _by_mix(np.where(both, w[at], u[at]), model.cells)
    return out


def _count_words(train: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, _ in _held(batches):
            keys, counts = summed(h)
            yield _block_rows(*_dealt((keys, counts), _by_hash(keys, buckets), pack))

    return train.mapInArrow(run, "place long, block binary")


VOCABULARY = [np.uint64, np.int64, np.int64]


def _vocabulary(train: DataFrame, model: Model) -> list:
    """Write the vocabulary: hashes, counts, and the number of words of the
    bucket before the cell."""
    per = model.cells // model.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, out, bucket = Files(model.folder), None, None
        for cell, (keys, counts) in _cells(batches, unpack, summed):
            if bucket != cell // per:
                if out is not None:
                    yield pa.record_batch(_file_row(bucket, out.close(), [words, tokens]), ["bucket", "file", "at", "cells", "numbers"])
                out, bucket, words, tokens = Writer(files, "words"), cell // per, 0, 0
            out.add(cell, [keys, counts, np.array([words], np.int64)])
            words, tokens = words + len(keys), tokens + int(counts.sum())
        if out is not None:
            yield pa.record_batch(_file_row(bucket, out.close(), [words, tokens]), ["bucket", "file", "at", "cells", "numbers"])

    blocks = _by_cell(_count_words(train, model.buckets), model.buckets, model.cells, lambda keys: _by_hash(keys, model.cells), pack, unpack, summed)
    return stored(blocks.mapInArrow(run, _FILE_ROW), "lm-words").collect()


class Vocabulary:
    """Ids and counts of word hashes."""

    def __init__(self, model: Model, files: Files, manifest: np.ndarray, starts: np.ndarray):
        self.model, self.starts = model, starts
        self.read = Reader(files, manifest, model.cells // model.buckets, VOCABULARY)

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of sorted distinct hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        place = _by_hash(hashes, self.model.cells)
        edges = np.append(_starts(place), len(place))
        per = self.model.cells // self.model.buckets
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            cell = int(place[a])
            part = self.read.cell(cell)
            if part is not None:
                keys, seen, before = part
                at, hit = _member(keys, hashes[a:b])
                ids[a:b] = np.where(hit, at + int(before[0]) + self.starts[cell // per], -1)
                counts[a:b] = np.where(hit, seen[at], 0)
        return ids, counts

    def encoded(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        distinct, back = np.unique(h, return_inverse=True)
        ids, counts = self.ids(distinct)
        return ids[back], counts[back]


def _save(files: Files, **arrays: np.ndarray) -> str:
    body, name = io.BytesIO(), f"manifest-{uuid.uuid4().hex}"
    np.savez(body, **arrays)
    files.write(name, [body.getvalue()])
    return name


def _load(files: Files, name: str) -> dict[str, np.ndarray]:
    with files.open(name) as f:
        return dict(np.load(io.BytesIO(f.read())))


def _rows(found: list) -> np.ndarray:
    return np.array([(r.bucket, r.file.encode(), r.at, r.cells) for r in sorted(found, key=lambda r: r.bucket)], MANIFEST)


def _frequent(spark, model: Model, manifest: str, limit: int) -> list[int]:
    """Ids of all words with at least `limit` tokens."""
    per = model.cells // model.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(model.folder)
        known = _load(files, manifest)
        read = Reader(files, known["words"], per, VOCABULARY)
        for batch in batches:
            for bucket in batch.column(0).to_pylist():
                for cell in range(bucket * per, (bucket + 1) * per):
                    part = read.cell(cell)
                    if part is not None:
                        yield pa.record_batch([pa.array(np.flatnonzero(part[1] >= limit) + int(part[2][0]) + known["starts"][bucket], pa.int64())], ["id"])

    return sorted(r.id for r in spark.range(model.buckets).mapInArrow(run, "id long").collect())


def _before(ids: np.ndarray, sizes: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The two ids before each token."""
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    v = np.empty_like(ids)
    v[1:] = ids[:-1]
    v[first] = model.start
    u = np.empty_like(ids)
    u[1:] = v[:-1]
    u[first] = model.none
    return v, u


def _joined(v: np.ndarray, u: np.ndarray) -> np.ndarray:
    return v.astype(np.uint64) << HALF | u.astype(np.uint64)


def _count_trigrams(train: DataFrame, model: Model) -> DataFrame:
    per = model.cells // model.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(model.folder)
        known = _load(files, model.manifest)
        vocabulary, hot = Vocabulary(model, files, known["words"], known["starts"]), np.array(model.hot, np.int64)
        for h, sizes in _held(batches):
            ids, _ = vocabulary.encoded(h)
            v, u = _before(ids, sizes, model)
            columns = summed_pairs(_joined(v, u), ids.astype(np.uint64))
            del h, u, v, ids
            yield _block_rows(*_dealt(columns, _place(*columns[:2], model, hot) // per, pack_pairs))

    return train.mapInArrow(run, "place long, block binary")


#: middle words and the start of their contexts; contexts' first words and the
#: start of their followers; followers and counts; sums of large contexts
TRIGRAMS = [np.uint32, np.int64, np.uint32, np.uint32, np.uint32, *SMALL, np.int64, np.int64]
#: first words, the start of their followers and their sums; followers and counts
PAIRS = [np.uint32, np.int64, np.int64, np.uint32, *SMALL]


def _pair_arrays(keys: np.ndarray, counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The arrays PAIRS of sorted pairs (v, w), the distinct v and their sums."""
    v = (keys >> HALF).astype(np.uint32)
    at = _starts(v)
    sums = _moments(counts, at) if len(at) else np.zeros((0, 4), np.int64)
    return [v[at], np.append(at, len(v)).astype(np.int64), sums.ravel(), (keys & LOW).astype(np.uint32), *_small(counts)], v[at], sums


_STEP_ROW = f"kind string, {_FILE_ROW}, place long, block binary"
_STEP = ["kind", "bucket", "file", "at", "cells", "numbers", "place", "block"]


def _step_rows(kind: str, places: list[int], blocks: list[bytes]) -> pa.RecordBatch:
    n = len(places)
    none = [pa.nulls(n, t) for t in (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()))]
    return pa.record_batch([pa.array([kind] * n, pa.string()), *none, pa.array(places, pa.int64()), pa.array(blocks, pa.binary())], _STEP)


def _step_numbers(kind: str, rows: np.ndarray) -> pa.RecordBatch:
    n = len(rows)
    none = [pa.nulls(n, t) for t in (pa.int64(), pa.string(), pa.int64(), pa.int64())]
    return pa.record_batch([pa.array([kind] * n, pa.string()), *none, pa.array(rows.tolist(), pa.list_(pa.int64())), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], _STEP)


def _step_file(bucket: int, out: Writer, numbers: list[int]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([out.name.split("-")[0]]), *_file_row(bucket, out.close(), numbers), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary())], _STEP)


def _write_trigrams(blocks: DataFrame, model: Model) -> DataFrame:
    """Array files of trigrams and pairs with their counts of counts; sums of
    contexts of two hot words; blocks of hot words' pairs; blocks of
    continuation counts."""
    per = model.cells // model.buckets
    hot_ids = np.array(model.hot, np.int64)

    def cell_arrays(hi: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The arrays TRIGRAMS, and (v, u, sums) of contexts of hot words."""
        at = _starts(hi)
        v, u = (hi[at] >> HALF).astype(np.int64), (hi[at] & LOW).astype(np.int64)
        ends = np.append(at, len(hi))
        sums = _moments(c, at) if len(at) else np.zeros((0, 4), np.int64)
        shared = _member(hot_ids, v)[1] & _member(hot_ids, u)[1]
        large = np.flatnonzero((np.diff(ends) > FOLLOWERS) & ~shared)
        middles = _starts(v)
        return [v[middles].astype(np.uint32), np.append(middles, len(v)).astype(np.int64), u.astype(np.uint32), ends.astype(np.uint32), w.astype(np.uint32), *_small(c), large, sums[large].ravel()], np.column_stack([v[shared], u[shared], sums[shared]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, grams, pairs, bucket = Files(model.folder), None, None, None
        for cell, (hi, w, c) in _cells(batches, unpack_pairs, summed_pairs):
            if bucket != cell // per:
                if grams is not None:
                    yield _step_file(bucket, grams, three)
                    yield _step_file(bucket, pairs, two)
                grams, pairs, bucket, three, two = Writer(files, "trigrams"), Writer(files, "pairs"), cell // per, [0] * 4, [0] * 5
            real = (hi & LOW) != np.uint64(model.none)
            arrays, shared = cell_arrays(hi[real], w[real], c[real])
            grams.add(cell, arrays)
            three = [a + b for a, b in zip(three, _times(c[real]))]
            if len(shared):
                yield _step_rows("context", *_dealt((shared,), _by_context(shared[:, 0], shared[:, 1], model), lambda rows: rows.astype(np.int64).tobytes()))
            # pairs (v, w): how many u come before; after the start, the count
            key, times = summed((hi >> HALF) << HALF | w, np.where(real, 1, c))
            is_hot = _member(hot_ids, (key >> HALF).astype(np.int64))[1]
            if is_hot.any():
                k, t = key[is_hot], times[is_hot]
                yield _step_rows("hot", *_dealt((k, t), _by_mix(k & LOW, model.ranges_hot), pack))
                key, times = key[~is_hot], times[~is_hot]
            pairs.add(cell, _pair_arrays(key, times)[0])
            two = [a + b for a, b in zip(two, [*_times(times), len(key)])]
            yield _continuations(key, model)
        if grams is not None:
            yield _step_file(bucket, grams, three)
            yield _step_file(bucket, pairs, two)

    cells = _by_cell(blocks, model.buckets, model.cells, lambda hi, w: _place(hi, w, model, hot_ids), pack_pairs, unpack_pairs, summed_pairs)
    return cells.mapInArrow(run, _STEP_ROW)


def _continuations(key: np.ndarray, model: Model) -> pa.RecordBatch:
    word, times = summed(key & LOW)
    return _step_rows("next", *_dealt((word, times), _by_range(word, model), pack))


def _by_range(ids: np.ndarray, model: Model) -> np.ndarray:
    """The range of an id, among as many as the vocabulary needs: each cell
    sends a block to each range."""
    return ids.astype(np.int64) * model.ranges // (model.words + 2)


def _write_hot_pairs(blocks: DataFrame, model: Model) -> DataFrame:
    """The pairs of hot words, as _write_trigrams writes the others, and the
    words' sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, out, bucket = Files(model.folder), None, None
        for cell, (key, times) in _cells(batches, unpack, summed):
            if bucket != cell:
                if out is not None:
                    yield _step_file(bucket, out, two)
                out, bucket, two = Writer(files, "often"), cell, [0] * 5
            arrays, words, sums = _pair_arrays(key, times)
            out.add(cell, arrays)
            two = [a + b for a, b in zip(two, [*_times(times), len(key)])]
            yield _step_numbers("sums", np.column_stack([words.astype(np.int64), sums]))
            yield _continuations(key, model)
        if out is not None:
            yield _step_file(bucket, out, two)

    n = model.ranges_hot
    cells = _by_cell(blocks, n, n, None, pack, unpack, summed)
    return cells.mapInArrow(run, _STEP_ROW)


CONTINUATIONS = [np.uint32, *SMALL]


def _write_continuations(blocks: DataFrame, model: Model) -> list:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, out, bucket = Files(model.folder), None, None
        for cell, (word, times) in _cells(batches, unpack, summed):
            if bucket != cell:
                if out is not None:
                    yield _step_file(bucket, out, one)
                out, bucket, one = Writer(files, "next"), cell, [0] * 5
            out.add(cell, [word.astype(np.uint32), *_small(times)])
            one = [a + b for a, b in zip(one, [*_times(times), len(word)])]
        if out is not None:
            yield _step_file(bucket, out, one)

    cells = _by_cell(blocks, model.ranges, model.ranges, None, pack, unpack, summed)
    return stored(cells.mapInArrow(run, _STEP_ROW), "lm-continuations").collect()


CONTEXTS = [np.uint64, np.int64]


def _by_context(v: np.ndarray, u: np.ndarray, model: Model) -> np.ndarray:
    return (v * 31 + u) % model.ranges_hot


def _context_rows(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(block, np.int64).reshape(-1, 6)
    return _joined(rows[:, 0], rows[:, 1]), rows[:, 2:]


def _write_contexts(blocks: DataFrame, model: Model) -> list:
    """Sums of the contexts of two hot words: keys (v, u) and four sums."""

    def added(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        first = _starts(keys[order])
        return keys[order][first], np.add.reduceat(sums[order], first, axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, (keys, sums) in _cells(batches, _context_rows, added):
            out = Writer(Files(model.folder), "contexts")
            out.add(cell, [keys, sums.ravel()])
            yield _step_file(cell, out, [])

    n = model.ranges_hot
    return stored(_by_cell(blocks, n, n, None, None, _context_rows, added).mapInArrow(run, _STEP_ROW), "lm-contexts").collect()


def fit(docs: DataFrame, train: Column, text_col: str = "text") -> Model:
    """Learn from the rows of docs for which train holds."""
    spark = docs.sparkSession
    prepare(spark)
    folder = shared_folder(spark, "lm")
    rows = docs.where(train).select(F.col(text_col).cast("string").alias("text"))
    size = docs.where(train).agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0)), F.count("*")).first()
    wanted = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), (size[0] // 6 + size[1]) // TOKENS_PER_TASK)
    buckets = min(wanted, MAX_BUCKETS)
    model = Model(folder, buckets, buckets * -(-wanted // buckets))
    files = Files(folder)
    words = sorted(_vocabulary(rows, model), key=lambda r: r.bucket)
    model.words, model.tokens = sum(r.numbers[0] for r in words), sum(r.numbers[1] for r in words)
    if not model.tokens:
        return model
    if model.words > MAX_WORDS:
        raise OverflowError(f"{model.words} distinct words: ids have 32 bits")
    per_bucket = np.zeros(buckets, np.int64)
    per_bucket[[r.bucket for r in words]] = [r.numbers[0] for r in words]
    known = {"words": _rows(words), "starts": np.concatenate(([0], np.cumsum(per_bucket)))}
    model.manifest = _save(files, **known)
    limit = model.tokens // (2 * model.cells) + 1
    model.hot = _frequent(spark, model, model.manifest, limit) + ([model.start, model.none] if size[1] >= limit else [])
    out = stored(_write_trigrams(_count_trigrams(rows, model), model), "lm-trigrams")
    made = out.where("kind in ('trigrams', 'pairs')").select("kind", "bucket", "file", "at", "cells", "numbers").collect()
    three, two = [r for r in made if r.kind == "trigrams"], [r for r in made if r.kind == "pairs"]
    often, nexts, contexts = [], out.where("kind = 'next'").select("place", "block"), []
    sums: dict[int, tuple] = {}
    if model.hot:
        again = stored(_write_hot_pairs(out.where("kind = 'hot'").select("place", "block"), model), "lm-often")
        often = again.where("kind = 'often'").select("bucket", "file", "at", "cells", "numbers").collect()
        n = [F.get("numbers", F.lit(i)) for i in range(5)]
        sums = {r.id: tuple(r)[1:] for r in again.where("kind = 'sums'").groupBy(n[0].alias("id")).agg(*(F.sum(n[i]).alias(f"n{i}") for i in (1, 2, 3, 4))).collect()}
        nexts = nexts.unionByName(again.where("kind = 'next'").select("place", "block"))
        contexts = _write_contexts(out.where("kind = 'context'").select("place", "block"), model)
    one = _write_continuations(nexts, model)
    model.pairs = sum(r.numbers[4] for r in two + often)
    times = [[sum(r.numbers[k] for r in of) for k in range(4)] for of in (one, two + often, three)]
    model.discounts = tuple(discounts(n) for n in times)
    model.lower_counts = (times[0][0], times[0][1], sum(r.numbers[4] for r in one) - times[0][0] - times[0][1])
    hot = np.array(sorted(sums), np.int64)
    model.manifest = _save(files, **known, trigrams=_rows(three), pairs=_rows(two), often=_rows(often), next=_rows(one), contexts=_rows(contexts), hot=hot, hot_sums=np.array([sums[i] for i in hot.tolist()], np.int64).reshape(-1, 4))
    return model


class Scorer:
    """Scores runs of tokens with the mapped arrays of a model."""

    def __init__(self, model: Model):
        self.model, files = model, Files(model.folder)
        self.known = _load(files, model.manifest) if model.manifest else {}
        if not self.known:
            return
        per = model.cells // model.buckets
        get = lambda name, dtypes, per=per: Reader(files, self.known[name], per, dtypes)
        self.vocabulary = Vocabulary(model, files, self.known["words"], self.known["starts"])
        self.trigrams, self.pairs, self.often, self.next = get("trigrams", TRIGRAMS), get("pairs", PAIRS), get("often", PAIRS, 1), get("next", CONTINUATIONS, 1)
        self.contexts = get("contexts", CONTEXTS, 1)
        self.hot = np.array(model.hot, np.int64)

    @staticmethod
    def _groups(cells: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(cells, kind="stable")
        edges = np.append(_starts(cells[order]), len(cells))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            yield int(cells[order[a]]), order[a:b]

    def _discounted(self, order: int, counts: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(discounted share, weight of the lower order)."""
        d = np.array([0.0, *self.model.discounts[order - 1]])
        seen = sums[:, 0] > 0
        total = np.where(seen, sums[:, 0], 1)
        share = np.where(seen, (counts - d[np.minimum(counts, 3)]) / total, 0.0)
        return share, np.where(seen, (sums[:, 1:] * d[1:]).sum(axis=1) / total, 1.0)

    def lower(self, ids: np.ndarray) -> np.ndarray:
        """p1 of distinct sorted ids (-1: unknown)."""
        m = self.model
        times = np.zeros(len(ids), np.int64)
        known = np.flatnonzero(ids >= 0)
        for cell, of in self._groups(_by_range(ids[known], m)):
            part = self.next.cell(cell)
            if part is not None:
                at, hit = _member(part[0], ids[known[of]])
                times[known[of]] = np.where(hit, _whole(part[1], at, *part[2:]), 0)
        d = np.array([0, *m.discounts[0]])
        held = sum(x * n for x, n in zip(m.discounts[0], m.lower_counts))
        return (times - d[np.minimum(times, 3)]) / m.pairs + held / m.pairs / (m.words + 1)

    def pair(self, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(discounted share, weight of p1) of pairs; -1: unknown."""
        m = self.model
        counts, sums = np.zeros(len(v), np.int64), np.zeros((len(v), 4), np.int64)
        known = np.flatnonzero(v >= 0)
        at, is_hot = _member(self.hot, v[known])
        at, listed = _member(self.known["hot"], v[known])
        sums[known[listed]] = self.known["hot_sums"][at[listed]]
        for read, these, cell_of in ((self.pairs, known[~is_hot], lambda i: _by_id(v[i], m)), (self.often, known[is_hot & (w[known] >= 0)], lambda i: _by_mix(w[i], m.ranges_hot))):
            for cell, of in self._groups(cell_of(these)):
                part = read.cell(cell)
                if part is None:
                    continue
                of = these[of]
                words, start, word_sums, follow, *small = part
                at, hit = _member(words, v[of])
                of, at = of[hit], at[hit]
                if read is self.pairs:
                    sums[of] = word_sums.reshape(-1, 4)[at]
                found = _within(follow, start[at], start[at + 1], w[of])
                counts[of[found >= 0]] = _whole(small[0], found[found >= 0], *small[1:])
        return self._discounted(2, counts, sums)

    def trigram(self, hi: np.ndarray, w: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(discounted share, weight of p2) of trigrams with hi (v and u); not
        ok: a context of unknown words or none."""
        m = self.model
        counts, sums = np.zeros(len(hi), np.int64), np.zeros((len(hi), 4), np.int64)
        known = np.flatnonzero(ok)
        h = hi[known]
        v, u = (h >> HALF).astype(np.int64), (h & LOW).astype(np.int64)
        shared = _member(self.hot, v)[1] & _member(self.hot, u)[1]
        if shared.any():
            keys, back = np.unique(h[shared], return_inverse=True)
            sums[known[shared]] = self._context_sums(keys)[back]
        cells = _place(h, np.maximum(w[known], 0).astype(np.uint64), m, self.hot)
        for cell, of in self._groups(cells):
            part = self.trigrams.cell(cell)
            if part is None:
                continue
            middles, first, firsts, start, follow, small, big_at, big, large, large_sums = part
            at, hit = _member(middles, v[of])
            of, at = of[hit], at[hit]
            context = _within(firsts, first[at], first[at + 1], u[of])
            of, context = of[context >= 0], context[context >= 0]
            low, high = start[context].astype(np.int64), start[context + 1].astype(np.int64)
            found = _within(follow, low, high, w[known[of]])
            counts[known[of[found >= 0]]] = _whole(small, found[found >= 0], big_at, big)
            own = ~shared[of]
            many = own & (high - low > FOLLOWERS)
            sums[known[of[many]]] = large_sums.reshape(-1, 4)[np.searchsorted(large, context[many])]
            few = np.flatnonzero(own & ~many)
            total = np.zeros((len(few), 4), np.int64)
            for i in range(FOLLOWERS):
                more = np.flatnonzero(low[few] + i < high[few])
                c = _whole(small, low[few[more]] + i, big_at, big)
                total[more] += np.stack([c, c == 1, c == 2, c > 2], 1)
            sums[known[of[few]]] = total
        return self._discounted(3, counts, sums)

    def _context_sums(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros((len(keys), 4), np.int64)
        for cell, of in self._groups(_by_context((keys >> HALF).astype(np.int64), (keys & LOW).astype(np.int64), self.model)):
            part = self.contexts.cell(cell)
            if part is not None:
                at, hit = _member(part[0], keys[of])
                out[of[hit]] = part[1].reshape(-1, 4)[at[hit]]
        return out

    def score(self, h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, base score and model score of each text."""
        m = self.model
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        if not self.known:
            return np.zeros(len(sizes), np.int64), np.zeros(len(sizes)), np.zeros(len(sizes))
        ids, counts = self.vocabulary.encoded(h)
        v, u = _before(ids, sizes, m)
        # distinct (v, u, w), moved up by one so that -1 can be packed
        hi, w, _, back = summed_pairs(_joined(v + 1, u + 1), (ids + 1).astype(np.uint64), inverse=True)
        v, u, w = (hi >> HALF).astype(np.int64) - 1, (hi & LOW).astype(np.int64) - 1, w.astype(np.int64) - 1
        pair, pair_back = np.unique(_joined(v + 1, w + 1), return_inverse=True)
        words, word_back = np.unique((pair & LOW).astype(np.int64) - 1, return_inverse=True)
        share, weight = self.pair((pair >> HALF).astype(np.int64) - 1, (pair & LOW).astype(np.int64) - 1)
        two = share + weight * self.lower(words)[word_back]
        ok = (v >= 0) & (u >= 0) & (u != m.none)
        share, weight = self.trigram(_joined(np.maximum(v, 0), np.maximum(u, 0)), w, ok)
        logs = np.log10(share + weight * two[pair_back])[back]
        base = np.log10((counts + 1) / (m.tokens + m.words + 1))
        return np.add.reduceat((counts > 0).astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(logs, first)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score (log10 of the whole text's
    probability) and perplexity of every row of docs."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            # texts of a batch together: distinct trigrams are looked up once
            runs = list(_runs(batch.column(1)))
            sizes = np.concatenate([c for _, c in runs])
            known, base, total = scorer.score(np.concatenate([h for h, _ in runs]), sizes)
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(known), pa.array(base), pa.array(total), pa.array(10 ** np.minimum(-total / sizes, 300))], ["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double")
