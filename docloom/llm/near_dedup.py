"""MinHash near-dedup with odd sketches: links of shingle sets, components.

1. Sketch: a text's word shingles are hashed (64 bits); SAMPLES min-wise
   samples are drawn. Groups of ROWS samples are hashed into BANDS band keys.
   All samples are folded into an odd sketch: sample i with value v flips one
   bit of a bitmap, so that the XOR of two bitmaps has about as many ones as
   the sample sets differ in, which tells high similarities apart precisely.
2. Copies: documents with the same shingle set form one class; its smallest
   id stands for it from here on.
3. Candidates: within each bucket of classes that share a band key, sizes and
   odd sketches rule pairs out. The bucket's first class is compared with all,
   then each class that is not connected to it; what remains is a spanning
   forest of the bucket. Components over the buckets' forests are the candidate
   groups. A bucket of many classes is cut into chunks that meet pairwise.
4. Links: each candidate group is compared within. A pair whose sizes allow the
   threshold and whose odd sketches do not rule it out is confirmed on the full
   sets, unless confirmed links already connect it. A group of more than
   CHUNK_BYTES is compared with its head first, in chunks; then the classes
   that are not linked to the head are compared with the whole group, chunk by
   chunk. A block returns the links of a spanning forest only.
5. Components over the confirmed links give each document's class.

Chance: with 40 bands of 6 samples a link at similarity 0.85 is missed with a
probability of 6e-9 (0.80: 6e-6), and the sketch margin lies more than six
standard deviations off. No bucket, partner or candidate is capped.

Scale: texts are read twice, once for sketches and once for the sets of
classes that have candidates at all. No text is shuffled: the second pass
leaves out other texts by a bitmap of fixed size (8 MB; those that it lets
through leave at the join), and what moves on are sets of candidates (8 bytes
a shingle) and, in buckets of two and more, sketches (128 bytes). Group tables
meet their rows by with_group, which broadcasts a bounded number of hot keys.

Defined cases: a text with fewer words than a shingle is one shingle of all
its words; without words (or null) it has no shingles, links with nothing and
is its own component. A null id is kept as null, is its own component and is
never linked. Rows that share an id are one node (linked by any of their
texts). Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bitmap, buffers, fresh, in_arrow, in_bitmap, mix, prepare, stored, with_group, word_hashes
from .components import components

BANDS, ROWS = 40, 6
SAMPLES = BANDS * ROWS
SKETCH_BITS = 1024
#: An estimate this far below the threshold still goes to the full sets.
MARGIN = 0.20
#: Bytes of shingle sets that one chunk of a group holds (one larger set extends it).
CHUNK_BYTES = 1 << 20
#: Classes of a band's bucket that one block compares, twice.
BAND_ROWS = 4096


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text in a run of word hashes."""
    ends = np.cumsum(counts)
    wide = np.zeros(len(hashes), np.uint64)
    n = len(hashes) - size + 1
    if n > 0:
        for k in range(size):
            wide[:n] = wide[:n] * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
        wide = mix(wide)
    for end, count in zip(ends.tolist(), counts.tolist()):
        start = end - count
        if count >= size:
            yield np.unique(wide[start : end - size + 1])
        elif count:
            short = np.array([count], np.uint64)
            for k in range(start, end):
                short = short * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[k : k + 1]
            yield mix(short)
        else:
            yield np.empty(0, np.uint64)


def _families() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(987654321)
    return rng.integers(0, 2**32, SAMPLES, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, SAMPLES, dtype=np.uint32)


def samples(shingle_set: np.ndarray) -> np.ndarray:
    """The SAMPLES min-wise samples of a non-empty set."""
    a, b = _families()
    return _samples(shingle_set, a[:, None], b[:, None])


def _samples(shingle_set: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (shingle_set >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 2**32 - 1, np.uint32)
    for i in range(0, len(h), 512):  # stays in the processor's cache
        part = h[None, i : i + 512] * a
        part += b
        np.minimum(least, part.min(axis=1), out=least)
    return least


def odd_sketch(sample: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """The parity bitmap of the set of (position, sample)."""
    at = mix(sample.astype(np.uint64) + (np.arange(len(sample), dtype=np.uint64) << np.uint64(32))) % np.uint64(bits)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=bits) & 1 == 1)


def estimate(ones: np.ndarray | float, n_samples: int = SAMPLES, bits: int = SKETCH_BITS) -> np.ndarray:
    """The similarity that the number of ones in two bitmaps' XOR tells."""
    share = np.minimum(2 * np.asarray(ones, np.float64) / bits, 1 - 1e-9)
    return 1 + bits / (4 * n_samples) * np.log1p(-share)


def _band_keys(sample: np.ndarray) -> np.ndarray:
    rows = sample.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for k in range(ROWS):
        key = key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k]
    return mix(key)


def _sketch(size: int):
    import hashlib

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (x[:, None] for x in _families())
        n, digests, bands, odd = [], [], [], []
        for run, counts in word_hashes(*buffers(batch.column(1))):
            for s in shingles(run, counts, size):
                n.append(len(s))
                if not len(s):
                    digests.append(b""), bands.append([]), odd.append(b"")
                    continue
                drawn = _samples(s, a, b)
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                bands.append(_band_keys(drawn).view(np.int64))
                odd.append(odd_sketch(drawn).tobytes())
        return pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(odd, pa.binary())], ["doc", "n", "digest", "bands", "odd"])

    return step


def _near_links(docs: np.ndarray, bounds: np.ndarray, sizes: np.ndarray, words: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """For each block of rows (bounds: where blocks start, and the end) a
    spanning forest of the pairs that sizes and sketches let pass. The first
    row is compared with all; then each row that is not connected to it."""
    floor = percent / 100 - MARGIN

    def near(of: np.ndarray | int, among: slice) -> np.ndarray:
        fits = 100 * np.minimum(sizes[of], sizes[among]) >= percent * np.maximum(sizes[of], sizes[among])
        return fits & (estimate(np.bitwise_count(words[among] ^ words[of]).sum(axis=-1)) >= floor)

    counts = np.diff(bounds)
    first = np.repeat(bounds[:-1], counts)
    to_first = near(first, slice(0, len(docs)))
    own = np.arange(len(docs)) == first
    links = list(zip(docs[to_first & ~own].tolist(), docs[first[to_first & ~own]].tolist()))
    missing = np.add.reduceat((~to_first).astype(np.int64), bounds[:-1]) if len(docs) else np.empty(0, np.int64)
    for k in np.flatnonzero((missing > 0) & (counts > 2)).tolist():
        a, b = int(bounds[k]), int(bounds[k + 1])
        label = np.where(to_first[a:b], 0, np.arange(b - a))
        for i in np.flatnonzero(~to_first[a:b]).tolist():
            found = np.flatnonzero(near(a + i, slice(a, b)) & (label != label[i]))
            for j in found.tolist():
                if label[j] != label[i]:
                    links.append((int(docs[a + i]), int(docs[a + j])))
                    label[label == label[i]] = label[j]
    return links


def _near_blocks(percent: int):
    """Over rows sorted by block: the links of each block's spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def linked(table: pa.Table) -> pa.RecordBatch:
            block = np.stack([table.column(c).to_numpy() for c in ("band", "a", "b")], 1)
            bounds = np.concatenate(([0], np.flatnonzero((block[1:] != block[:-1]).any(axis=1)) + 1, [len(block)]))
            odd = np.frombuffer(b"".join(table.column("odd").to_pylist()), np.uint64).reshape(len(block), -1)
            links = _near_links(table.column("doc").to_numpy(), bounds, table.column("n").to_numpy(), odd, percent)
            return pa.record_batch([pa.array([u for u, _ in links], pa.int64()), pa.array([v for _, v in links], pa.int64())], ["u", "v"])

        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            # all but the last block, which the next batch may go on with
            last = [held.column(c)[-1].as_py() for c in ("band", "a", "b")]
            whole = held.num_rows
            while whole and [held.column(c)[whole - 1].as_py() for c in ("band", "a", "b")] == last:
                whole -= 1
            if whole:
                yield linked(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield linked(held)

    return run


def _candidates(classes: DataFrame, percent: int) -> DataFrame:
    """Links u, v that connect the classes of each candidate group."""
    spark = classes.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bands = classes.select(F.explode("bands").alias("band"), "doc")
    shared = stored(bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "near-bands")
    rows = with_group(bands, shared, "band", classes.count() * BANDS)
    chunks = F.ceil(F.col("n") / BAND_ROWS).cast("long")
    rows = rows.select("band", "doc", chunks.alias("chunks"), F.pmod(F.xxhash64("doc"), chunks).alias("chunk"))
    # a chunk meets every other one; each block compares all its rows
    other = F.explode(F.when(F.col("chunks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.array_remove(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), F.col("chunk")))).alias("other")
    rows = rows.select("band", "doc", "chunk", other).select("band", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "doc")
    rows = rows.join(classes.select("doc", "n", "odd"), "doc")
    dealt = rows.select("band", "a", "b", "doc", "n", "odd").repartition(tasks, "band", "a", "b").sortWithinPartitions("band", "a", "b", "doc")
    return components(dealt.mapInArrow(_near_blocks(percent), "u long, v long"))


def _links_of_block(docs: list[int], sets: list[np.ndarray], odd: np.ndarray, sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of a block. sides: 0 for the rows of a
    chunk alone; 1 and 2 for those of two chunks, compared across only."""
    n = len(docs)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[i]) for i in order])
    words, side = odd[order].view(np.uint64), sides[order]
    floor = percent / 100 - MARGIN
    links = []

    def linked(i: int, j: int) -> None:
        x, y = sets[i], sets[j]
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        both = int(np.count_nonzero(y[at] == x))
        if 100 * both >= percent * (len(x) + len(y) - both):
            root[find(i)] = find(j)
            links.append((docs[i], docs[j]))

    def near(k: int, first: int, last: int) -> np.ndarray:
        out = estimate(np.bitwise_count(words[first:last] ^ words[k]).sum(axis=1))
        if side[k]:
            out[side[first:last] == side[k]] = -1
        return out

    # each row with its most similar one: this connects most of a group
    low = np.searchsorted(sizes, sizes * percent / 100 - 1e-9, "left")
    high = np.searchsorted(sizes, sizes * 100 / percent + 1e-9, "right")
    for k in range(n):
        if high[k] - low[k] > 1:
            found = near(k, low[k], high[k])
            found[k - low[k]] = -1
            best = int(found.argmax())
            i, j = int(order[k]), int(order[low[k] + best])
            if found[best] >= floor and find(i) != find(j):
                linked(i, j)
    # then every pair that is not connected yet
    label = np.array([find(int(i)) for i in order])
    for k in range(n):
        if high[k] > k + 1:
            apart = np.flatnonzero(label[k + 1 : high[k]] != label[k])
            if len(apart):
                found = near(k, k + 1, high[k])[apart]
                for at in np.argsort(-found, kind="stable"):
                    if found[at] < floor:
                        break
                    i, j = int(order[k]), int(order[k + 1 + apart[at]])
                    if find(i) != find(j):
                        linked(i, j)
    return links


def _confirm(percent: int):
    def run(table: pa.Table) -> pa.Table:
        docs = table.column("doc").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        odd = np.frombuffer(b"".join(table.column("odd").to_pylist()), np.uint8).reshape(len(docs), -1)
        links = _links_of_block(docs, sets, odd, table.column("side").to_numpy(), percent)
        return pa.table({"u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([y for _, y in links], pa.int64())})

    return run


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.
    Sets link when 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    drawn = stored(in_arrow(rows, _sketch(shingle), "doc long, n long, digest binary, bands array<bigint>, odd binary"), "near-sketches")
    real = drawn.where("n > 0 and doc is not null")
    # classes of equal sets; the sketches of equal sets are equal
    classes = stored(real.groupBy("digest").agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("odd").alias("odd")), "near-classes")
    groups = _candidates(classes, percent)
    links = _confirmed(rows, classes, groups, shingle, percent, chunk_bytes)
    # an id that stands for several sets, or is in several classes, joins them
    members = real.select("doc", "digest").join(classes.select("digest", F.col("doc").alias("head")), "digest").where("doc != head").select(F.col("doc").alias("u"), F.col("head").alias("v"))
    found = components(links.unionByName(members))
    out = drawn.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles")).join(found, F.col("doc_id") == F.col("node"), "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _confirmed(rows: DataFrame, classes: DataFrame, groups: DataFrame, shingle: int, percent: int, chunk_bytes: int) -> DataFrame:
    """The links u, v within the candidate groups, from blocks of their sets."""
    sized = groups.join(classes.select(F.col("doc").alias("node"), F.col("digest").alias("own"), "odd"), "node")
    wanted = bitmap(groups.select(F.col("node").cast("string").cast("binary")))
    found = in_arrow(rows, _sets_of(shingle, wanted), "doc long, digest binary, shingles binary")
    if rows.groupBy("doc").count().where("count > 1").limit(1).count():  # rows with one id and set count once
        found = found.dropDuplicates(["doc", "digest"])
    sets = found.join(sized, (F.col("doc") == F.col("node")) & (F.col("digest") == F.col("own"))).select("doc", "component", "shingles", "odd")
    sets = stored(sets, "near-sets")
    size = F.octet_length("shingles") + 256
    sums = stored(sets.groupBy("component").agg(F.count("*").alias("n"), F.ceil(F.sum(size) / chunk_bytes).cast("int").alias("chunks")), "near-groups")
    placed = with_group(sets, sums, "component", sets.count())
    linked = lambda of, *block: of.groupBy(*block).applyInArrow(_confirm(percent), "u long, v long")
    columns = ["doc", "component", "shingles", "odd", "side"]
    links = linked(placed.where("chunks = 1").withColumn("side", F.lit(0)).select(*columns), "component")
    if not sums.where("chunks > 1").limit(1).count():
        return links
    # larger groups: all against the group's head, then those that are not
    # linked to it against all
    dealt = lambda n: F.pmod(F.xxhash64("doc", "shingles"), F.col(n)).cast("int")
    upto = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    large = placed.where("chunks > 1").withColumn("chunk", dealt("chunks"))
    heads = large.where("doc = component").withColumn("side", F.lit(1)).select(*columns, upto("chunks", "chunk"))
    others = large.where("doc != component").withColumn("side", F.lit(2)).select(*columns, "chunk")
    star = stored(linked(heads.unionByName(others), "component", "chunk"), "near-star")
    reached = star.select(F.explode(F.array("u", "v")).alias("doc")).distinct()
    rest = large.where("doc != component").join(reached, "doc", "left_anti")
    left = stored(rest.groupBy("component").agg(F.ceil(F.sum(size) / chunk_bytes).cast("int").alias("parts"), F.count("*").alias("m")), "near-rest")
    total = sets.count()
    mine = with_group(rest.drop("n"), left.withColumnRenamed("m", "n"), "component", total).withColumn("part", dealt("parts")).withColumn("side", F.lit(1))
    whole = with_group(large.drop("n"), sums.select("component", "n").join(left.select("component", "parts"), "component"), "component", total).withColumn("side", F.lit(2))
    met = mine.select(*columns, "part", upto("chunks", "chunk")).unionByName(whole.select(*columns, "chunk", upto("parts", "part")).select(*columns, "part", "chunk"))
    return links.unionByName(star).unionByName(linked(met, "component", "part", "chunk"))


def _sets_of(size: int, wanted: np.ndarray):
    import hashlib

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Sets of the texts whose id is in a bitmap, with their digests."""
        batch = batch.filter(pa.array(in_bitmap(wanted, [str(i).encode() for i in batch.column(0).to_pylist()])))
        sets = [s for run, counts in word_hashes(*buffers(batch.column(1))) for s in shingles(run, counts, size)]
        return pa.record_batch([batch.column(0), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc", "digest", "shingles"])

    return step


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component, the one with the smallest
    id; rows that share an id count as one document, of which the row with the
    greatest text stays. Rows without an id stay."""
    found = near_components(docs, id_col, text_col, shingle, percent)
    dropped, repeated = fresh(docs.columns, "dropped"), fresh(docs.columns, "repeated")
    doc = F.col(id_col).cast("long")
    gone = found.where("not kept").select(F.col("doc_id").alias(dropped)).distinct()
    left = docs.join(gone, doc == gone[dropped], "left_anti")
    many = found.where("doc_id is not null").groupBy(F.col("doc_id").alias(repeated)).count().where("count > 1").select(repeated)
    if not many.limit(1).count():
        return left
    once = left.join(many, doc == many[repeated], "left_anti")
    again = left.join(many, doc == many[repeated], "left_semi")
    best = again.groupBy(doc.alias(repeated)).agg(F.max_by(F.struct(*again.columns), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("row_"))
    return once.unionByName(best.select("row_.*"))
