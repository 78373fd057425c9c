"""Small fixtures for every operator: nulls, empty and long texts, ties and
repeated rows, empty tables, clashing column names; brute force or round trips
where SQL cannot say it."""

import collections
import hashlib
import io
import json
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from oracle import SF, compare
from pyspark.sql import functions as F

from docloom.llm import _common, bpe, components, exact_dedup, line_dedup, lm_scoring, near_dedup, packing, quality_classifier, quality_rules, queries, sharding, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size string, shard int, body string"
LONG = "word " * 300_000  # longer than a segment


def docs(spark, texts, ids=None):
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), True, "x", 9, "b") for i, t in zip(ids, texts)], SCHEMA)


ODD = [None, "", " \t\n", "one", "a b c d e f g", "A B C D E F G", LONG, "ÀÉ ü\x0bß 日本 🙂", "x\n\nx\nlong enough line\n", "long enough line"]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD + ["repeated row of text"] * 2, [*range(len(ODD)), 50, 50]).unionByName(docs(spark, ["no id", "no id"], [None, None])).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


# -- shared helpers --------------------------------------------------------


def test_word_hashes_agree_with_split():
    texts = [t or "" for t in ODD] + ["a" * 3_000_000 + " b", " " * 2_000_000]
    sizes, seen = [], {}
    runs = list(_common.word_hashes(*_common.buffers(pa.array(texts))))
    hashes = np.concatenate([h for h, _ in runs])
    for _, c in runs:
        sizes += c.tolist()
    words = [re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()) for t in texts]
    assert sizes == [len(w) for w in words]
    for w, h in zip((x for ws in words for x in ws), hashes.tolist()):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_pack_round_trip():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64))
    counts = np.random.default_rng(2).integers(1, 1000, len(keys))
    k, c = _common.unpack(_common.pack(keys, counts))
    assert (k == keys).all() and (c == counts).all()


# -- SQL -------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, queries.QUERIES[name], queries.SQL[name]) > 0


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_returns_a_row_per_document(spark, name):
    rows = queries.QUERIES[name](spark, SF).select("doc_id").collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())


# -- 1 ---------------------------------------------------------------------


def test_line_dedup(odd, empty):
    rows = {(r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(odd).collect()}
    assert (0, "", 1, 0) in rows and (1, "", 1, 0) in rows
    assert (8, "x\n\nx\nlong enough line\n", 5, 0) in rows  # the smallest id keeps it
    assert (9, "", 1, 1) in rows
    assert (50, "repeated row of text", 1, 0) in rows  # one document, twice
    out = line_dedup.dedup_lines(odd)
    assert out.columns == [*odd.columns, "kept_text", "n_lines", "n_dropped"] and out.count() == odd.count()
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_keeps_a_line_of_the_greatest_id_apart_from_rows_without_id(spark):
    top = (1 << 63) - 1
    d = spark.createDataFrame([(top, "a line that is shared\nx"), (None, "a line that is shared\ny"), (None, "only without an id"), (None, "only without an id")], "doc_id long, text string").withColumn("kept_text", F.lit("own"))
    rows = line_dedup.dedup_lines(d)
    assert rows.columns == ["doc_id", "text", "kept_text", "n_lines", "n_dropped"]
    assert sorted((r.doc_id is None, r.kept_text) for r in rows.collect()) == [(False, "a line that is shared\nx"), (True, "only without an id"), (True, "only without an id"), (True, "y")]


def test_line_dedup_threshold_and_hot_line(spark):
    d = docs(spark, [f"the very same line\nown line number {i}" for i in range(200)])
    got = line_dedup.dedup_lines(d).select("n_dropped").groupBy("n_dropped").count().collect()
    assert {r[0]: r[1] for r in got} == {0: 1, 1: 199}
    assert line_dedup.dedup_lines(d, min_docs=201).where("n_dropped > 0").count() == 0


# -- 2 ---------------------------------------------------------------------


def brute_components(texts, size, percent):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and sets[i] and sets[j] and 100 * min(len(sets[i]), len(sets[j])) >= percent * max(len(sets[i]), len(sets[j])) and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in texts}


def near_texts(n, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts = [t for t in ODD]
    for _ in range(n):
        base = [word() for _ in range(rng.choice([4, 12, 60, 200]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = [word() if rng.random() < rng.choice([0, 0.01, 0.05, 0.2]) else w for w in base]
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("size, percent, band_rows", [(3, 85, 4096), (5, 80, 4096), (5, 80, 2)])
def test_near_components_equal_brute_force(spark, monkeypatch, size, percent, band_rows):
    monkeypatch.setattr(near_dedup, "BAND_ROWS", band_rows)
    texts = near_texts(60)
    want = brute_components(dict(enumerate(texts)), size, percent)
    for chunk in (near_dedup.CHUNK_BYTES, 3000):  # whole groups, and groups cut into chunks
        rows = near_dedup.near_components(docs(spark, texts), shingle=size, percent=percent, chunk_bytes=chunk).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_components_of_a_large_group(spark):
    """A chain of copies of copies, most of which are far from the head."""
    rng = random.Random(7)
    words, texts = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(200)], []
    for i in range(120):
        words[(i * 7) % 200] = f"changed{i}"
        texts.append(" ".join(words))
    want = brute_components(dict(enumerate(texts)), 3, 85)
    for chunk in (20_000, near_dedup.CHUNK_BYTES):
        rows = near_dedup.near_components(docs(spark, texts), shingle=3, percent=85, chunk_bytes=chunk).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want


def test_near_query_equals_brute_force_on_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    want = brute_components({r.doc_id: r.text for r in rows}, 3, 85)
    got = queries.op2_minhash_near_dedup(spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_near_components_of_odd_rows(odd, empty):
    rows = near_dedup.near_components(odd).collect()
    assert len(rows) == odd.count()
    assert [r.component_id for r in rows if r.doc_id == 50] == [50, 50]
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert near_dedup.near_components(empty).count() == 0
    kept = near_dedup.drop_near_copies(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 50").count() == 1 and kept.where("doc_id is null").count() == 2


def test_odd_sketch_tells_high_similarities():
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 2**64, 2000, dtype=np.uint64))
    for share in (0.8, 0.9, 0.95):
        b = np.unique(np.concatenate([a[: int(2 * share / (1 + share) * len(a))], rng.integers(0, 2**64, int(len(a) * (1 - 2 * share / (1 + share))), dtype=np.uint64)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = (near_dedup.odd_sketch(near_dedup.samples(s)) for s in (a, b))
        assert abs(near_dedup.estimate(np.bitwise_count(x ^ y).sum()) - true) < 0.1


def test_components_of_odd_links(spark):
    edges = spark.createDataFrame([(None, 1), (2, None), (3, 3), (5, 4), (4, 5), (5, 4)], "u long, v long").withColumn("node", F.lit("x"))
    for finish in (None, 0):
        assert {(r.node, r.component) for r in components.components(edges, finish=finish).collect()} == {(4, 4), (5, 4)}
        assert components.components(edges.limit(0), finish=finish).count() == 0


@pytest.mark.parametrize("finish", [None, 0, 150])
def test_components_of_a_path_and_a_star(spark, finish):
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long"), finish=finish).collect()}
    assert got == {i: 0 for i in range(101)} | {1000 + i: 1000 for i in range(200)}


# -- 3 ---------------------------------------------------------------------


def test_shards_are_even_gapless_and_complete(spark):
    rng = random.Random(7)
    texts = ["hot text of some length"] * 400 + ["x" * rng.choice([1, 10, 3000]) + str(i) for i in range(600)]
    d = docs(spark, texts)
    rows = sharding.assign_shards(d, 8, ranges=32).collect()
    assert sorted(r.doc_id for r in rows) == list(range(1000))
    total, by = sum(r.size for r in rows), collections.defaultdict(list)
    for r in rows:
        assert r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        by[r.shard].append(r)
    for s in range(8):
        assert sorted(r.slot for r in by[s]) == list(range(len(by[s])))
        assert abs(sum(r.size for r in by[s]) - total / 8) <= max(r.size for r in rows)
    assert sorted((r.doc_id, r.shard, r.slot) for r in rows) == sorted((r.doc_id, r.shard, r.slot) for r in sharding.assign_shards(d, 8, ranges=32).collect())


@pytest.mark.parametrize("ranges, whole", [(None, 64), (40, 64), (300, 3)])
def test_shards_equal_brute_force(spark, monkeypatch, ranges, whole):
    """Sort by (md5, id), cut the running bytes; small groups go where they
    start, and the hot one is divided."""
    monkeypatch.setattr(sharding, "WHOLE", whole)
    rng = random.Random(17)
    pool = [f"group {i} " + "y" * rng.randrange(200) for i in range(60)]
    texts = ["one hot text"] * 500 + [rng.choice(pool) for _ in range(300)] + [f"own {i} " + "z" * rng.randrange(900) for i in range(300)] + [None, ""]
    size = [len((t or "").encode()) + 1 for t in texts]
    total, key = sum(size), [hashlib.md5((t or "").encode()).hexdigest() for t in texts]
    by_key, before, start, want = collections.Counter(), 0, {}, {}
    for i in range(len(texts)):
        by_key[key[i]] += size[i]
    for i in sorted(range(len(texts)), key=lambda i: (key[i], i)):
        start.setdefault(key[i], before)
        at = start[key[i]] if by_key[key[i]] * 8 * whole <= total else before
        want[i] = at * 8 // total
        before += size[i]
    rows = sharding.assign_shards(docs(spark, texts), 8, ranges=ranges).collect()
    assert {r.doc_id: r.shard for r in rows} == want
    small = {k: {want[i] for i in range(len(texts)) if key[i] == k} for k in by_key if by_key[k] * 8 * whole <= total}
    assert small and all(len(x) == 1 for x in small.values())
    records = sharding.shard_records(docs(spark, texts).drop("shard"), 8).collect()
    assert len(records) == len(texts) and len({(r.shard, r.slot) for r in records}) == len(texts)


def test_sharding_of_odd_rows(odd, empty):
    rows = sharding.assign_shards(odd, 8).collect()
    assert len(rows) == odd.count() and {r.size for r in rows if r.doc_id in (0, 1)} == {1}
    whole = sharding.shard_records(odd, 4, shard_col="shard")
    assert whole.columns == [c for c in odd.columns if c != "shard"] + ["shard", "slot"] and whole.count() == odd.count()
    assert sharding.assign_shards(empty, 8).count() == 0


def test_repeated_records_with_other_columns_are_each_sharded_once(spark):
    rows = [(1, "same text", i) for i in range(40)] + [(None, None, i) for i in range(5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, other int")
    for part in (1, 7):
        got = sharding.shard_records(d.repartition(part), shards=3).collect()
        assert sorted(r.other for r in got if r.doc_id == 1) == list(range(40)) and sorted(r.other for r in got if r.doc_id is None) == list(range(5))
        assert len({(r.shard, r.slot) for r in got}) == 45


# -- 4 ---------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 2000
    rows = [(1, "http://a/\r\nx: y", big), (2, "http://b/", big), (3, None, None), (4, "u", "small"), (5, "u", "small"), (6, "u", "r" * 1000), (None, "n", big), (7, "z", "".join(random.Random(1).choice("abc é") for _ in range(300_000)))]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = str(tmp_path / "w")
    manifest = warc.write_archive(d, folder, file_bytes=4000)
    for split in (700, 8 << 20):
        got = {r.page_id: r for r in warc.read_archive(manifest, folder, split_bytes=split).collect()}
        assert len(got) == len(rows)
        for page, _, html in rows:
            body = (html or "").encode()
            assert got[page].payload_bytes == len(body) and got[page].payload_digest == hashlib.sha1(body).hexdigest()
            revisit = html == big and page != 2
            assert got[page].record_type == ("revisit" if revisit else "response") and got[page].refers_to == (2 if revisit else None)
            assert got[page].payload is None if revisit else bytes(got[page].payload) == body
    assert warc.round_trip(spark, d.limit(0)).count() == 0


def test_members_survive_garbage_and_false_magic():
    parts = [warc.record(i, "u", b"x" * (i * 100), "d", i * 100) for i in range(20)]
    data = b"\x1f\x8b\x08junk" + b"".join(p + (b"\x1f\x8b\x08\x00" if i % 3 == 0 else b"") for i, p in enumerate(parts))
    for step in (37, 1000, len(data)):
        found = [warc.parse(m)["warc-record-id"] for a in range(0, len(data), step) for m in warc.members(io.BytesIO(data), len(data), a, min(a + step, len(data)))]
        assert found == [f"<urn:x-page:{i}>" for i in range(20)]


def _archive(spark, tmp_path, n=6):
    """One file of n records, and where each begins."""
    rng = random.Random(4)
    d = spark.createDataFrame([(i, f"u{i}", "".join(rng.choice("abcdef gh") for _ in range(3000))) for i in range(n)], "page_id long, url string, html string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        manifest = warc.write_archive(d, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    (file,) = manifest.collect()
    return manifest, tmp_path / file.file


def _at(data):
    return [m.start() for m in re.finditer(re.escape(warc.MAGIC), data)]


def test_damaged_members_are_told(spark, tmp_path):
    manifest, file = _archive(spark, tmp_path)
    good = file.read_bytes()
    starts = _at(good)
    assert len(starts) == 6 and warc.incomplete(manifest, warc.read_archive(manifest, str(tmp_path))).count() == 0

    def read(data, size=None, split=8 << 20):
        file.write_bytes(data)
        listed = manifest.withColumn("bytes", F.lit(len(data)).cast("long"))
        with pytest.raises(Exception, match="(?i)member|incomplete|invalid|cut off|incorrect"):
            warc.read_archive(listed, str(tmp_path), split_bytes=split).collect()
        return warc.read_archive(listed, str(tmp_path), split_bytes=split, report=True).collect(), listed

    flipped = bytearray(good)
    flipped[starts[3] + 1200] ^= 0xFF
    for split in (500, 8 << 20):
        rows, _ = read(bytes(flipped), split=split)
        assert len({r.page_id for r in rows if r.problem is None}) == sum(r.problem is None for r in rows) == 5 and [r.file for r in rows if r.problem] == [file.name]
    rows, _ = read(good[:-40])
    assert sum(r.problem is None for r in rows) == 5 and "cut off" in [r.problem for r in rows if r.problem][0]
    rows, _ = read(bytes(flipped)[: starts[5] + 700])
    assert sum(r.problem is None for r in rows) == 4 and sum(r.problem is not None for r in rows) == 2
    hidden = bytearray(good)  # no magic, no member: the manifest knows
    hidden[starts[2]] ^= 0xFF
    file.write_bytes(hidden)
    rows = warc.read_archive(manifest, str(tmp_path))
    assert rows.count() == 5 and [(r.records, r.found) for r in warc.incomplete(manifest, rows).collect()] == [(6, 5)]


def test_a_changed_payload_is_told(spark, tmp_path):
    data = warc.record(1, "u", b"x" * 50, "0" * 40, 50)
    (tmp_path / "a.warc.gz").write_bytes(data)
    manifest = spark.createDataFrame([("a.warc.gz", len(data), 1)], "file string, bytes long, records long")
    (row,) = warc.read_archive(manifest, str(tmp_path), report=True).collect()
    assert "another digest" in row.problem and row.page_id is None


def test_warc_of_repeated_ids_and_clashing_columns(spark):
    big = "<p>" + "a" * 2000
    rows = [(1, "u", big), (1, "u", big), (2, "v", big), (2, "w", big), (None, None, "x"), (None, None, "x")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("sha", "top", "page", "body", "file", "problem", "records", "payload"):
        d = d.withColumn(name, F.lit("own"))
    got = sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.round_trip(spark, d).collect())
    assert got == [("1", "revisit", 2)] * 2 + [("2", "response", None)] * 2 + [("None", "response", None)] * 2


# -- 5 ---------------------------------------------------------------------


def test_classifier_on_held_out_rows(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    rows = queries.op5_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in rows) / len(rows)
    assert right > 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_classifier_scores_equal_brute_force(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_classifier.fit(d, labels)
    texts, marks = {r.doc_id: r.text for r in d.collect()}, {r.doc_id: r.quality for r in labels.collect()}
    x = {i: row for i, row in zip(texts, quality_classifier.statistics(pa.array(texts.values())))}
    groups = [np.array([x[i] for i in texts if marks.get(i) == c]) for c in (0, 1)]
    both = sum((len(g) - 1) * np.cov(g.T) for g in groups) / (sum(map(len, groups)) - 2)
    parts = []
    for g in groups:
        share = max(0.02, 85 / (85 + len(g)))
        cov = (1 - share) * np.cov(g.T) + share * both
        cov = (1 - share) * cov + share * np.diag(np.diag(cov)) + 1e-3 * np.eye(len(cov))
        parts.append((g.mean(axis=0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1]))
    log = lambda v, k: -0.5 * ((v - parts[k][0]) @ parts[k][1] @ (v - parts[k][0]) + parts[k][2])
    squash = lambda t: math.copysign(math.log1p(abs(t)), t)
    slope, intercept = model.curve
    for r in quality_classifier.score(d, model).collect():
        want = 1 / (1 + math.exp(-(slope * squash(log(x[r.doc_id], 1) - log(x[r.doc_id], 0)) + intercept)))
        assert math.isclose(r.score, want, rel_tol=1e-6, abs_tol=1e-9)
    # few rows: what has no words is no example of quality 1
    assert all(s < 0.7 for s in model.score(quality_classifier.statistics(pa.array([None, "", " \n"]))))


def test_classifier_counts_every_label_and_every_row_of_an_id(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    twice = quality_classifier.fit(d.unionByName(d), labels)
    again = quality_classifier.fit(d, labels.unionByName(labels))
    assert all(np.allclose(a, b) for a, b in zip(twice.means, again.means)) and np.allclose(twice.logdets, again.logdets)


def test_logistic_curve_of_separable_counts():
    x = np.linspace(-16, 16, 256)
    for cut in (-9.0, 0.1, 7.5):
        slope, intercept = quality_classifier.logistic(x, 5.0 * (x < cut), 50.0 * (x > cut))
        assert slope > 0 and abs(-intercept / slope - cut) < 0.5


def test_classifier_without_labels_and_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(1, 1), (None, 0), (3, None)], "doc_id long, quality int")
    model = quality_classifier.fit(odd, labels)
    out = quality_classifier.score(odd, model)
    assert out.columns == [*odd.columns, "score"] and {r.score for r in out.collect()} == {0.5}
    assert quality_classifier.score(empty, model).count() == 0
    assert quality_classifier.drop_poor(odd, model).count() == odd.count()  # nothing learned: nothing dropped


# -- 6 ---------------------------------------------------------------------


def brute_groups(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
    return {k: (min(v)[2], len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups_even_where_hashes_collide(spark, weak):
    texts = ["a b", "ab", " a  b ", "c", "c", None, "", " \n", "ü x", "üx", "d", "e", LONG, LONG.strip()]
    rows = list(enumerate(texts)) + [(90, "twice"), (90, "twice"), (None, "ab")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    digest = (lambda b: bytes([len(b) % 2])) if weak else (lambda b: hashlib.md5(b).digest())
    got = exact_dedup.exact_groups(d, digest=digest).collect()
    want = brute_groups(rows)
    assert len(got) == len(rows)
    keeps = collections.Counter()
    for r in got:
        key = next(k for k in want if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        assert (r.keep_id, r.group_size) == want[key]
        keeps[key] += r.kept
    assert set(keeps.values()) == {1}


def test_drop_copies(odd, empty):
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, i) for i in (2, 3, 4, 5, 6, 7, 8, 9, 50)] + [(True, None)]
    assert exact_dedup.drop_copies(empty).count() == 0


# -- 7 ---------------------------------------------------------------------


@pytest.mark.parametrize("per_task, buckets", [(2_000_000, 4096), (50, 4096), (50, 3)])
def test_lm_equals_brute_force(spark, monkeypatch, per_task, buckets):
    monkeypatch.setattr(lm_scoring, "TOKENS_PER_TASK", per_task)
    monkeypatch.setattr(lm_scoring, "MAX_BUCKETS", buckets)
    monkeypatch.setattr(lm_scoring, "BYTES_SPLIT", 2000)
    monkeypatch.setattr(lm_scoring, "WORDS_PER_RANGE", 20)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "The", "of", "a", "bb", "cc", "dd", f"w{rng.randrange(60)}"]) for _ in range(rng.randrange(0, 40))) for _ in range(150)] + [None, "", "the of " * 400, "the of the of bb"]
    d = docs(spark, texts)
    model = lm_scoring.fit(d, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r for r in lm_scoring.score(d, model).collect()}
    words = [(t or "").lower().split() + [None] for t in texts]
    uni, tri, starts = collections.Counter(), collections.Counter(), collections.Counter()
    for i, w in enumerate(words):
        if i % 5:
            uni.update(w)
            starts[w[0]] += 1
            tri.update(zip(["^", *w[:-2]], w[:-1], w[1:]))
    n, v = sum(uni.values()), len(uni)
    # a pair counts the distinct words before it, after the start its own count
    bi = collections.Counter({("^", w): k for w, k in starts.items()})
    bi.update((b, c) for _, b, c in tri)
    cont = collections.Counter(b for _, b in bi)

    def contexts(counts):
        out = collections.defaultdict(lambda: [0, 0, 0, 0])
        for key, k in counts.items():
            out[key[:-1]][0] += k
            out[key[:-1]][min(k, 3)] += 1
        return out

    count = lambda c: [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
    d3, d2, d1 = ([0, *lm_scoring.discounts(count(c))] for c in (tri, bi, cont))
    c3, c2 = contexts(tri), contexts(bi)
    held = sum(d1[min(k, 3)] for k in cont.values()) / len(bi)

    def level(counts, d, sums, key, low):
        if key[:-1] not in sums:
            return low
        x, k = sums[key[:-1]], counts[key]
        return (k - d[min(k, 3)]) / x[0] + sum(d[j] * x[j] for j in (1, 2, 3)) / x[0] * low

    def p(a, b, w):
        one = (cont[w] - d1[min(cont[w], 3)]) / len(bi) + held / (v + 1)
        two = level(bi, d2, c2, (b, w), one)
        return two if a is None else level(tri, d3, c3, (a, b, w), two)

    for context in (("the", "of"), ("w3", "bb"), ("^", "the"), (None, "^"), ("unseen", "the")):
        assert abs(sum(p(*context, w) for w in uni) + p(*context, "never seen") - 1) < 1e-9
    for i, w in enumerate(words):
        assert got[i].n_tokens == len(w) and got[i].n_known == sum(uni[x] > 0 for x in w)
        assert math.isclose(got[i].base_score, sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        want = sum(math.log10(p(a, b, x)) for a, b, x in zip([None, "^", *w], ["^", *w], w))
        assert math.isclose(got[i].score, want, rel_tol=1e-9)


def test_lm_refuses_more_words_than_ids(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "MAX_WORDS", 3)
    with pytest.raises(OverflowError):
        lm_scoring.fit(docs(spark, ["a b c d e"]), F.lit(True))


def test_lm_of_odd_and_empty_tables(odd, empty):
    model = lm_scoring.fit(odd, F.lit(True))
    assert lm_scoring.score(odd, model).count() == odd.count()
    nothing = lm_scoring.fit(empty, F.lit(True))
    assert lm_scoring.score(empty, nothing).count() == 0
    assert all(r.score == 0.0 and r.n_known == 0 for r in lm_scoring.score(odd, nothing).collect())


# -- 8 ---------------------------------------------------------------------


def brute_rules(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c, covered, seen, dup = collections.Counter(win), set(), set(), 0
    for i, x in enumerate(win):
        if c[x] > 1:
            covered |= {i, i + 1, i + 2}
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_rules_equal_brute_force(spark):
    rng = random.Random(4)
    texts = ODD + [" ".join(rng.choice("abcdefgh|#") for _ in range(rng.randrange(200))).replace("a b", "a\nb") for _ in range(60)]
    texts += [" ".join(f"w{rng.randrange(400)}" for _ in range(5000)), " ".join(f"w{i % 300}" for i in range(3000))]  # many repeated windows
    for few in range(quality_rules.FEW - 1, quality_rules.FEW + 2):  # exactly so many windows found twice
        texts.append(" ".join(" ".join([f"x{i}", f"y{i}", f"z{i}", f"u{2 * i}", f"x{i}", f"y{i}", f"z{i}", f"u{2 * i + 1}"]) for i in range(few)))
    rows = quality_rules.quality_report(docs(spark, texts)).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_rules(texts[r.doc_id])
        assert not (r.kept and r.base_failed)


def test_rules_keep_clean_and_drop_strange_texts(spark, empty):
    sf = SF.replace("sf0.001", "sf0.01")
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = quality_rules.quality_report(d).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    assert all(r.kept for r in rows if r.quality == 1)
    assert sum(not r.kept for r in rows if r.quality == 0) > 0.6 * sum(r.quality == 0 for r in rows)
    assert quality_rules.quality_report(empty).count() == 0
    assert quality_rules.drop_low_quality(d).columns == d.columns


def test_rules_verdict_equals_brute_force(spark):
    """Medians of the shares by language as references; the distances and the
    verdict of every document, of unknown languages too."""
    d = spark.read.parquet(f"{SF}/documents.parquet").withColumn("lang", F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 11 == 0, "xx").otherwise(F.col("lang")))
    d = d.withColumns({"kept": F.lit("clash"), "group": F.lit("clash")})
    data, got = d.collect(), {r.doc_id: r for r in quality_rules.quality_report(d).collect()}
    import unicodedata

    def counts(text, lang):
        words, white = re.findall(r"[^\x20\x09-\x0D]+", text), set(" \t\n\x0b\x0c\r")
        kinds = collections.Counter("white" if c in white else {"Ll": "lower", "Lu": "upper", "Nd": "digit"}.get(unicodedata.category(c), "symbol" if c in "#*$%&|<>" else "other") for c in text)
        group = lang if lang in quality_rules.COMMON else "other"
        listed = quality_rules.COMMON.get(group) or sorted({w for ws in quality_rules.COMMON.values() for w in ws})
        common = [words.count(w) for w in listed]
        return group, [kinds[k] for k in quality_rules.CHAR_CLASSES], [*common, max(len(words) - sum(common), 0)], len(words)

    share = lambda xs: [x / sum(xs) if sum(xs) else 0.0 for x in xs]
    found = {r.doc_id: counts(r.text or "", r.lang) for r in data}
    refs = {}
    for g in {f[0] for f in found.values()}:
        good = [f for i, f in found.items() if f[0] == g and not got[i].base_failed]
        middle = lambda rows: [sorted(c)[(len(c) + 1) // 2 - 1] for c in zip(*map(share, rows))]
        refs[g] = [share(middle([f[k] for f in good])) if good else None for k in (1, 2)]

    def distance(p, q):
        m = [(a + b) / 2 for a, b in zip(p, q)]
        kl = lambda x: sum(a * math.log2(a / c) for a, c in zip(x, m) if a)
        return math.sqrt(max((kl(p) + kl(q)) / 2, 0))

    kept = 0
    for i, (g, chars, common, n) in found.items():
        a = distance(share(chars), refs[g][0]) if sum(chars) >= 200 and refs[g][0] else 0.0
        b = distance(share(common), refs[g][1]) if n >= 100 and refs[g][1] else 0.0
        assert math.isclose(got[i].char_distance, a, abs_tol=1e-7) and math.isclose(got[i].word_distance, b, abs_tol=1e-7)
        want = not got[i].base_failed and a <= 0.16 + 7 / max(n, 1) and b <= 0.24 + 10 / max(n, 1)
        assert got[i].kept == want
        kept += want
    assert 0 < kept < len(found)
    assert quality_rules.drop_low_quality(d).columns == d.columns and quality_rules.drop_low_quality(d).count() == kept


def test_rules_distance_is_jensen_shannon(spark):
    row = spark.range(1).select(quality_rules.distance(F.array(F.lit(1.0), F.lit(3.0), F.lit(0.0)), F.array(F.lit(0.5), F.lit(0.25), F.lit(0.25))).alias("d")).first()
    p, q = np.array([0.25, 0.75, 0]), np.array([0.5, 0.25, 0.25])
    m = (p + q) / 2
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
    assert math.isclose(row.d, math.sqrt((kl(p) + kl(q)) / 2))


# -- 9 ---------------------------------------------------------------------


def test_boundaries_are_optimal():
    rng = random.Random(6)
    for _ in range(30):
        n, k = rng.randrange(1, 9), rng.randrange(1, 5)
        lengths = np.array(sorted(rng.sample(range(1, 40), n)))
        counts = np.array([rng.randrange(1, 9) for _ in range(n)])
        cost = lambda bounds: sum(c * min(b for b in bounds if b >= x) for x, c in zip(lengths, counts)) if max(bounds) >= lengths[-1] else math.inf
        import itertools

        best = min(cost(b) for r in range(1, k + 1) for b in itertools.combinations(lengths.tolist(), min(r, n)))
        found = packing.boundaries(lengths, counts, k)
        assert len(found) <= max(k, 1) and cost(found) == best


def test_pack_batches(spark, monkeypatch, empty):
    monkeypatch.setattr(packing, "ROWS_PER_RANGE", 50)
    rng = random.Random(8)
    lengths = [rng.choice([3, 5, 40, 41, 900, 30_000]) for _ in range(700)] + [None, 0]
    d = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n_tokens long").withColumn("batch", F.lit("x"))
    rows = packing.pack(d, buckets=3, budget=2000).collect()
    assert sorted(r.doc_id for r in rows) == list(range(702))
    batches = collections.defaultdict(list)
    for r in rows:
        assert r.padding == r.bucket_tokens - (lengths[r.doc_id] or 0) >= 0
        batches[r.bucket, r.batch].append(r)
    per = collections.defaultdict(list)
    for (bucket, batch), rs in batches.items():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
        assert len(rs) == 1 or len(rs) * rs[0].bucket_tokens <= 2000
        per[bucket].append((batch, len(rs)))
    for found in per.values():  # only the last batch of a bucket may be short
        found.sort()
        assert [b for b, _ in found] == list(range(len(found))) and len({n for _, n in found[:-1]}) <= 1
    assert packing.pack(empty.select("doc_id", F.lit(1).alias("n_tokens"))).count() == 0


def test_pack_repeated_rows_and_negative_lengths(spark):
    d = spark.createDataFrame([(1, 5)] * 7 + [(2, -3), (3, 0), (None, 5), (None, 5)], "doc_id long, n_tokens long")
    rows = packing.pack(d, buckets=2, budget=10).collect()
    assert len(rows) == 11 and len({(r.bucket, r.batch, r.slot) for r in rows}) == 11
    assert {r.bucket_tokens for r in rows} == {0, 5} and all(r.padding >= 0 for r in rows)


def test_n_words(odd):
    for r in odd.select("text", packing.n_words("text").alias("n")).collect():
        assert r.n == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) + 1


# -- 10 --------------------------------------------------------------------


def test_bpe_equals_the_library(spark, odd, empty):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    theirs, mine = Tokenizer.from_file(path), bpe.tokenizer(bpe.read(path))
    rng = random.Random(1)
    pool = [*"aAbZ ÉéΣσςİıßẞ\t\n\x0b　 's'll'D012½²①٣五あäö̈éﬁ🙂<|>|startoftext|>_-…​\x00\x85힣ᄒ하ǅЖЩ", "<|startoftext|>", "<|endoftext|>"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(3000)] + [t or "" for t in ODD] + ["a" * 20_000]
    for t, e in zip(texts, theirs.encode_batch(texts, add_special_tokens=False)):
        ids = mine.encode(t)
        assert ids == e.ids
        assert mine.decode(ids) == theirs.decode(ids, skip_special_tokens=False)
    out = bpe.encode_column(odd, path)
    assert out.columns == [*odd.columns, "ids", "decoded"] and out.count() == odd.count()
    assert bpe.encode_digests(empty, path).count() == 0
    assert bpe.encode_column(empty, path).count() == 0
    clash = odd.withColumn("ids", F.lit("own"))
    assert bpe.encode_column(clash, path).columns == [*odd.columns, "ids", "decoded"]
    rows = bpe.encode_digests(odd, path).collect()
    assert len({(r.n_tokens, r.ids_sha256) for r in rows if r.doc_id == 50}) == 1 and sum(r.doc_id is None for r in rows) == 2


def test_token_counts_equal_the_encoding(spark, odd, empty, monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    model = bpe.tokenizer(bpe.read(path))
    rng = random.Random(5)
    pool = [*"aAbZ ÉéΣσςİıßẞ\t\n\x0b\r　 's'll'D012½²①٣五あäö̈éﬁ🙂<|>_-…​\x00\x85힣", "<|startoftext|>", "<|endoftext|>", "word", "the "]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(2000)] + ["a" * 1_500_000, "long word " * 150_000]
    for keep in (400_000, 300):
        monkeypatch.setattr(bpe, "CACHE_WORDS", keep)
        monkeypatch.setattr(bpe, "CACHE_HASHES", keep)
        monkeypatch.setattr(bpe, "CACHE_PIECES", keep)
        got = bpe.with_token_counts(docs(spark, texts).withColumn("n_tokens", F.lit("own")), path)
        assert got.columns == [*odd.columns, "n_tokens"]
        rows = {r.doc_id: r.n_tokens for r in got.select("doc_id", "n_tokens").collect()}
        assert all(rows[i] == len(model.encode(t)) for i, t in enumerate(texts))
    assert {r.n_tokens for r in bpe.with_token_counts(odd, path).where("doc_id < 3").collect()} == {0}
    assert bpe.with_token_counts(empty, path).count() == 0


@pytest.mark.parametrize("part, value", [("normalizer", None), ("decoder", {"type": "BPEDecoder"}), ("pre_tokenizer", {"type": "Sequence", "pretokenizers": []})])
def test_bpe_refuses_other_files(part, value):
    public = pytest.importorskip("public_tokenizers")
    spec = json.loads(bpe.read(public.path("word_bpe_49k.json")))
    with pytest.raises(ValueError, match=part):
        bpe.Tokenizer(json.dumps(spec | {part: value}))


# -- the pipeline ----------------------------------------------------------


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    d = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = d.columns, [d.count()]
    for name, stage in pipeline.STAGES:
        d = _common.stored(stage(spark, d, SF), name)
        sizes.append(d.count())
        if name != "packing":
            assert d.columns == columns
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] > 0
    assert sorted(r.doc_id for r in d.collect()) == sorted(r.doc_id for r in pipeline.run(spark, SF).collect())


@pytest.mark.parametrize("name", ["quality_rules", "quality_classifier", "exact_dedup", "near_dedup", "packing"])
def test_pipeline_stages_of_odd_and_empty_tables(spark, odd, empty, name):
    pipeline = pytest.importorskip("corpus_pipeline")
    stage = dict(pipeline.STAGES)[name]
    out, none = stage(spark, odd, SF), stage(spark, empty, SF)
    assert none.count() == 0
    if name == "packing":
        assert out.count() == odd.count()
        return
    assert out.columns == none.columns == odd.columns and odd.exceptAll(out).count() + out.count() == odd.count()
    ids = collections.Counter(r.doc_id for r in out.collect())
    if name in ("quality_rules", "quality_classifier"):
        assert not {0, 1, 2} & set(ids)  # null, empty and blank texts
    elif name == "exact_dedup":
        assert ids[50] == 1 and ids[None] == 1 and 2 in ids and 0 not in ids
    else:
        assert ids[50] == 1 and ids[None] == 2 and {0, 1, 2} <= set(ids) and 5 not in ids  # 4 and 5 are alike in lower case
