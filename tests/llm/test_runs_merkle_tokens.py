"""Periodic runs, Merkle manifests and prefix token counts: brute force, the
public library and recomputed trees; odd, repeated, empty and clashing rows."""

import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from oracle import SF
from pyspark.sql import functions as F

from docloom.llm import merkle, periodic_runs, queries, token_prefixes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, body string, runs string, n_tokens int"
ODD = [None, "", " \t\n", "one", "a " * 400_000, "ÀÉ ü\x0bß 日本 🙂", "x y z " * 9, "x\n\nx\n", "Same Text", "Same Text"]


def docs(spark, texts, ids=None, langs=None):
    ids = ids if ids is not None else range(len(texts))
    langs = langs or ["en"] * len(texts)
    return spark.createDataFrame([(i, t, g, "s", len(t or ""), "b", "own", 7) for i, t, g in zip(ids, texts, langs)], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, [*ODD, "no id", "no id"], [*range(len(ODD)), None, None], [None, "", "en", "en", None, "de", "de", "en", "é", "é", "en", "en"]).cache()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- 11 --------------------------------------------------------------------


def brute_runs(w, least=24, repeats=3):
    """Every maximal stretch of every period, kept if no smaller one fits it."""
    found = []
    for p in range(1, len(w) // repeats + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, repeats * p):
                part = w[i : j + p]
                if not any(part[q:] == part[:-q] for q in range(1, p)):
                    found.append((i, j + p - i, p))
            i = j + 1 if j == i else j
    return sorted(found)


def brute_collapsed(w, runs):
    return " ".join(x for i, x in enumerate(w) if not any(s + p <= i < s + n for s, n, p in runs))


def test_runs_equal_brute_force():
    rng = random.Random(3)
    total = 0
    for _ in range(1500):
        k, (least, repeats) = rng.choice([1, 2, 3, 40]), rng.choice([(24, 3), (24, 3), (6, 3), (4, 2), (10, 4)])
        w = []
        for _ in range(rng.randrange(9)):
            unit = [rng.randrange(k) for _ in range(rng.randrange(1, 15))]
            w += unit * rng.choice([1, 1, 2, 3, 4, 9]) + unit[: rng.randrange(len(unit) + 1)]
        w *= rng.choice([1, 1, 1, 3])
        want = brute_runs(w, least, repeats)
        assert periodic_runs.find_runs(np.array(w, np.int32), least, repeats) == want
        total += len(want)
    assert total > 1000


def test_long_periodic_arrays_are_linear():
    for unit in ([0], [0, 0, 0, 1], list(range(1000))):
        w = np.tile(np.array(unit, np.int32), 400_000 // len(unit))
        assert periodic_runs.find_runs(w) == [(0, len(w), len(unit))]
    with pytest.raises(ValueError):
        periodic_runs.find_runs(np.zeros(9, np.int32), repeats=1)


def test_collapse_runs_of_odd_rows(spark, odd):
    out = periodic_runs.collapse_runs(odd)
    assert set(out.columns) == {*odd.columns, "n_words", "collapsed"}
    rows = {r.doc_id: r for r in out.collect()}
    assert [rows[i].n_words for i in range(3)] == [0, 0, 0] and {rows[i].collapsed for i in range(3)} == {""}
    assert [tuple(r) for r in rows[4].runs] == [(0, 400_000, 1)] and rows[4].collapsed == "a"
    assert [tuple(r) for r in rows[6].runs] == [(0, 27, 3)] and rows[6].collapsed == "x y z"
    assert rows[5].collapsed == "ÀÉ ü ß 日本 🙂" and rows[7].collapsed == "x x"
    assert sum(r.doc_id is None for r in out.collect()) == 2
    assert periodic_runs.collapse_runs(docs(spark, [])).count() == 0


def test_strongest_run_compares_exactly(spark):
    runs = [(5, 49, 7), (9, 70, 10), (90, 14, 2), (2, 1_400_000_001, 2 * 10**8)]
    d = spark.createDataFrame([(runs,), ([],)], f"runs {periodic_runs.RUNS}")
    got = [r.top for r in d.select(periodic_runs.strongest(F.col("runs")).alias("top")).collect()]
    assert tuple(got[0]) == runs[3] and got[1] is None
    assert d.select(periodic_runs.runs_text(F.col("runs")).alias("t")).first().t.startswith("5,49,7\n9,70,10\n")


def words_of(text):
    return [w.decode() for w in (text or "").encode().split()]


def plant(doc_id, text):
    w, h = words_of(text), zlib.crc32(str(doc_id).encode())
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


def test_op11_equals_brute_force(spark):
    rows = {r.doc_id: r for r in queries.op11_periodic_runs(spark, SF).collect()}
    table, some = spark.read.parquet(f"{SF}/documents.parquet").collect(), 0
    assert len(rows) == len(table)
    for d in table:
        w = plant(d.doc_id, d.text)
        runs, r = brute_runs(w), rows[d.doc_id]
        some += len(runs)
        assert r.n_runs == len(runs) and r.runs_sha256 == sha("".join(f"{s},{n},{p}\n" for s, n, p in runs))
        assert r.collapsed_sha256 == sha(brute_collapsed(w, runs))
        if runs:
            s, n, p = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (s, n, p, 1000 * n // p)
        else:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4
    assert some


# -- 12 --------------------------------------------------------------------


def tree(leaves):
    """The root and every leaf's siblings, level by level."""
    at, proofs, nodes = list(range(len(leaves))), [""] * len(leaves), list(leaves)
    while len(nodes) > 1:
        for i in range(len(leaves)):
            k = at[i] - at[i] % 8
            proofs[i] += "".join(n for j, n in enumerate(nodes[k : k + 8], k) if j != at[i])
            at[i] //= 8
        nodes = [sha("".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)]
    return nodes[0], proofs


def check_manifest(rows):
    """rows of (group, key, leaf, subroot, root, proof) against plain trees."""
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        subs[g] = tree([r[2] for r in groups[g]])
    root, tops = tree([subs[g][0] for g in order])
    for g, top in zip(order, tops):
        for (_, _, _, subroot, end, _), _ in zip(groups[g], subs[g][1]):
            assert subroot == subs[g][0] and end == root
        assert sorted(r[5] for r in groups[g]) == sorted(p + top for p in subs[g][1])
        unique = {r[2] for r in groups[g]}
        if len(unique) == len(groups[g]):
            assert [r[5] for r in groups[g]] == [p + top for p in subs[g][1]]


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def manifest_rows(spark, d, **kw):
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    m = merkle.manifest(d, fields, **kw)
    back = {r.leaf: r.lang for r in d.select("lang", merkle.leaf(*fields).alias("leaf")).collect()}
    rows = m.withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof"), F.col("slots"))).collect()
    assert all(r.folded == r.root for r in rows)
    return [(back[r.leaf], r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in rows]


def test_manifest_of_odd_rows(spark, odd):
    rows = manifest_rows(spark, odd)
    assert len(rows) == odd.count() and len({r[4] for r in rows}) == 1
    check_manifest(rows)
    leaves = {r[1]: r[2] for r in rows}
    assert leaves[0] == sha(field(0) + field("s") + "-" + field(0) + "-") and leaves[5] == sha(field(5) + field("s") + field("de") + field(len(ODD[5])) + field(ODD[5]))
    assert merkle.manifest(docs(spark, [])).count() == 0
    one = manifest_rows(spark, docs(spark, ["only"]))
    assert one[0][2] == one[0][3] == one[0][4] and one[0][5] == ""


@pytest.mark.parametrize("n", [8, 9, 64, 65, 700])
def test_manifest_cut_over_many_partitions(spark, monkeypatch, n):
    # blocks of 64, so that there are several tiers; groups that span partitions
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 64)
    monkeypatch.setattr(merkle, "hash_partitions", lambda df: 7)
    rng = random.Random(n)
    langs = [rng.choice(["en", "en", "en", "en", None, "fr"]) if n > 9 else "en" for _ in range(n)]
    rows = manifest_rows(spark, docs(spark, [f"text {i}" for i in range(n)], rng.sample(range(10 * n), n), langs))
    assert len(rows) == n
    check_manifest(rows)


def test_manifest_of_one_key_and_many_groups(spark, monkeypatch):
    monkeypatch.setattr(merkle, "hash_partitions", lambda df: 5)
    rows = manifest_rows(spark, docs(spark, ["same"] * 300, [1] * 300))
    assert len(rows) == 300
    check_manifest(rows)
    check_manifest(manifest_rows(spark, docs(spark, [f"t{i}" for i in range(200)], None, [f"g{i % 77}" for i in range(200)])))


def test_partition_offsets():
    ends = [(0, "a", 5, "b", 2), (1, "b", 3, "b", 3), (4, "b", 1, "c", 9), (5, "d", 1, "d", 1)]
    assert merkle.partition_offsets(ends[::-1]) == {0: ("a", 0), 1: ("b", 2), 4: ("b", 5), 5: ("d", 0)}


def test_aligned_subtrees_cover_the_places():
    for a, b in [(0, 4096), (1, 4097), (4090, 9000), (5, 6), (7, 20_000)]:
        cuts = [*merkle.aligned(a, b)]
        assert cuts[0][0] == a and cuts[-1][1] == b and all(x[1] == y[0] for x, y in zip(cuts, cuts[1:]))
        assert all(s % 8**k == 0 and e - s == 8**k <= merkle.BLOCK for s, e, k in cuts)


def test_tampered_rows_do_not_verify(spark):
    rows = queries.op12_merkle_manifest(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        changed = zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and any("A" <= c <= "Z" for c in texts[r.doc_id] or "")
        assert r.verified is not changed
    assert {r.verified for r in rows} == {True, False}


# -- 13 --------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def theirs(tokenizer, texts):
    return [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_every_prefix_equals_the_library(library):
    path, tokenizer = library
    mine = token_prefixes.prefixes(open(path, encoding="utf-8").read())
    rng = random.Random(7)
    pool = [*"aAbZ ÉéΣς\t\n\x0b\r　  's'll're've'D012½²①٣五あäö̈é🙂<|>_-…​\x00\x85\x1c힣࢏\U0002ceb0", "<|endoftext|>", "<|endo", "the", " hello", "ing", "'re", "    ", "\n\n"]
    for _ in range(1500):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(1, 24)))
        assert mine.table(text).tolist() == theirs(tokenizer, [text[:k] for k in range(1, len(text) + 1)])


def test_pieces_equal_the_library_for_every_code_point(library):
    path, tokenizer = library
    mine = token_prefixes.prefixes(open(path, encoding="utf-8").read())
    for c in [*range(0xD800), *range(0xE000, 0x110000, 7), *map(ord, "՘\U0003d000")]:
        text = "a" + chr(c) + "1 " + chr(c) + "."
        assert [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)] == mine.split(text)


def test_token_counts_of_documents_and_odd_rows(spark, odd, library, monkeypatch):
    path, tokenizer = library
    monkeypatch.setattr(token_prefixes, "PART", 5000)
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = token_prefixes.count_tokens(table, path, [3, 1024]).collect()
    for r, n in zip(rows, theirs(tokenizer, [r.text or "" for r in rows])):
        text = r.text or ""
        assert r.n_tokens == n and r.n_bytes == len(text.encode())
        for budget, fits in ((3, r.fits_3), (1024, r.fits_1024)):
            assert fits <= len(text) and theirs(tokenizer, [text[:fits]])[0] <= budget
            if fits < len(text):
                assert theirs(tokenizer, [text[: fits + 1]])[0] > budget
    out = token_prefixes.count_tokens(odd, path)
    assert set(out.columns) == {*odd.columns, "n_bytes"} and out.count() == odd.count()
    assert token_prefixes.count_tokens(docs(spark, []), path).count() == 0


def test_a_table_answers_without_encoding(spark, library):
    path, tokenizer = library
    texts = ["A short text, isn't it?\n\n  Yes<|endoftext|>.", None, "", "   ", "x" * 300]
    d = docs(spark, texts).withColumn("prefix_tokens", F.lit("own"))
    table = token_prefixes.prefix_table(d, path)
    at = [token_prefixes.tokens_at(F.col("prefix_tokens"), k).alias(f"k{k}") for k in range(0, 45)]
    within = [token_prefixes.longest_within(F.col("prefix_tokens"), b).alias(f"b{b}") for b in range(0, 12)]
    for r in table.select("text", *at, *within).collect():
        text = r.text or ""
        counts = theirs(tokenizer, [text[:k] for k in range(len(text) + 1)])
        assert [r[f"k{k}"] for k in range(45)] == [counts[min(k, len(text))] for k in range(45)]
        assert [r[f"b{b}"] for b in range(12)] == [max(k for k, n in enumerate(counts) if n <= b) for b in range(12)]


def test_truncate(spark, library):
    path, tokenizer = library
    clash = docs(spark, ["one two three four", None, "", "five"]).withColumn("fits_3", F.lit("own")).withColumn("n_bytes", F.lit("own"))
    out = token_prefixes.truncate(clash, path, 3)
    assert out.columns == clash.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert [rows[i].text for i in range(4)] == ["one two three", None, "", "five"]
    assert {(r.fits_3, r.n_bytes, r.n_tokens) for r in rows.values()} == {("own", "own", 7)}
    assert token_prefixes.truncate(docs(spark, []), path, 3).count() == 0


def test_long_pieces_and_small_caches(library, monkeypatch):
    path, tokenizer = library
    monkeypatch.setattr(token_prefixes, "CACHE_PIECES", 3)
    monkeypatch.setattr(token_prefixes, "CACHE_PAIRS", 5)
    monkeypatch.setattr(token_prefixes, "PART", 1000)
    mine = token_prefixes.Prefixes(open(path, encoding="utf-8").read())
    for text in ("a" * 20_000, " " * 20_000 + "x", "word two\n\n three's " * 2000, "é" * 9000 + "<|endoftext|>" * 3):
        assert mine.count(text)[0] == theirs(tokenizer, [text])[0] == mine.table(text)[-1]


@pytest.mark.parametrize("part, value", [("normalizer", {"type": "NFC"}), ("pre_tokenizer", {"type": "Whitespace"}), ("added_tokens", [{"content": "x", "single_word": True, "lstrip": False, "rstrip": False, "normalized": False}])])
def test_other_files_are_refused(library, part, value):
    spec = json.load(open(library[0], encoding="utf-8"))
    with pytest.raises(ValueError, match=part):
        token_prefixes.Prefixes(json.dumps(spec | {part: value}))
