"""Bucket bounds of documents longer than the exact cells."""

import time

import numpy as np
import pytest

from docloom.llm import packing


def made(spark, lengths):
    return spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n_tokens long")


def test_long_documents_are_not_padded_to_a_grid(spark):
    rows = packing.pack(made(spark, [20_001] * 5 + [20_100] * 3 + [7])).collect()
    assert {r.n_tokens: (r.bucket_tokens, r.padding) for r in rows} == {n: (n, 0) for n in (7, 20_001, 20_100)}


def test_cells_of_many_lengths_end_at_their_greatest(spark, monkeypatch):
    monkeypatch.setattr(packing, "DISTINCT", 3)
    lengths = [5, 16_384, 16_385, 20_001, 20_100, 40_003, 40_003]
    rows = packing.pack(made(spark, lengths)).collect()
    assert {r.n_tokens: r.bucket_tokens for r in rows} == {5: 5, 16_384: 16_384, 16_385: 16_385, 20_001: 20_100, 20_100: 20_100, 40_003: 40_003}
    assert sum(n for _, n in packing.choose(made(spark, lengths))) == len(lengths)


@pytest.mark.parametrize("buckets", [1, 2, 3])
def test_padding_is_least(spark, buckets):
    import itertools

    lengths = [17_000, 17_001, 17_090, 25_000, 25_001, 25_300, 90_000, 90_900]
    cost = lambda bounds: sum(min(b for b in bounds if b >= x) - x for x in lengths)
    best = min(cost([*c, 90_900]) for c in itertools.combinations(lengths[:-1], buckets - 1))
    assert sum(r.padding for r in packing.pack(made(spark, lengths), buckets=buckets).collect()) == best


def test_many_lengths_are_exact_by_default(spark, monkeypatch):
    assert packing.DISTINCT is None
    lengths = [16_000 + 3 * i for i in range(3000)]
    bounds = [b for b, _ in packing.choose(made(spark, lengths), buckets=3000)]
    assert bounds == lengths
    monkeypatch.setattr(packing, "COSTS", 7)  # many blocks of costs, the same table
    some = np.unique(np.random.default_rng(3).integers(1, 400, 120))
    counts = np.random.default_rng(4).integers(1, 50, len(some))
    in_blocks = packing.boundaries(some, counts, 6)
    monkeypatch.setattr(packing, "COSTS", 1 << 21)
    assert in_blocks == packing.boundaries(some, counts, 6)


def test_above_the_old_bound_padding_is_least():
    # 300,000 lengths in three clusters: the bounds can only be their ends
    lengths = np.concatenate([np.arange(a, a + 100_000) for a in (1, 10_000_000, 900_000_000)])
    counts = np.ones(len(lengths), np.int64)
    start = time.process_time()
    bounds = packing.boundaries(lengths, counts, 3)
    assert bounds == [100_000, 10_099_999, 900_099_999] and time.process_time() - start < 30


@pytest.mark.parametrize("scale", [1, 10**17])
def test_small_tables_equal_every_choice(scale):
    """Also where totals leave the whole numbers."""
    import itertools

    rng = np.random.default_rng(7)
    for _ in range(60):
        lengths = np.unique(rng.integers(0, 60, 9))
        counts = rng.integers(1, 9, len(lengths)) * scale
        for k in (1, 2, 3, 4):
            cost = lambda bounds: sum(int(c) * (min(b for b in bounds if b >= x) - int(x)) for x, c in zip(lengths.tolist(), counts))
            best = min(cost([*c, int(lengths[-1])]) for c in itertools.combinations(lengths[:-1].tolist(), min(k, len(lengths)) - 1))
            assert cost(packing.boundaries(lengths, counts, k)) == best
