"""Ids that stand for more than one text."""

import random

import pytest

from docloom.llm import near_dedup


def variants(words, n):
    """n texts that differ from words in one place each."""
    return [" ".join([*words[: 20 * (i + 1)], f"changed{i}", *words[20 * (i + 1) + 1 :]]) for i in range(n)]


@pytest.mark.parametrize("chunk", [near_dedup.CHUNK_BYTES, 3000])
def test_an_id_is_linked_by_each_of_its_texts(spark, chunk):
    rng = random.Random(1)
    rows, want = [], {}
    for k in range(10):  # which of two texts got lost was arbitrary
        first = 10 * k + 5
        for side in (0, 1):
            words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(200)]
            text, copy = " ".join(words), variants(words, 1)[0]
            rows += [(first, text), (first, text), (first + 2 + 2 * side, copy)]
            want |= {first: first, first + 2 + 2 * side: first}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_dedup.near_components(docs, shingle=3, percent=85, chunk_bytes=chunk).collect()
    assert {r.doc_id: r.component_id for r in found} == want
    assert len(found) == len(rows)
    kept = near_dedup.drop_near_copies(docs, shingle=3, percent=85)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted({x for x in want.values()})
