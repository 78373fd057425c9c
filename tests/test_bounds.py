"""What a task holds or does doesn't grow with the input."""

import pyarrow as pa
import pytest
from oracle import SF

from docloom import plans
from docloom.functions.html import pieces
from docloom.operators import folds, gram_index
from docloom.streaming.library import Library


@pytest.mark.parametrize("name", ["h8_contents_links", "f9_f10_ancestors", "f14_excluded_anchors", "h24_h25_print_sections", "h5_ids"])
def test_a_small_file_is_worked_on_by_all_tasks(spark, name):
    assert plans.QUERIES[name](spark, SF).rdd.getNumPartitions() >= 4


def test_pieces_hold_every_text_once():
    texts = pa.array(["x" * 400, None, "y" * 700, "z" * 5000, "", "w", "v"])
    assert list(pieces(texts, size=1000, most=2)) == [(0, 2), (2, 1), (3, 1), (4, 2), (6, 1)]
    assert list(pieces(pa.array([], pa.string()))) == []


def test_pages_are_sent_in_pieces(spark):
    from docloom.functions.html import extract

    pages = spark.range(0, 1200, 1, 1).selectExpr("id AS page_id", "'u' AS url", "concat('<title>', id, '</title><meta name=\"a\" content=\"b\"><ul><li><a href=\"x\">t</a></ul>', if(id = 7, null, '')) AS html")
    sizes = extract(pages).mapInArrow(lambda bs: (pa.record_batch([pa.array([b.num_rows])], ["n"]) for b in bs), "n long")
    seen = [r.n for r in sizes.collect()]
    assert sum(seen) == 1200
    got = {r.page_id: r for r in extract(pages).collect()}
    assert got[5].title == "5" and got[5].metadata == {"a": "b"} and got[5].toc[0].href == "x" and got[7].title == "" and got[7].metadata == {}


def test_large_results_of_a_fold_are_sent_early():
    """Each part is larger than what is sent together."""
    rows = pa.record_batch([pa.array(range(8)), pa.array(["x" * (5 << 20)] * 8)], ["g", "t"])
    sent = [len(out) for out in folds._folded(iter([rows]), ["g"], ["t"], lambda: folds._Joined(""))]
    assert sum(sent) == 8 and max(sent) == 1


def test_partial_containers_are_cut_by_grams(monkeypatch):
    monkeypatch.setattr(gram_index, "BATCH_GRAMS", 100)
    texts = [f"{i:04d} some words of text" for i in range(50)]
    batch = pa.record_batch([pa.array(range(50), pa.int64()), pa.array(texts)], ["ord", "hay"])
    out = list(gram_index._partial(iter([batch])))
    assert len(out) > 5
    found = {}
    for b in out:
        for g, s, h in zip(*(b.column(c).to_pylist() for c in ("gram", "segment", "held"))):
            found.setdefault(g, []).extend(gram_index.from_container(h).tolist())
    want = {}
    for i, t in enumerate(texts):
        for g in gram_index.text_grams(t).tolist():
            want.setdefault(g, []).append(i)
    assert {g: sorted(v) for g, v in found.items()} == want


def test_ranges_are_no_literals(spark, tmp_path):
    library = Library(spark, str(tmp_path / "lib"), "k", "at")
    place = library._range([10 * i for i in range(1, 3001)])
    assert len(str(place)) < 1000
    got = spark.createDataFrame([(5,), (10,), (19,), (30000,), (99999,)], "k int").select("k", place.alias("r")).collect()
    assert [tuple(r) for r in got] == [(5, 0), (10, 1), (19, 1), (30000, 3000), (99999, 3000)]
