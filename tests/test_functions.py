import pytest
from pyspark.sql import functions as F

from docloom.functions import html, text, urls
from docloom.sources import catalogue


@pytest.mark.parametrize(
    "raw, want",
    [
        ("HTTP://Host.example:80/a b?q=1+2&z=%20#f", "http://Host.example:80/a%20b?q=1+2&z=%20#f"),
        ("https://h.example/ü", "https://h.example/%C3%BC"),
        ("https://user@h.example/", None),
        ("https://h.example:0/", None),
        ("https://h.example:/", None),
        ("https://h.example/%zz", None),
        ("https://h.example/a\\b", None),
        ("https://h.example/a\nb", None),
        ("ftp://h.example/", None),
        ("https://[::1]:8080/x", "https://[::1]:8080/x"),
        ("https://[nope]/x", None),
        (None, None),
    ],
)
def test_normalised_url(raw, want):
    assert urls.normalised(raw) == want


def test_html_extraction():
    page = "<html><head><title>A &amp; B</title><link rel='stylesheet' href='s.css'><meta name='Author' content='x'></head><body><nav>skip</nav><h1>One <b>two</b></h1><ul><li><a href='a'>A</a><ul><li><a href='b'>B</a></ul><li>C</ul><p id=p1>x<p>y<script>no</script><img src=i.png><a name=anc href='#z'>l</a></body>"
    row = dict(zip((c.split(" ")[0] for c in __import__("re").split(r", (?=\w+ )", html.COLUMNS)), html.parse(page)))
    assert row["title"] == "A & B" and row["h1"] == ["One two"]
    assert [x[1] for x in row["links"]] == ["a", "b", "#z"]
    assert row["ids"] == ["p1", "anc"] and row["styles"] == ["s.css"] and row["metadata"] == {"author": "x"}
    assert [(p, t) for p, t, _ in row["toc"]] == [([0], "A"), ([0, 0], "B"), ([1], "C")]
    assert "no" not in row["text_joined"] and "skip" not in row["body_text"]
    assert not row["has_password"] and row["has_script"]


def test_strict_json():
    assert catalogue.strict_json('﻿{"a": 0x10}'.replace("0x10", "10")) == {"a": "10"}
    for bad in ('{"a":1,"a":2}', '{"a":1} x', "{"):
        with pytest.raises(ValueError):
            catalogue.strict_json(bad)
    assert catalogue.json5("{a:[1,0x0F,],'b':/*c*/\"d\"}") == '{"a":[1,15],"b":"d"}'


def test_safe_stem(spark):
    names = ["  Ünder the Sea.pdf ", "a" * 100, "...", "x .. y", None, "日本" * 30]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(text.safe_stem(F.col("n"))).collect()]
    assert got == ["Ünder-the-Sea-pdf", "a" * 60, "resource", "x-y", None, "日本" * 10]


def test_plan_pushes_filters_and_prunes_columns(spark):
    from docloom import plans

    df = plans.QUERIES["j2_override"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(c_acctbal,0.0)" in plan and "c_mktsegment" not in plan
