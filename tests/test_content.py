"""Expected rows of rules that SQL cannot express, on small pages."""

import zipfile
from io import BytesIO

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from docloom import plans
from docloom.functions import content as C
from docloom.functions import dom, printing
from docloom.operators import aggregates, guides, incremental, trees
from docloom.sources import archives, sinks

PAGE = """<!DOCTYPE html><html><head><title> The  title </title><link rel="stylesheet" href="a.css"><link rel="alternate stylesheet" href="b.css"><link rel="icon" href="c">
<script>var x = "<p>no</p>"</script></head><body><nav><ul><li><a href="one.htm">One</a><ul><li><a href="two.htm">Two</a></ul><li>Group</ul></nav>
<article><h1></h1><h2>Second&nbsp;heading</h2><p>Text&amp;more<p>and <b>bold</b><table><tr><td>cell<td>next</table></article><footer>foot</footer></body></html>"""
ERROR = "<title>Access denied</title><p>x"
EMPTY = "<html><body><div> </div></body></html>"
LOGIN = "<p>sign</p><input type=password>"


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pages"))
    bodies = [PAGE, ERROR, EMPTY, LOGIN, None]
    spark.createDataFrame([(i, f"https://h.example/d/p{i}.htm?b=2&a=1#f", t) for i, t in enumerate(bodies)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


def found(spark, folder, name, page=0):
    return [tuple(r)[1:] for r in plans.QUERIES[name](spark, folder).collect() if r.page_id == page]


def test_extracted_pages(spark, pages):
    assert found(spark, pages, "h1_extract") == [("The title", 27, 2, 0, 3, False, True)]
    assert found(spark, pages, "h3_page_title") == [("Second heading",)]
    assert found(spark, pages, "h3_page_title", 4) == [(None,)] or found(spark, pages, "h3_page_title", 4) == [("",)]
    assert found(spark, pages, "h7_stylesheets") == [(0, "a.css"), (1, "b.css")]
    assert found(spark, pages, "t1_nested_list_toc") == [([0], "One", "one.htm"), ([0, 0], "Two", "two.htm"), ([1], "Group", None)]
    problems = {i: found(spark, pages, "f4_content_validity", i) for i in range(5)}
    assert problems == {0: [(None,)], 1: [("error",)], 2: [("empty",)], 3: [("login",)], 4: [("empty",)]}


def test_element_texts(spark, pages):
    from hashlib import sha256

    joined, spaced, body = found(spark, pages, "x1_x2_x3_element_texts")[0]
    hashed = lambda t: sha256(t.encode()).hexdigest()
    assert body == hashed("Second\xa0heading Text&more and bold cell next")
    assert spaced == hashed("One Two Group Second\xa0heading Text&more and bold cell next foot")
    assert joined == hashed("OneTwoGroup Second headingText&moreand boldcellnextfoot")


def test_content_in_order_of_rules():
    assert C.main_content("<main>a</main><div id=mc-main-content>b</div>", "flare")[0][:3] == ("div", "mc-main-content", "b")
    assert C.main_content("<body><p>a</body>", "static") == []
    assert C.main_content("<div class='x wh_topic_content'>s</div><main>m</main>", "static")[0][2] == "s"
    assert C.main_content(None, "other") == []


def test_evidence_counts_outer_commands_once():
    rows = C.evidence("<div class=screen><pre class=codeblock>a  b\nc</pre></div><code>x<code>y</code></code><p>a b</p>")
    assert sorted(rows) == sorted([("command", "a b"), ("command", "c"), ("text", "a b"), ("text", "c"), ("text", "xy"), ("command", "xy"), ("text", "a b")])


def test_evidence_ceiling(spark):
    rows = spark.createDataFrame([("text", "a"), ("text", "b")], "kind string, value string")
    assert aggregates.evidence_counts(rows, 2).count() == 2
    with pytest.raises(Exception, match="more than 1 values"):
        aggregates.evidence_counts(rows, 1).collect()


def test_images():
    assert C.image_candidates("<img src='a.png' type='image/jpeg'><img data-src='b.gif' src='b.gif'><img src='data:x'>") == [(1, 0, "b.gif", "gif"), (2, 0, "data:x", "data")]
    html, missing = C.rewritten_images("<img srcset='a.png 1x, b.png 2x'><td background='a.png'>", "https://h/x/", {"https://h/x/a.png": "f/a.png"})[0]
    assert html == '<img srcset="f/a.png 1x, b.png 2x"><td background="f/a.png"></td>' and missing == ["https://h/x/b.png"]
    assert C.full_images("<a class=MCPopupThumbnailLink href=x></a>", "https://h/")[0][1] == "a popup must hold exactly one image"


def test_markup_round_trip():
    for text in ('<p a="1&amp;2">x &lt; y<br></p>', "<script>a < b && c</script>", "<ul><li>a</li><li>b</li></ul>"):
        assert dom.markup(dom.tree(text)) == text
    assert dom.markup(dom.tree("<ul><li>a<li>b")) == "<ul><li>a</li><li>b</li></ul>"


def test_exactly_one_and_ceiling_fail(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    assert guides.within(rows, ["k"], 2).count() == 4
    assert guides.exactly_one(rows.where("v != 'b'"), ["k"]).count() == 3
    with pytest.raises(PySparkException, match="more than one entry"):
        guides.exactly_one(rows, ["k"]).collect()
    with pytest.raises(PySparkException, match="more than 1 entries"):
        guides.within(rows, ["k"], 1).collect()


def test_chain_ends_and_fails(spark):
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    stops = frame([("toc",)], "node string")
    go = lambda links, start, steps=50: [(r.start, r.step, r.node) for r in trees.chain(frame(links, "src string, dst string"), frame([(start,)], "node string"), stops, steps).orderBy("step").collect()]
    assert go([("a", "b"), ("b", "a")], "a") == [("a", 1, "b")]  # a cycle ends it
    assert go([("a", "toc")], "a") == []
    with pytest.raises(ValueError, match="conflicting"):
        go([("a", "b"), ("b", "c"), ("b", "d")], "a")
    assert go([("a", "b"), ("x", "c"), ("x", "d")], "a") == [("a", 1, "b")]  # a conflict that is not on the way
    with pytest.raises(ValueError, match="more than 2"):
        go([("a", "b"), ("b", "c"), ("c", "d")], "a", 2)


def test_large_and_deep_trees(spark):
    n = 1_200_000  # more rows than recursive SQL takes
    nodes = spark.range(n).select(F.lit("t").alias("tree"), F.col("id").alias("node"), F.when(F.col("id") > 0, F.floor((F.col("id") - 1) / 200)).cast("long").alias("parent"), F.col("id").alias("ord"))
    got = trees.preorder(nodes).agg(F.count("*").alias("n"), F.max("depth").alias("d")).first()
    assert (got.n, got.d) == (n, 4)
    chain = [("t", i, i - 1 if i else None, 0) for i in range(130)]
    with pytest.raises(ValueError, match="deeper"):
        trees.preorder(spark.createDataFrame(chain, "tree string, node int, parent int, ord int"))


def test_interrupted_publications_are_settled(spark, tmp_path):
    target = f"{tmp_path}/library"
    sinks.publish(spark.range(3), target)
    with pytest.raises(ValueError, match="bad"):
        sinks.publish(spark.range(5), target, lambda df: "bad")
    assert spark.read.parquet(target).count() == 3
    # cut off between the two renames: the old state comes back
    (tmp_path / "library").rename(tmp_path / "_staging-1-old")
    spark.range(9).write.parquet(f"{tmp_path}/_staging-1")
    sinks.write_text(spark, f"{tmp_path}/_journal-1.json", f'{{"target": "{target}", "stage": "{tmp_path}/_staging-1", "old": "{tmp_path}/_staging-1-old"}}')
    assert sinks.recover(spark, str(tmp_path)) == [target]
    assert spark.read.parquet(target).count() == 3
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["library"]
    assert sinks.recover(spark, str(tmp_path)) == []


def test_archive_members_are_refused(spark):
    body = BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        for name in ("ok.html", "OK.HTML", "../up", "/abs", "a//b", "c:x"):
            z.writestr(name, "x")
        link = zipfile.ZipInfo("link")
        link.create_system, link.external_attr = 3, 0o120777 << 16
        z.writestr(link, "target")
        odd = zipfile.ZipInfo("bz")
        odd.compress_type = zipfile.ZIP_BZIP2
        z.writestr(odd, "x")
    rows = archives.members(spark.createDataFrame([(1, bytearray(body.getvalue())), (2, bytearray(b"no zip"))], "k int, body binary"), "k").collect()
    got = {r.name: r.problem for r in rows if r.k == 1}
    assert got == {"ok.html": None, "OK.HTML": "repeated name", "../up": "name", "/abs": "name", "a//b": "name", "c:x": "name", "link": "link", "bz": "compression"}
    assert [(r.name, r.problem) for r in rows if r.k == 2] == [(None, "no archive")]


def test_export_tells_what_differs(spark):
    files = spark.createDataFrame([("g", "a", bytearray(b"x")), ("g", "b", None), ("h", "../a", bytearray(b"x"))], "g string, name string, body binary")
    got = {r.g: r.verified for r in archives.verified_export(files, "g").collect()}
    assert got == {"g": True, "h": False}


def test_combined_document_is_in_reading_order(spark, tmp_path):
    rows = spark.range(500).select(F.col("id").alias("ord"), F.concat(F.lit("<section>"), "id", F.lit("</section>")).alias("html")).orderBy(F.desc("ord"))
    sinks.write_document(rows, f"{tmp_path}/book")
    text = "".join(p.read_text() for p in sorted((tmp_path / "book").glob("part-*")))
    assert text.split() == [f"<section>{i}</section>" for i in range(500)]


def test_print_marks():
    made = lambda text: printing.section(text, "t", {})[0][0]
    long = "\n".join("x" * 3 for _ in range(9))
    assert made(f"<pre>{long}</pre>") == f'<section id="t"><pre>{long}</pre></section>'
    assert made("<p>a:</p><p>b</p><ul><li>c</ul>").startswith('<section id="t"><p class="print-chain">a:')
    assert made("<p>a:</p><p>b</p><p>c</p>").startswith('<section id="t"><p>a:')
    assert made("<ul><li>do<ol><li>x</ol></ul>") == '<section id="t"><ul><li><span class="print-leadin">do</span><ol><li>x</li></ol></li></ul></section>'
    assert made(None) == '<section id="t"></section>'


def test_progress_and_pacing(spark):
    d = spark.createDataFrame([(0, 0), (1, 3), (3, 3), (999, 1000), (-1, 5), (1, None)], "done int, total int")
    assert [r.p for r in d.select(incremental.progress(F.col("done"), F.col("total")).alias("p")).collect()] == [0, 33, 100, 99, 0, 0]
    requests = spark.createDataFrame([("o", 1, 0.0), ("o", 2, 0.0), ("o", 3, 5.0), ("p", 4, 1.0)], "origin string, id int, at double")
    assert {r.id: r.start for r in incremental.paced(requests, "origin", "at", "id", 2.0).collect()} == {1: 0.0, 2: 2.0, 3: 5.0, 4: 1.0}
