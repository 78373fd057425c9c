from docloom import plans


def test_local_targets_are_known_from_all_pages(spark, tmp_path):
    link = lambda *hrefs: "".join(f'<a class="x" href="{h}">t</a>' for h in hrefs)
    url = lambda i: f"https://a.example/docs/p{i}.html"
    want = {
        "p45.html": "local",  # relative, to a page past the first 40
        "/docs/p59.html#part": "local",
        "https://a.example/docs/p41.html": "local",
        "p3.html": "local",
        "https://a.example/docs/p99.html": "online",
        "p99.html": "removed",
        "#here": "fragment",
        "": "removed",
        "javascript:void(0)": "removed",
        "/q?a=1&amp;b=2": "local",
    }
    pages = [(0, url(0), link(*want))] + [(i, url(i), "") for i in range(1, 60)] + [(60, "https://a.example/q?a=1&b=2#top", link("docs/p50.html"))]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = plans.QUERIES["h14_anchor_actions"](spark, str(tmp_path)).collect()
    assert {r.href: r.action for r in found if r.page_id == 0} == want
    assert [(r.href, r.action) for r in found if r.page_id == 60] == [("docs/p50.html", "local")]
    assert len(found) == len(want) + 1
