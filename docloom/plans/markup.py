"""Queries of the HTML extractor and of page filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from .registry import dealt, query, rows, table, values


@query("h1_extract")
def h1(spark, d):
    e = H.extract(table(spark, d, "pages"))
    return e.select("page_id", "title", "n_elements", F.size("links").alias("n_links"), F.size("ids").alias("n_ids"), F.size("toc").alias("n_items"), "has_password", "has_script")


@query("h3_page_title")
def h3(spark, d):
    e = H.extract(table(spark, d, "pages"))
    first = lambda c: F.nullif(F.get(F.filter(F.col(c), lambda h: h != ""), F.lit(0)), F.lit(""))
    return e.select("page_id", F.coalesce(first("h1"), first("h2"), "title").alias("title"))


#: A page of a part's columns, as both engines read it.
HEADED = "'<meta charset=\"u\"><meta name=\"Author\" content=\"' || p_brand || '\"><meta name=\"author\" content=\"no\"><h2 id=\"a' || p_size || '\">x</h2><a name=\"b\">y</a><p id=\"a' || p_size || '\"><i name=\"c\">'"


def headed(spark, d):
    return H.extract(dealt(spark, d, "part", "p_partkey").select("p_partkey", F.expr(HEADED).alias("html"), F.lit("").alias("url")), "p_partkey")


@query("h4_metadata", "SELECT p_partkey, 'author' AS name, p_brand AS value FROM part")
def h4(spark, d):
    return headed(spark, d).select("p_partkey", F.explode("metadata").alias("name", "value"))


@query("h5_ids", "SELECT p_partkey, 0 AS ord, 'a' || p_size AS fragment FROM part UNION ALL SELECT p_partkey, 1, 'b' FROM part")
def h5(spark, d):
    return headed(spark, d).select("p_partkey", F.posexplode("ids").alias("ord", "fragment"))


@query("h6_links", """
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS raw FROM pages), h AS (SELECT page_id, replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS href FROM l)
SELECT page_id, href, regexp_extract(href, '#(.*)$', 1) AS fragment FROM h""")
def h6(spark, d):
    links = H.extract(table(spark, d, "pages")).select("page_id", F.explode("links").alias("l")).select("page_id", F.col("l.href").alias("href"))
    return links.select("page_id", "href", F.regexp_extract("href", "#(.*)$", 1).alias("fragment"))


@query("h7_stylesheets")
def h7(spark, d):
    e = H.extract(table(spark, d, "pages"))
    return e.select("page_id", F.posexplode_outer("styles").alias("ord", "style"))


SETS = "VALUES (1, 'a.png 1x, b.png 2x'), (2, 'c.png'), (3, 'd.png 100w,e.png 200w') AS t(id, value)"


@query("h10_srcset", "SELECT * FROM (VALUES (1, 0, 'a.png', '1x'), (1, 1, 'b.png', '2x'), (2, 0, 'c.png', ''), (3, 0, 'd.png', '100w'), (3, 1, 'e.png', '200w')) AS t(id, ord, url, descriptor)")
def h10(spark, d):
    return rows(spark, SETS).select("id", F.posexplode(H.srcset(F.col("value"))).alias("ord", "x")).select("id", "ord", "x.*")


@query("t1_nested_list_toc")
def t1(spark, d):
    e = H.extract(table(spark, d, "pages"))
    return e.select("page_id", F.explode("toc").alias("t")).select("page_id", "t.path", "t.title", "t.href")


@query("x1_x2_x3_element_texts")
def x123(spark, d):
    e = H.extract(table(spark, d, "pages"))
    return e.select("page_id", F.sha2("text_joined", 256).alias("joined"), F.sha2("text_spaced", 256).alias("spaced"), F.sha2("body_text", 256).alias("body"))


PAGES = "VALUES (1, '<title>404 Not found</title>', false), (2, '<title>Page not found</title><p>x', true), (3, '<h1>Access denied</h1>', true), (4, '<title>Guide</title><p>text', false), (5, '<title>Errors in use</title>', false), (6, '<input type=password>', true) AS t(id, html, want)"


@query("f3_error_page", f"SELECT id, want AS refused FROM {values(PAGES)}")
def f3(spark, d):
    e = H.extract(rows(spark, PAGES).withColumn("url", F.lit("")), "id", "html", "url")
    bad = F.exists(F.concat(F.array("title"), "h1"), lambda h: h.rlike(H.ERROR_TITLE)) | F.col("has_password")
    return e.select(F.col("id").cast("int").alias("id"), bad.alias("refused"))


@query("f4_content_validity")
def f4(spark, d):
    e = H.extract(table(spark, d, "pages"))
    reason = H.content_problem(F.col("title"), F.col("h1"), F.col("text_spaced"), F.col("body_text"), F.col("has_password"), F.col("has_script"), F.size("images"))
    return e.select("page_id", reason.alias("problem"))


@query("h18_selector_relevance", """
WITH s AS (SELECT * FROM (VALUES (1, ['a','b'], []::VARCHAR[]), (2, ['a','x'], []::VARCHAR[]), (3, []::VARCHAR[], ['top']), (4, []::VARCHAR[], []::VARCHAR[])) AS t(id, classes, ids))
SELECT id, list_has_all(['a','b','c'], classes) AND list_has_all(['top'], ids) AS relevant FROM s""")
def h18(spark, d):
    s = rows(spark, "VALUES (1, array('a','b'), array()), (2, array('a','x'), array()), (3, array(), array('top')), (4, array(), array()) AS t(id, classes, ids)")
    used, ids = F.array(*map(F.lit, "abc")), F.array(F.lit("top"))
    return s.select("id", (F.forall(F.col("classes").cast("array<string>"), lambda c: F.array_contains(used, c)) & F.forall(F.col("ids").cast("array<string>"), lambda c: F.array_contains(ids, c))).alias("relevant"))
