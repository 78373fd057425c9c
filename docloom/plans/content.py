"""Queries of content, evidence, images, styles and policy. The pages are made
of table columns by an expression that both engines read, so that SQL can tell
from the columns what the rules must find."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions import content as C
from ..functions import policy as Y
from ..functions import printing as P
from ..functions import rewrite as W
from ..functions import urls as U
from ..operators import aggregates as A
from ..operators import joins as J
from ..sources import archives as Z
from ..sources import catalogue as S
from ..sources import sinks as K
from ..sources import members as M
from ..sources.shared import shared_root, stored
from .registry import dealt, query, rows, table, values

URL = "'https://h.example/g/p' || p_partkey || '.htm'"


def made(spark, d, html, **more):
    """part with a page of its columns."""
    return dealt(spark, d, "part", "p_partkey").withColumns({"html": F.expr(html), "url": F.expr(URL), **{k: F.expr(v) for k, v in more.items()}})


CONTENT = "CASE p_size % 4 WHEN 0 THEN '<body><nav>menu</nav><main><p>' || p_name || '</p></main></body>' WHEN 1 THEN '<div id=\"mc-main-content\">' || p_name || '</div><main>no</main>' WHEN 2 THEN '<body>x<article>' || p_name || '</article></body>' ELSE '<body><p>' || p_name || '</p></body>' END"


@query("h2_main_content", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'main' WHEN 1 THEN 'div' WHEN 2 THEN 'article' ELSE 'body' END AS element, p_name AS text FROM part")
def h2(spark, d):
    out = C.per_page(made(spark, d, CONTENT, kind="'flare'"), C.main_content, "element string, id string, text string, empty_topic boolean", ["p_partkey"], ["html", "kind"])
    return out.select("p_partkey", "element", "text")


@query("h2_content_of_pages")
def h2b(spark, d):
    p = table(spark, d, "pages").withColumn("kind", F.lit("other"))
    out = C.per_page(p, C.main_content, "element string, id string, text string, empty_topic boolean", ["page_id"], ["html", "kind"])
    return out.select("page_id", "element", F.sha2("text", 256).alias("sha"))


TOPIC = "CASE p_size % 3 WHEN 0 THEN '<article class=\"- topic/topic \"> </article>' WHEN 1 THEN '<article class=\"- topic/topic \"><img src=\"x.png\"></article>' ELSE '<article>' || p_name || '</article>' END"


@query("f5_empty_topic", "SELECT p_partkey, p_size % 3 = 0 AS empty_topic FROM part")
def f5(spark, d):
    out = C.per_page(made(spark, d, TOPIC, kind="'static'"), C.main_content, "element string, id string, text string, empty_topic boolean", ["p_partkey"], ["html", "kind"])
    return out.select("p_partkey", "empty_topic")


@query("s8_html_shape", r"SELECT page_id, regexp_matches(html, '(?i)<(?:html|main|article|body|div|nav)\b') AS accepted FROM pages UNION ALL SELECT -1 - page_id, false FROM pages")
def s8(spark, d):
    p = table(spark, d, "pages").select("page_id", "html")
    stray = p.select((-1 - F.col("page_id")).alias("page_id"), F.concat(F.lit('{"url": "'), "page_id", F.lit('"}')).alias("html"))
    return p.unionByName(stray).select("page_id", C.has_shape(F.col("html")).alias("accepted"))


SHORTCUTS = "'<a href=\"toc.htm\">Contents</a><a href=\"p' || p_partkey || '.htm#x\">Contents</a><a href=\"https://o.example/x.htm\">Table of Contents</a><a href=\"t' || p_size || '.htm#a\">Detailed  table of contents</a><a href=\"toc.htm#b\">contents</a><a href=\"q.htm\">' || p_name || '</a>'"


@query("h8_contents_links", "SELECT p_partkey, 0 AS ord, 'https://h.example/g/toc.htm' AS link FROM part UNION ALL SELECT p_partkey, 1, 'https://h.example/g/t' || p_size || '.htm' FROM part")
def h8(spark, d):
    return C.per_page(made(spark, d, SHORTCUTS, root="'https://h.example/g/'"), C.contents_links, "ord int, link string", ["p_partkey"], ["html", "url", "root"])


PDF = "'<a href=\"' || p_partkey || '.pdf\"' || CASE p_size % 5 WHEN 0 THEN '>Download PDF' WHEN 1 THEN ' type=\"application/pdf\">get' WHEN 2 THEN '>other' WHEN 3 THEN ' rel=\"alternate\">x' ELSE ' download=\"x.pdf\">a</a><a href=\"second.pdf\" download>b' END || '</a><a href=\"https://o.example/o.pdf\">PDF</a>'"


@query("h9_advertised_pdf", "SELECT p_partkey, 'https://h.example/g/' || p_partkey || '.pdf' AS pdf FROM part WHERE p_size % 5 IN (0, 1, 3)")
def h9(spark, d):
    return C.per_page(made(spark, d, PDF), C.advertised_pdfs, "pdf string", ["p_partkey"], ["html", "url"])


TOC = "'<ul><li id=\"i' || p_partkey || '\"><nav class=\"toc' || CASE WHEN p_size % 3 = 0 THEN ' lazy' ELSE '' END || '\"><ul><li>a</li><li>b</li></ul></nav></li></ul><div id=\"toc\"' || CASE WHEN p_size % 2 = 0 THEN ' aria-busy=\"true\"' ELSE '' END || '></div>'"


@query("f9_f10_ancestors", "SELECT p_partkey, 0 AS ord, 'nav' AS element, p_size % 3 = 0 AS lazy, 'i' || p_partkey AS item, 2 AS items FROM part UNION ALL SELECT p_partkey, 1, 'div', p_size % 2 = 0, NULL, 0 FROM part")
def f9(spark, d):
    return C.per_page(made(spark, d, TOC), C.containers, "ord int, element string, lazy boolean, item string, items int", ["p_partkey"], ["html"])


NAV = "'<div class=\"x archive-nav\"><p><a href=\"n\">x</a></p></div><a href=\"' || p_name || '\">y</a><footer class=\"archive-footer\"><a href=\"f\">z</a></footer>'"


@query("f14_excluded_anchors", "SELECT p_partkey, 0 AS ord, 'n' AS href, true AS excluded FROM part UNION ALL SELECT p_partkey, 1, p_name, false FROM part UNION ALL SELECT p_partkey, 2, 'f', true FROM part")
def f14(spark, d):
    return C.per_page(made(spark, d, NAV), C.anchors, "ord int, href string, excluded boolean", ["p_partkey"], ["html"])


# -- evidence --------------------------------------------------------------

SOURCE = "'<table><thead><tr><th> ' || p_brand || '</th></tr></thead></table><pre class=\"screen\">show ' || p_type || chr(10) || 'exit</pre><p>' || p_name || '</p><code>' || p_type || '</code>'"
EVIDENCE = """SELECT 'header' AS kind, p_brand AS value, count(*) AS n FROM part GROUP BY 2
UNION ALL SELECT kind, value, count(*) FROM (SELECT unnest(['command', 'text']) AS kind, 'show ' || p_type AS value FROM part UNION ALL SELECT unnest(['command', 'text']), 'exit' FROM part UNION ALL SELECT unnest(['command', 'text']), p_type FROM part UNION ALL SELECT 'text', p_name FROM part UNION ALL SELECT 'text', p_brand FROM part) GROUP BY 1, 2"""


@query("s18_a22_evidence", EVIDENCE)
def s18(spark, d):
    return A.evidence_counts(C.per_page(made(spark, d, SOURCE), C.evidence, "kind string, value string", ["p_partkey"], ["html"]))


@query("a22_evidence_of_pages")
def a22(spark, d):
    return A.evidence_counts(C.per_page(table(spark, d, "pages"), C.evidence, "kind string, value string", ["page_id"], ["html"]))


COMMAND = "'show interface statistics of ' || lower(p_type) || ' parts'"


@query("j24_explained_repeats", f"""
WITH v AS (SELECT {COMMAND} AS value FROM part UNION SELECT p_name FROM part UNION SELECT 'part ' || p_partkey FROM part), c AS (SELECT DISTINCT {COMMAND} || ' of size ' || p_size AS value FROM part),
t AS (SELECT p_name AS value FROM part WHERE p_size < 10)
SELECT value, (SELECT count(*) FROM t WHERE t.value = v.value) >= 2 OR length(value) >= 32 AND (SELECT count(*) FROM c WHERE starts_with(c.value, v.value) AND length(c.value) > length(v.value)) >= 2 AS explained FROM v""")
def j24(spark, d):
    p = table(spark, d, "part")
    command = F.expr(COMMAND)
    found = p.select(command.alias("value")).union(p.select("p_name")).union(p.select(F.concat(F.lit("part "), "p_partkey"))).distinct()
    commands = p.select(F.concat(command, F.lit(" of size "), "p_size").alias("value"))
    return J.explained(found, p.where("p_size < 10").select(F.col("p_name").alias("value")), commands, "value")


# -- images and styles -----------------------------------------------------

PICTURE = "'<picture><source srcset=\"a' || p_partkey || '.webp 1x, b.webp 2x\"><img src=\"' || p_partkey || CASE WHEN p_size % 2 = 0 THEN '.png' ELSE '.svg' END || '\"></picture><img src=\"x\" type=\"image/png; q=1\">'"


@query("h11_image_candidates", """SELECT p_partkey, 0 AS image, unnest([0, 1, 2]) AS ord, unnest(['a' || p_partkey || '.webp', 'b.webp', p_partkey || '.png']) AS source, unnest(['webp', 'webp', 'png']) AS kind FROM part WHERE p_size % 2 = 0
UNION ALL SELECT p_partkey, 1, 0, 'x', 'png' FROM part""")
def h11(spark, d):
    return C.per_page(made(spark, d, PICTURE), C.image_candidates, "image int, ord int, source string, kind string", ["p_partkey"], ["html"])


IMAGES = "'<p>' || p_name || '</p><img data-src=\"a.png\" src=\"t.png\"><img src=\"m' || p_size || '.png\">'"


@query("h15_rewritten_images", """SELECT p_partkey, '<p>' || p_name || '</p><img src="f/a.png"><img src="m' || p_size || '.png">' AS html, ['https://h.example/g/m' || p_size || '.png'] AS missing FROM part""")
def h15(spark, d):
    p = made(spark, d, IMAGES).withColumn("files", F.create_map(F.lit("https://h.example/g/a.png"), F.lit("f/a.png")))
    return C.per_page(p, C.rewritten_images, "html string, missing array<string>", ["p_partkey"], ["html", "url", "files"])


THUMBS = "CASE p_size % 3 WHEN 0 THEN '<a class=\"MCPopupThumbnailLink\" href=\"' || p_partkey || '.png\"><img class=\"MCPopupThumbnail\" src=\"t.png\" width=\"3\"></a>' WHEN 1 THEN '<img class=\"MCPopupThumbnail\" data-mc-popup-src=\"f.png\" src=\"t.png\">' ELSE '<img class=\"MCPopupThumbnail\" src=\"t.png\">' END"


@query("h16_full_images", """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '<span class="archive-full-image-container"><img class="archive-full-image" src="https://h.example/g/' || p_partkey || '.png"></span>' WHEN 1 THEN '<img class="archive-full-image" src="https://h.example/g/f.png">' ELSE '<img class="MCPopupThumbnail" src="t.png">' END AS html, CASE WHEN p_size % 3 = 2 THEN 'a thumbnail names no full image' END AS problem FROM part""")
def h16(spark, d):
    return C.per_page(made(spark, d, THUMBS), C.full_images, "html string, problem string", ["p_partkey"], ["html", "url"])


STYLED = "'<link rel=\"stylesheet\" href=\"css/S' || p_size || '.css\" data-mc-stylesheet-type=\"table\"><link rel=\"stylesheet\" href=\"css/Other.css\"><table class=\"x TableStyle-S' || p_size || '\"><tr><td>' || p_name || '</td></tr></table>'"
SHEET = "'/* .TableStyle-No { } */ table.TableStyle-S' || p_size || CASE WHEN p_size % 2 = 0 THEN '' ELSE '-Body' END || ' td { content: \".TableStyle-Text{\" }'"


@query("h20_style_families", "SELECT sheet, family, defined, count(*) AS pages FROM (SELECT 'https://h.example/g/css/S' || p_size || '.css' AS sheet, 'TableStyle-S' || p_size AS family, p_size % 2 = 0 AS defined FROM part) GROUP BY 1, 2, 3")
def h20(spark, d):
    p = made(spark, d, STYLED, sheet_text=SHEET)
    used = C.per_page(p, C.table_styles, "sheet string, family string", ["p_partkey"], ["html", "url"])
    defined = C.per_page(p.select("p_partkey", "sheet_text"), C.defined_families, "family string", ["p_partkey"], ["sheet_text"]).select("family", F.lit(True).alias("defined")).distinct()
    return used.groupBy("sheet", "family").agg(F.count("*").alias("pages")).join(defined, "family", "left").fillna(False, ["defined"])


FONTS = "VALUES (1,'url(a.woff2) format(\"woff2\")',true), (2,'local(\"A\")',false), (3,'url(a.woff), url(b.woff)',false), (4,'image-set(url(a.png) 1x)',false), (5,'/* url(x) */ URL(\"a.woff\")',true), (6,'',false) AS t(id, entry, want)"


@query("f19_font_source", f"SELECT id, want AS eligible FROM {values(FONTS)}")
def f19(spark, d):
    single = F.pandas_udf(lambda s: s.map(C.one_font_source), BooleanType())
    return rows(spark, FONTS).select("id", single("entry").alias("eligible"))


POLICY = "CASE p_size % 4 WHEN 0 THEN '<head><meta charset=\"utf-8\"><link rel=\"stylesheet\" href=\"a.css\"></head><p>' || p_name || '</p><a href=\"https://x.example/\">l</a><img src=\"a.png\" srcset=\"b.png 2x\">' WHEN 1 THEN '<script src=\"x.js\"></script>' WHEN 2 THEN '<p onclick=\"x()\">q</p><img src=\"https://h.example/a.png\">' ELSE '<a href=\"javascript:x\">q</a><form action=\"/s\"></form>' END"


@query("h22_output_policy", """SELECT p_partkey, unnest(CASE p_size % 4 WHEN 1 THEN [0] WHEN 2 THEN [0, 1] WHEN 3 THEN [0, 1, 2] ELSE [] END) AS ord, 'page.html: ' ||
unnest(CASE p_size % 4 WHEN 1 THEN ['active <script> element remains in archived output'] WHEN 2 THEN ['event handler attribute onclick on <p>', 'unsanitized src attribute on <img>: https://h.example/a.png'] WHEN 3 THEN ['unsanitized href attribute on <a>: javascript:x', 'active <form> element remains in archived output', 'unsanitized action attribute on <form>: /s'] ELSE [] END) AS problem FROM part""")
def h22(spark, d):
    return C.per_page(made(spark, d, POLICY, name="'page.html'"), Y.policy_problems, "ord int, problem string", ["p_partkey"], ["name", "html"])


VECTOR = """'<svg viewbox="0 0 1 1"><g onclick="x()">' || CASE p_size % 4 WHEN 0 THEN '<use href="#a"/><a href="https://x.example/"></a>' WHEN 1 THEN '<foreignObject><p>' || p_name || '</p></foreignObject>' WHEN 2 THEN '<image xlink:href="https://h.example/' || p_partkey || '.png"></image>' ELSE '<animate attributename="xlink:href"></animate><rect fill="url(https://h.example/f)"></rect>' END || '</g></svg>'"""


@query("h22_vector_policy", """SELECT p_partkey, unnest(range(len(l)))::INT AS ord, 'page.html: ' || unnest(l) AS problem FROM (SELECT p_partkey, ['unsupported SVG attribute onclick on <g>'] ||
CASE p_size % 4 WHEN 0 THEN [] WHEN 1 THEN ['unsupported SVG element <foreignObject>', 'unsupported SVG element <p>'] WHEN 2 THEN ['SVG <image> reference is not local https://h.example/' || p_partkey || '.png']
ELSE ['unsupported SVG element <animate>', 'SVG fill attribute: https://h.example/f'] END AS l FROM part)""")
def h22_vectors(spark, d):
    return C.per_page(made(spark, d, VECTOR, name="'page.html'"), Y.policy_problems, "ord int, problem string", ["p_partkey"], ["name", "html"])


# -- identity --------------------------------------------------------------

SUPPORT = "'https://S.example/hpesc/public/docDisplay?docId=d' || p_partkey"


@query("u10_identity_keys", r"""SELECT p_partkey, unnest(CASE p_size % 3
WHEN 0 THEN ['url:https://S.example/hpesc/public/docDisplay?docId=d' || p_partkey || '&mask=1', 'hpe:https://s.example' || chr(10) || 'd' || p_partkey || chr(10) || 'index.html' || chr(10)]
WHEN 1 THEN ['url:https://s.example/documents/d' || p_partkey || '/html/a.html?x=1', 'hpe:https://s.example' || chr(10) || 'd' || p_partkey || chr(10) || 'a.html' || chr(10) || 'x=1']
ELSE ['url:https://s.example/other/' || p_partkey] END) AS key FROM part""")
def u10(spark, d):
    raw = F.expr(f"CASE p_size % 3 WHEN 0 THEN {SUPPORT} || '&mask=1#top' WHEN 1 THEN 'https://s.example/documents/d' || p_partkey || '/html/a.html?x=1' ELSE 'https://s.example/other/' || p_partkey END")
    return table(spark, d, "part").select("p_partkey", F.explode(U.identity_keys(raw)).alias("key"))


GENUINE = "CASE WHEN p_size % 5 = 4 THEN '<main>no</main>' ELSE '<main class=\"ditasrc\"><h1>' || p_name || '</h1></main>' END"


@query("f6_page_identity", "SELECT p_partkey, CASE p_size % 5 WHEN 1 THEN 'document, page or query mismatch' WHEN 2 THEN 'document header mismatch' WHEN 3 THEN 'page header mismatch' WHEN 4 THEN 'no genuine topic content' END AS problem FROM part")
def f6(spark, d):
    p = made(spark, d, GENUINE, requested=SUPPORT + " || '&page=p.html'", received=SUPPORT + " || '&page=' || CASE WHEN p_size % 5 = 1 THEN 'q.html' ELSE 'p.html' END || '&mask=2'", dh="CASE WHEN p_size % 5 = 2 THEN 'other' ELSE 'd' || p_partkey END", ph="CASE WHEN p_size % 5 = 3 THEN 'other' ELSE '' END")
    seen = C.per_page(p, C.main_elements, "mains int, text string, structured boolean", ["p_partkey", "requested", "received", "dh", "ph"], ["html"])
    identity = lambda c: F.struct(U.document_identity(F.col(c), F.lit("s.example")).alias("i"), F.lower(F.regexp_extract(c, "^[^?#]*", 0)).alias("address"))
    both = seen.withColumns({"a": identity("requested"), "b": identity("received")})
    flat = lambda c: F.struct(F.col(f"{c}.i.document"), F.col(f"{c}.i.page"), F.col(f"{c}.i.query"), F.col(f"{c}.address"))
    both = both.withColumns({"a": flat("a"), "b": flat("b")})
    return both.select("p_partkey", C.page_identity_problem(F.col("a"), F.col("b"), F.col("dh"), F.col("ph"), F.col("mains"), F.col("text"), F.col("structured")).alias("problem"))


# -- rendering and contents ------------------------------------------------

CONTENTS = """'[{"topicName":"' || p_name || '","topicLink":"a' || p_size || '.html#x","children":[{"topicName":"' || p_brand || '","topicLink":"b.html"}]},{"topicName":"Group","children":[{"topicName":"Leaf"}]},{"topicLink":"q.html"}]'"""


@query("t3_support_contents", """SELECT p_partkey, unnest([[0], [0, 0], [1], [1, 0], [2]]) AS path, unnest([p_name, p_brand, 'Group', 'Leaf', NULL]) AS title, unnest(['a' || p_size || '.html', 'b.html', NULL, NULL, NULL]) AS page,
unnest(['x', NULL, NULL, NULL, NULL]) AS fragment, unnest([NULL, NULL, NULL, 'leaf without link', 'no topic name']) AS problem FROM part""")
def t3(spark, d):
    p = table(spark, d, "part").withColumn("json", F.expr(CONTENTS))
    return C.per_page(p, C.support_contents, "path array<int>, title string, page string, fragment string, problem string", ["p_partkey"], ["json"])


@query("k3_topic_pages", """
WITH n AS (SELECT p_partkey, p_name, p_brand, p_size, lag(p_partkey) OVER w AS b, lag(p_name) OVER w AS bn, lead(p_partkey) OVER w AS a, lead(p_name) OVER w AS an FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey))
SELECT p_partkey, sha256('<!doctype html><html lang="en"><head><meta charset="utf-8"><title>' || p_name || ' - ' || p_brand || ' &amp; more</title></head><body class="archive-source-static"><header class="archive-header"><a href="../index.html">' || p_brand || ' &amp; more</a></header><div class="archive-layout"><aside class="archive-toc"><iframe title="Guide contents" src="../toc.html#topic-' || p_partkey || '"></iframe></aside><main class="archive-content"><p>' || p_size || '</p></main></div><nav class="archive-nav">'
|| coalesce('<a rel="prev" href="' || b || '.html">Previous: ' || bn || '</a>', '<span></span>') || '<a href="../index.html">Guide index</a>' || coalesce('<a rel="next" href="' || a || '.html">Next: ' || an || '</a>', '<span></span>')
|| '</nav><footer class="archive-footer"><p>' || CASE WHEN p_size % 2 = 0 THEN 'Copyright' ELSE 'Archived from the publisher source without altering substantive document content.' END || '</p><p><a href="https://h.example/?a=1&amp;b=' || p_partkey || '">View publisher source</a></p></footer></body></html>') AS sha FROM n""")
def k3(spark, d):
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    near = lambda f: (F.concat(f("p_partkey").over(w).cast("string"), F.lit(".html")), f("p_name").over(w))
    p = table(spark, d, "part")
    before, after = near(F.lag), near(F.lead)
    page = W.topic_page(F.concat("p_brand", F.lit(" & more")), F.lit("static"), F.col("p_name"), F.concat(F.lit("https://h.example/?a=1&b="), "p_partkey"), F.concat(F.lit("<p>"), "p_size", F.lit("</p>")), *before, *after, F.when(F.col("p_size") % 2 == 0, "Copyright").otherwise(""), F.col("p_partkey").cast("string"))
    return p.select("p_partkey", F.sha2(page, 256).alias("sha"))


@query("k3_guide_index", """SELECT p_brand, count(*) AS topics, '<!doctype html><title>' || p_brand || '</title><ol class="archive-index">' || string_agg('<li><a href="pages/' || p_partkey || '.html">' || p_name || '</a></li>', '' ORDER BY p_partkey) || '</ol>' AS html FROM part GROUP BY p_brand""")
def k3b(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_partkey", "p_name", F.concat(F.lit("pages/"), "p_partkey", F.lit(".html")).alias("path"))
    return W.index_page(p, "p_brand", "p_partkey", "p_name", "path")


@query("k3_guide_index_parts", """
WITH t AS (SELECT o_orderpriority AS guide, '<li><a href="pages/' || o_orderkey || '.html">Order &lt;' || o_orderkey || '&gt;</a></li>' AS item, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS k FROM orders)
SELECT guide, k // 1000 AS part, string_agg(item, '' ORDER BY k) AS text FROM t GROUP BY ALL
UNION ALL SELECT DISTINCT guide, -1, '<!doctype html><title>' || guide || '</title><ol class="archive-index">' FROM t
UNION ALL SELECT DISTINCT guide, 4611686018427387904, '</ol>' FROM t""")
def k3_parts(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("guide"), "o_orderkey", F.concat(F.lit("Order <"), "o_orderkey", F.lit(">")).alias("title"), F.concat(F.lit("pages/"), "o_orderkey", F.lit(".html")).alias("path"))
    return W.index_parts(o, "guide", "o_orderkey", "title", "path")


@query("h14_linked_images", """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'local' WHEN 1 THEN 'image' WHEN 2 THEN 'online' ELSE 'removed' END AS action FROM part""")
def h14(spark, d):
    p, n = table(spark, d, "part"), F.col("p_size") % 4
    href = F.when(n == 0, "a.html").when(n == 1, "i.png").when(n == 2, "https://o.example/i.png").otherwise("j.png")
    pages, images = F.create_map(F.lit("a.html"), F.lit("pages/a.html")), F.create_map(F.lit("i.png"), F.lit("assets/i.png"))
    out = p.withColumn("href", href)
    return out.select("p_partkey", W.anchor_action(F.try_element_at(pages, F.col("href")), F.col("href"), U.is_online(F.col("href")), F.try_element_at(images, F.col("href"))).alias("action"))


PRINTED = "'<h1 id=\"t\">' || p_name || '</h1><p>See:</p><table><tr><td>x</td></tr></table><div>Run <b>it</b><pre>a</pre></div><p id=\"t\"><a href=\"#t\">up</a><a href=\"n' || (p_size % 2) || '.html\">next</a></p><p> </p><script>x</script>'"


@query("h24_h25_print_sections", """SELECT p_partkey, '<section id="topic-' || p_partkey || '"><h1 id="topic-' || p_partkey || '-t">' || p_name || '</h1><p class="print-chain">See:</p><table><tr><td>x</td></tr></table><div><span class="print-leadin">Run <b>it</b></span><pre class="print-keep">a</pre></div><p><a href="#topic-' || p_partkey || '-t">up</a><a href="'
|| CASE WHEN p_size % 2 = 0 THEN '#topic-0' ELSE 'n1.html' END || '">next</a></p><p class="print-blank"> </p></section>' AS html, ['topic-' || p_partkey || '-t'] AS bookmarks, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS inside, CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1 END AS outside FROM part""")
def h25(spark, d):
    return printed(spark, d).drop("ord")


def printed(spark, d):
    p = dealt(spark, d, "part", "p_partkey").withColumns({"page": F.expr(PRINTED), "anchor": F.expr("'topic-' || p_partkey"), "destinations": F.create_map(F.lit("n0.html"), F.lit("topic-0")), "ord": F.col("p_partkey")})
    return C.per_page(p, P.section, "html string, bookmarks array<string>, inside int, outside int", ["p_partkey", "ord"], ["page", "anchor", "destinations"])


@query("k10_combined_document", """SELECT p_brand, count(*) AS sections, sum(CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END) AS inside, min(p_partkey) AS first, max(p_partkey) AS last FROM part GROUP BY p_brand""")
def k10(spark, d):
    """The documents' inventories; the sections themselves go to a sink."""
    made = printed(spark, d).join(table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey")
    return made.groupBy("p_brand").agg(F.count("*").alias("sections"), F.sum("inside").alias("inside"), F.min("ord").alias("first"), F.max("ord").alias("last"))


# -- sources and sinks -----------------------------------------------------

ROBOTS = "VALUES (1,'User-agent: *' || chr(10) || 'Disallow: /x # no',NULL,NULL), (2,'# nothing',NULL,NULL), (3,'<html>',NULL,'directive'), (4,'Disallow: /',NULL,'rule before any user-agent'), (5,'User-agent:',NULL,'empty user-agent'), (6,'X-Own: 1',NULL,'nothing recognisable'), (7,'User-agent: a','text/html','content type'), (8,'User-agent: *' || chr(10) || 'Crawl-delay: soon',NULL,'crawl-delay'), (9,'Sitemap: ftp',NULL,'sitemap'), (10,'Host: a/b',NULL,'host') AS t(id, body, kind, want)"


@query("s14_robots_body", f"SELECT id, want AS problem FROM {values(ROBOTS)}")
def s14(spark, d):
    return rows(spark, ROBOTS).select("id", S.robots_problem(F.encode("body", "UTF-8"), F.col("kind").cast("string")).alias("problem"))


def guide_files(spark, d):
    return table(spark, d, "pages").select((F.col("page_id") % 7).alias("guide"), F.concat(F.lit("pages/"), "page_id", F.lit(".html")).alias("name"), F.col("html").cast("binary").alias("body"))


@query("s23_archive_members", "SELECT page_id % 7 AS guide, 'pages/' || page_id || '.html' AS name, strlen(html) AS size, sha256(html) AS sha256, NULL::VARCHAR AS problem FROM pages")
def s23(spark, d):
    return Z.members(Z.export(guide_files(spark, d), "guide"), "guide")


#: Limits of archives whose SQL has none: a host may have any number of pages.
WHOLE = M.Limits(members=1 << 31, total_bytes=1 << 62)


@query("k7_verified_export", "SELECT DISTINCT page_id % 7 AS guide, true AS verified FROM pages")
def k7(spark, d):
    """Seven guides, however many pages: archives of files, of any size."""
    return M.verified_archives(guide_files(spark, d), "guide", archive_folder(spark, "verified"), limits=WHOLE).select("guide", "verified")


HOSTED = "SELECT array_to_string(string_split(url, '/')[1:3], '/') AS guide, CASE WHEN strlen(html) < 1500 THEN '../' || page_id ELSE 'pages/' || page_id || '.html' END AS name, html, strlen(html) < 1500 AS bad FROM pages"


def hosted(spark, d, refuse=True):
    """The pages of each host as files; the small ones have names that climb."""
    small = F.lit(refuse) & (F.octet_length("html") < 1500)
    name = F.when(small, F.concat(F.lit("../"), "page_id")).otherwise(F.concat(F.lit("pages/"), "page_id", F.lit(".html")))
    return table(spark, d, "pages").select(F.substring_index("url", "/", 3).alias("guide"), name.alias("name"), F.col("html").alias("body"))


def archive_folder(spark, kind):
    return f"{shared_root(spark)}/{kind}-{uuid.uuid4().hex}"


MEMBERS = f"SELECT guide, name, strlen(html) AS size, CASE WHEN NOT bad THEN sha256(html) END AS sha256, CASE WHEN bad THEN 'name' END AS problem FROM ({HOSTED})"


@query("s23_zip_files", MEMBERS)
def s23_zip(spark, d):
    made = stored(M.write_archives(hosted(spark, d), "guide", archive_folder(spark, "zip")), "archives")
    return M.read_members(M.zip_members(made, "guide", limits=WHOLE), "guide").select("guide", "name", "size", "sha256", "problem")


@query("s23_tar_files", MEMBERS)
def s23_tar(spark, d):
    made = stored(M.write_archives(hosted(spark, d), "guide", archive_folder(spark, "tar"), "tar.gz"), "archives")
    return M.tar_members(made, "guide", limits=WHOLE).select("guide", "name", "size", "sha256", "problem")


@query("s19_folder_tree", f"SELECT 'part-' || strlen(html) % 10 || '/pages/' || page_id || '.html' AS path, strlen(html) AS size, NULL::VARCHAR AS problem FROM pages")
def s19_tree(spark, d):
    folder = archive_folder(spark, "tree")
    place = F.concat(F.lit("part-"), F.octet_length("html") % 10, F.lit("/pages/"), "page_id", F.lit(".html"))
    stored(M.write_files(table(spark, d, "pages").select(place.alias("name"), F.col("html").alias("body")), folder), "written")
    return M.list_folder(spark, folder)


@query("k7_archive_files", f"SELECT array_to_string(string_split(url, '/')[1:3], '/') AS guide, count(*) AS members, true AS verified FROM pages GROUP BY 1")
def k7_files(spark, d):
    return M.verified_archives(hosted(spark, d, refuse=False), "guide", archive_folder(spark, "export"), limits=WHOLE).drop("path")


@query("k8_escaped_json", """SELECT p_partkey, '{"name":"' || p_name || '\\u007f\\u202e\\ud834\\udd73 é"}' AS json FROM part""")
def k8(spark, d):
    name = F.concat("p_name", F.lit("\x7f\u202e\U0001d173 é"))
    return table(spark, d, "part").select("p_partkey", K.escaped_json(F.struct(name.alias("name"))).alias("json"))
