"""Queries of stylesheets, rewriting, selection and verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import css as S
from ..functions import html as H
from ..functions import rewrite as W
from ..functions import text as T
from ..functions import urls as U
from ..operators import guides as G
from ..operators import joins as J
from ..operators.ordered import numbered
from .registry import query, rows, table, values

SHEETS = """VALUES (1, '@import "a.css"; p{background:url(b.png)} /* url(no) */', 2), (2, '@font-face{src:url("f.woff2")} q{content:"url(x)"}', 1), (3, 'a{b:c}', 0) AS t(id, css, n)"""


@query("h17_css_references", "SELECT * FROM (VALUES (1, 0, 'import', 'a.css'), (1, 1, 'image', 'b.png'), (2, 0, 'font', 'f.woff2')) AS t(id, ord, kind, reference)")
def h17(spark, d):
    return rows(spark, SHEETS).select("id", F.posexplode(S.css_references("css")).alias("ord", "r")).select("id", "ord", "r.*")


@query("h17_css_rewrite", """SELECT * FROM (VALUES (1, 'p{background:url("x/b.png")} ', 1, ['a.css']), (2, '@font-face{src:url("data:,")} q{content:"url(x)"}', 0, ['f.woff2']), (3, 'a{b:c}', 0, []::VARCHAR[])) AS t(id, css, rewritten, lost)""")
def h17b(spark, d):
    out = rows(spark, SHEETS).select("id", S.css_rewrite("css", F.create_map(F.lit("b.png"), F.lit("x/b.png"))).alias("r"))
    return out.select("id", F.regexp_replace("r.css", r"^\s+", "").alias("css"), "r.rewritten", "r.lost")


POLICY = """VALUES (1, 'p{background:url(b.png)}', NULL), (2, 'p{background:url(https://x.example/b.png)}', 'https://x.example/b.png'), (3, '@import "//x/y.css";', '//x/y.css'), (4, 'p{background:url(data:image/png;base64,x)}', NULL) AS t(id, css, want)"""


@query("h19_css_policy", f"SELECT id, want AS problem FROM {values(POLICY)}")
def h19(spark, d):
    return rows(spark, POLICY).select("id", S.css_problem("css").alias("problem"))


SVGS = """VALUES (1, '<svg xmlns="http://www.w3.org/2000/svg"><g id="a" onclick="x()"/><script/></svg>', 2), (2, '<svg', 1), (3, '<svg xmlns="http://www.w3.org/2000/svg"><path id="p" d="M0"/></svg>', 0) AS t(id, svg, n)"""


@query("h21_svg_sanitise", f"SELECT id, n AS n_problems FROM {values(SVGS)}")
def h21(spark, d):
    return rows(spark, SVGS).select("id", F.size(S.svg_sanitise("svg", F.lit("t-"))["problems"]).alias("n_problems"))


@query("h13_sanitise_pages")
def h13(spark, d):
    return table(spark, d, "pages").select("page_id", W.sanitise("html").alias("r")).select("page_id", F.sha2("r.html", 256).alias("sha"), F.size("r.problems").alias("n_problems"))


@query("h14_anchor_actions", """
WITH l AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') AS origin, regexp_extract(url, '^[^?#]*/') AS folder, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages),
a AS (SELECT page_id, href, CASE WHEN href = '' OR starts_with(href, '#') OR starts_with(href, 'javascript:') THEN NULL WHEN regexp_matches(href, '(?i)^https?://') THEN href WHEN starts_with(href, '/') THEN origin || href ELSE folder || href END AS target FROM l),
k AS (SELECT DISTINCT regexp_replace(url, '#.*$', '') AS key FROM pages)
SELECT a.page_id, a.href, CASE WHEN k.key IS NOT NULL THEN 'local' WHEN regexp_matches(a.href, '(?i)^https?://') THEN 'online' WHEN starts_with(a.href, '#') THEN 'fragment' ELSE 'removed' END AS action
FROM a LEFT JOIN k ON k.key = regexp_replace(replace(a.target, '&amp;', '&'), '#.*$', '')""")
def h14(spark, d):
    p = table(spark, d, "pages")
    links = p.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), 1)).alias("href"))
    # the page a link leads to, as seen from its own; void links and fragments lead to none
    aimed = F.when(~U.is_void(F.col("href")) & ~F.startswith(F.trim("href"), F.lit("#")), F.replace("href", F.lit("&amp;"), F.lit("&")))
    links = links.withColumn("target", U.canonical(U.resolve("url", aimed)))
    keys = p.select(U.canonical(U.normalise("url")).alias("key")).distinct()
    out = links.join(keys, F.col("target") == F.col("key"), "left")
    return out.select("page_id", "href", W.anchor_action(F.col("key"), F.col("href"), U.is_online(F.col("href"))).alias("action"))


ALIASES = "VALUES (1,'a','x'), (1,'a','x'), (1,'b','x'), (1,'b','y'), (2,'a','z') AS t(page, name, target)"


@query("h23_bookmark_alias", "SELECT * FROM (VALUES (1,'a','x'), (2,'a','z')) AS t(page, name, target)")
def h23(spark, d):
    pairs = rows(spark, ALIASES).select(F.struct("page", "name").alias("k"), "target")
    return J.unique_targets(pairs, "k", "target").select("k.page", "k.name", "target")


TOC = "VALUES (1, array(array(0), array(0,0), array(1)), array('A','B','C'), array('a','', 'c')) AS t(id, paths, titles, hrefs)"


@query("k3_contents_list", """SELECT 1 AS id, '<ul><li><a href="a">A</a></li><ul><li>B</li></ul><li><a href="c">C</a></li></ul>' AS html""")
def k3(spark, d):
    return rows(spark, TOC).select("id", W.nested_list("paths", "titles", "hrefs").alias("html"))


@query("u6_document_base", "SELECT * FROM (VALUES (1, 'https://h.example/b/'), (2, 'https://h.example/p.html'), (3, NULL)) AS t(id, base)")
def u6(spark, d):
    e = H.extract(rows(spark, "VALUES (1, '<base href=\"/b/\">'), (2, '<p>x'), (3, '<base href=\"/b/\"><base href=\"/c/\">') AS t(id, html)").withColumn("url", F.lit("https://h.example/p.html")), "id", "html", "url")
    return e.select(F.col("id").cast("int").alias("id"), F.when(F.size("bases") == 0, F.col("url")).when(F.size("bases") == 1, U.resolve(F.col("url"), F.get("bases", F.lit(0)))).alias("base"))


# -- selection -------------------------------------------------------------


@query("f12_release_choices", "SELECT r_regionkey AS release, count(n_nationkey) FILTER (n_name < 'J') AS mapped, count(n_nationkey) FILTER (n_name >= 'J') AS failed, CASE WHEN count(n_nationkey) FILTER (n_name < 'J') > 0 THEN NULL WHEN count(n_nationkey) > 0 THEN 'every guide has an error' ELSE 'no mapped guides' END AS reason FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def f12(spark, d):
    documents = table(spark, d, "nation").select(F.col("n_regionkey").alias("release"), F.when(F.col("n_name") >= "J", "bad").alias("error"))
    return G.choices(table(spark, d, "region").select(F.col("r_regionkey").alias("release")), documents)


@query("f13_split_available", "SELECT c_custkey AS guide, CASE WHEN c_acctbal < 0 THEN 'unavailable' WHEN c_acctbal < 5000 THEN 'available' ELSE 'unknown' END AS state, CASE WHEN c_acctbal < 0 THEN 'skipped' ELSE 'selected' END AS decision FROM customer")
def f13(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("guide"), "c_acctbal")
    states = c.where("c_acctbal < 5000").select("guide", F.when(F.col("c_acctbal") < 0, "unavailable").otherwise("available").alias("state"))
    return G.split_available(c.select("guide"), states)


CANDIDATES = "VALUES ('g',0,'peer','u1'), ('g',1,'own','u2'), ('g',2,'peer-pdf','u1'), ('g',3,'x','m'), ('h',0,'own','u2') AS t(guide, ord, origin, url)"


@query("j21_replacements", "SELECT * FROM (VALUES ('g','u1',0,'peer'), ('g','u2',1,'own'), ('h','u2',0,'own')) AS t(guide, url, ord, origin)")
def j21(spark, d):
    return G.replacements(rows(spark, CANDIDATES), rows(spark, "VALUES ('g','m') AS t(guide, url)"))


@query("j4_url_replacement", "SELECT o_orderkey, coalesce(p_name, o_orderpriority) AS url FROM orders LEFT JOIN part ON p_partkey = o_orderkey")
def j4(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "part"), F.col("p_partkey") == F.col("o_orderkey"), "left").select("o_orderkey", F.coalesce("p_name", "o_orderpriority").alias("url"))


CHECKS = "VALUES ('p','a','x'), ('p','a','y'), ('p','b','x'), ('p','c','x'), ('p','a','') AS t(page, target, fragment)"


@query("j8_fragment_checks", "SELECT * FROM (VALUES ('p','a','x','ok'), ('p','a','y','error'), ('p','b','x','warn'), ('p','c','x','online'), ('p','a','','ok')) AS t(page, target, fragment, result)")
def j8(spark, d):
    return G.fragment_checks(rows(spark, CHECKS), rows(spark, "VALUES ('a','x') AS t(target, fragment)"), rows(spark, "VALUES ('a',true), ('b',false) AS t(target, complete)"))


@query("j11_lost_bookmarks", "SELECT l_orderkey AS page, l_partkey AS id FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 2)")
def j11(spark, d):
    made = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("id")).distinct()
    return J.missing(made, table(spark, d, "part").where("p_size > 2").select(F.col("p_partkey").alias("id")), ["id"]).select("page", "id")


@query("j13_j27_positional", "SELECT * FROM (VALUES ('b',1,'y','z'), ('b',2,'w',NULL), ('c',0,NULL,'q')) AS t(branch, ord, left_key, right_key)")
def j13(spark, d):
    a = rows(spark, "VALUES ('b',0,'x'), ('b',1,'y'), ('b',2,'w') AS t(branch, ord, k)")
    b = rows(spark, "VALUES ('b',0,'x'), ('b',1,'z'), ('c',0,'q') AS t(branch, ord, k)")
    return G.positional(a, b, ["branch"], "ord", "k")


@query("j14_output_references", "SELECT count(*) AS checked, count(*) FILTER (p_partkey IS NULL) AS missing FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 3) ON p_partkey = l_partkey")
def j14(spark, d):
    refs = table(spark, d, "lineitem").join(table(spark, d, "part").where("p_size > 3").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return refs.agg(F.count("*").alias("checked"), F.count_if(F.col("p_partkey").isNull()).alias("missing"))


@query("j15_records_name_topics", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j15(spark, d):
    return J.missing(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])


@query("j31_j35_assets", "SELECT * FROM (VALUES ('p','u1','image','f1',NULL), ('p','u2','image',NULL,'http-404'), ('q','u3','font',NULL,'not fetched')) AS t(owner, url, kind, file, failure)")
def j31(spark, d):
    refs = rows(spark, "VALUES ('p','u1','image'), ('p','u2','image'), ('q','u3','font') AS t(owner, url, kind)")
    return G.propagated(refs, rows(spark, "VALUES ('u1','image','f1') AS t(url, kind, file)"), rows(spark, "VALUES ('u2','image','http-404') AS t(url, kind, failure)"))


@query("j34_licence_evidence", "SELECT n_name AS module FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)")
def j34(spark, d):
    n, s = table(spark, d, "nation").withColumnRenamed("n_name", "module"), table(spark, d, "supplier").where("s_acctbal > 9000")
    return G.at_least_one(n, s, n["n_nationkey"] == s["s_nationkey"], "module")


BLOCKS = "VALUES (1,0,10.0,'Intro'), (1,1,20.0,''), (1,2,30.0,'Body'), (2,0,5.0,'Twice'), (2,1,9.0,'Twice') AS t(page, block, y0, text)"


@query("w6_headings", "SELECT * FROM (VALUES ('Intro',1,'Body'), ('Twice',2,'Twice'), ('None',0,NULL)) AS t(anchor, n, next)")
def w6(spark, d):
    return G.headings(rows(spark, BLOCKS), rows(spark, "VALUES ('Intro'), ('Twice'), ('None') AS t(anchor)"))


ADAPTER = "VALUES ('u', 'const ROOT = \"https://d.example/\";\nfunction go ( x ) { return ROOT + x }') AS t(url, body)"


@query("s2_route_contract", "SELECT 'u' AS url, true AS verified, 'https://d.example/' AS root")
def s2(spark, d):
    flat = F.regexp_replace("body", r"\s+", "")
    wanted = F.array(F.lit("functiongo(x)"), F.lit("returnROOT+x"))
    roots = F.regexp_extract_all("body", F.lit(r'ROOT\s*=\s*"([^"]+)"'), 1)
    return rows(spark, ADAPTER).select("url", (F.forall(wanted, lambda s: F.contains(flat, s)) & (F.size(roots) == 1)).alias("verified"), F.get(roots, F.lit(0)).alias("root"))


@query("s10_help_system", "SELECT 1 AS id, 'Data/Tocs/x.js' AS toc")
def s10(spark, d):
    return rows(spark, "VALUES (1, '<WebHelpSystem Toc=\"Data/Tocs/x.js\"/>') AS t(id, body)").select("id", F.expr("xpath_string(body, '/WebHelpSystem/@Toc')").alias("toc"))


@query("o9_hard_ceiling", "SELECT n_nationkey FROM nation")
def o9(spark, d):
    return G.within(table(spark, d, "nation").select("n_nationkey", "n_regionkey"), ["n_regionkey"], 100).select("n_nationkey")


@query("o5_byte_order", "SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) AS pos FROM part")
def o5(spark, d):
    return numbered(table(spark, d, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"], "pos").select("p_partkey", "pos")


@query("e7_equal_records", "SELECT a.o_orderkey, a.o_orderstatus = b.o_orderstatus AND a.o_custkey = b.o_custkey AS same FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1")
def e7(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.struct("o_orderstatus", "o_custkey").alias("r"))
    b = o.select((F.col("o_orderkey") - 1).alias("k"), F.col("r").alias("s"))
    return o.join(b, F.col("o_orderkey") == F.col("k")).select("o_orderkey", F.col("r").eqNullSafe(F.col("s")).alias("same"))


@query("x16_completions", "SELECT n_name FROM nation WHERE starts_with(n_name, 'NATION_1') ORDER BY n_name LIMIT 5")
def x16b(spark, d):
    return table(spark, d, "nation").where(F.col("n_name").startswith("NATION_1")).select("n_name").orderBy("n_name").limit(5)


@query("k11_listing_text", "SELECT c_custkey, c_name || ' [' || CASE WHEN c_acctbal < 0 THEN 'unavailable' ELSE 'available' END || ']' AS line FROM customer")
def k11(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit(" ["), F.when(F.col("c_acctbal") < 0, "unavailable").otherwise("available"), F.lit("]")).alias("line"))


@query("a16_digest_rows", "SELECT url, sha256(html) AS digest FROM pages UNION ALL SELECT url || '#missing', 'missing' FROM pages WHERE strlen(html) < 1500")
def a16(spark, d):
    p = table(spark, d, "pages")
    gone = p.where(F.octet_length("html") < 1500).select(F.concat("url", F.lit("#missing")).alias("url"), F.lit("missing").alias("digest"))
    return p.select("url", F.sha2("html", 256).alias("digest")).unionByName(gone)


@query("x20_display_text", "SELECT doc_id, sha256(regexp_replace(text, '[\\x00-\\x08\\x0B-\\x1F\\x7F]', '', 'g')) AS sha FROM documents")
def x20(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.regexp_replace("text", r"[\x00-\x08\x0B-\x1F\x7F]", ""), 256).alias("sha"))


@query("x12_collapsed_title", r"SELECT p_partkey, trim(regexp_replace(p_type, '[\t\n\f\r ]+', ' ', 'g')) AS title FROM part")
def x12b(spark, d):
    return table(spark, d, "part").select("p_partkey", T.collapse(F.col("p_type")).alias("title"))
