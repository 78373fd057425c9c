"""Queries of rule chains and of the remaining record operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import rules as R
from ..functions import urls as U
from ..operators import joins as J
from ..operators import trees as G
from ..operators.ordered import numbered
from .registry import query, rows, table, values

TOPICS = """VALUES (1, 'text/html; charset=utf-8', '<p>x', NULL), (2, 'application/pdf', 'x', 'media type'), (3, '', '%PDF-1.4', 'pdf'), (4, 'text/html', ' {"a":1}', 'json placeholder') AS t(id, kind, body, want)"""


@query("s9_topic_gate", f"SELECT id, want AS reason FROM {values(TOPICS)}")
def s9(spark, d):
    return rows(spark, TOPICS).select("id", R.topic_gate(F.col("kind"), F.col("body")).alias("reason"))


STALLS = "VALUES (1,'timeout',5,10,true), (2,'timeout',10,10,false), (3,'refused',0,10,false), (4,'unexpected EOF',NULL,NULL,true) AS t(id, error, sent, wanted, want)"


@query("c7_c11_stalled", f"SELECT id, want AS stalled FROM {values(STALLS)}")
def c11(spark, d):
    return rows(spark, STALLS).select("id", R.stalled(F.col("error"), F.col("sent"), F.col("wanted")).alias("stalled"))


FORMS = "VALUES (1,'direct',true,true,'pdf direct'), (2,'export',true,true,'pdf export'), (3,'advertised',false,true,'html with warning'), (4,'direct',true,false,'html') AS t(id, origin, verified, probed, want)"


@query("c10_pdf_route", f"SELECT id, want AS form FROM {values(FORMS)}")
def c10(spark, d):
    return rows(spark, FORMS).select("id", R.pdf_route(F.col("origin"), F.col("verified"), F.col("probed")).alias("form"))


LABELS = "VALUES (1,'Release 10.13 notes','10.13.1000',false), (2,'Release 10.12','10.13',true), (3,'none','10.13',false) AS t(id, text, release, want)"


@query("v4_release_label", f"SELECT id, want AS differs FROM {values(LABELS)}")
def v4(spark, d):
    return rows(spark, LABELS).select("id", R.release_label_differs(F.col("text"), F.col("release")).alias("differs"))


ENTRIES = "VALUES (1,'https://h/g/a.htm#x',true,'topic'), (2,'https://o/x.html',false,'notice'), (3,'https://h/g/a.zip',true,'error') AS t(id, url, inside, want)"


@query("f11_navigation_class", f"SELECT id, want AS class FROM {values(ENTRIES)}")
def f11(spark, d):
    return rows(spark, ENTRIES).select("id", R.navigation_class(F.col("url"), F.col("inside")).alias("class"))


@query("f7_f8_scope", "SELECT page_id, len([r FOR r IN ['http://', 'https://blog'] IF starts_with(url, r)]) > 0 AND regexp_matches(url, '/en/') AS topic FROM pages")
def f8(spark, d):
    roots = F.array(F.lit("http://"), F.lit("https://blog"))
    return table(spark, d, "pages").select("page_id", (F.exists(roots, lambda r: F.col("url").startswith(r)) & F.col("url").rlike("/en/")).alias("topic"))


PDFV = "VALUES (1, 3, 0, 0, repeat('a', 64), true), (2, 0, 0, 0, repeat('a', 64), false), (3, 1, 1, 1, 'x', false) AS t(id, pages, bookmarks, links, sha, want)"


@query("f16_pdf_records", f"SELECT id, want AS ok FROM {values(PDFV)}")
def f16(spark, d):
    return rows(spark, PDFV).select("id", R.generated_pdf_ok(F.col("pages"), F.col("bookmarks"), F.col("links"), F.col("sha")).alias("ok"))


WRAPS = "VALUES (1,'Guide','',1,3,true), (2,'Guide','u',1,3,false), (3,'Contents','u',4,0,true), (4,'Guide','',2,3,false) AS t(id, title, url, roots, children, want)"


@query("f17_root_wrapper", f"SELECT id, want AS wrapper FROM {values(WRAPS)}")
def f17(spark, d):
    return rows(spark, WRAPS).select("id", R.root_wrapper(F.col("title"), F.col("url"), F.col("roots"), F.col("children")).alias("wrapper"))


LIBS = "VALUES (1,false,false,false,false,false,NULL), (2,true,false,false,false,false,'not a library'), (3,true,true,false,true,false,'other platform'), (4,true,true,true,false,false,'other application version'), (5,true,false,false,false,true,NULL) AS t(id, a, b, c, d, e, want)"


@query("f20_library_identity", f"SELECT id, want AS problem FROM {values(LIBS)}")
def f20(spark, d):
    return rows(spark, LIBS).select("id", R.library_problem(*(F.col(c) for c in "abcde")).alias("problem"))


LOCALS = "VALUES (1,'a/b.html?q=1#f','a/b.html','q=1','f',true), (2,'#f','','','f',true), (3,'https://x/y','https://x/y','','',false) AS t(id, ref, t, q, f, l)"


@query("u12_split_local", f"SELECT id, t AS target, q AS query, f AS fragment, l AS local FROM {values(LOCALS)}")
def u12(spark, d):
    return rows(spark, LOCALS).select("id", R.split_local(F.col("ref")).alias("r")).select("id", "r.*")


@query("u15_export_url", "SELECT p_partkey, 'https://s.example/export/pdf?docId=' || p_brand AS url FROM part")
def u15(spark, d):
    return table(spark, d, "part").select("p_partkey", R.export_url("s.example", F.col("p_brand")).alias("url"))


TITLES = "VALUES (1,'<b>A</b> &amp; <i>b</i>','A & b'), (2,'plain','plain') AS t(id, markup, want)"


@query("x13_markup_title", f"SELECT id, want AS title FROM {values(TITLES)}")
def x13(spark, d):
    return rows(spark, TITLES).select("id", R.markup_text("markup").alias("title"))


@query("s16_pdf_title", "SELECT * FROM (VALUES (1,'A b c'), (2,'AB'), (3,NULL)) AS t(id, title)")
def s16(spark, d):
    fixed = rows(spark, "VALUES (1,'<</Title (A b  c)>>'), (2,'<</Title <FEFF00410042>>>'), (3,'<<>>') AS t(id, body)")
    return fixed.select("id", R.pdf_title(F.encode("body", "UTF-8")).alias("title"))


@query("a23_pdf_counts", "SELECT 1 AS id, 2 AS pages, 1 AS links")
def a23(spark, d):
    one = rows(spark, "VALUES (1, '/Type /Pages /Type /Page x /Type/Page /Subtype /Link') AS t(id, body)")
    return one.select("id", R.pdf_counts(F.col("body")).alias("c")).select("id", "c.*")


@query("s19_file_listing")
def s19(spark, d):
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{d}/region.parquet")
    return found.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length")


STATE = """VALUES (1, '{"version":"0.5","guides":[{"id":"a"}]}', true), (2, '{"version":"0.5","extra":1}', false), (3, '{bad', false) AS t(id, body, want)"""


@query("s22_strict_state", f"SELECT id, want AS valid FROM {values(STATE)}")
def s22(spark, d):
    known = F.array(F.lit("version"), F.lit("guides"))
    parsed = F.from_json("body", "version string, guides array<struct<id:string>>", {"mode": "PERMISSIVE"})
    keys = F.json_object_keys("body")
    return rows(spark, STATE).select("id", F.coalesce(parsed["version"].isNotNull() & (F.size(F.array_except(keys, known)) == 0), F.lit(False)).alias("valid"))


@query("a20_recovery_summary", "SELECT l_suppkey, string_agg(k, ', ' ORDER BY k) AS families FROM (SELECT DISTINCT l_suppkey, l_returnflag || l_linestatus AS k FROM lineitem) GROUP BY 1")
def a20(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.array_join(F.sort_array(F.collect_set(F.concat("l_returnflag", "l_linestatus"))), ", ").alias("families"))


OUT = "VALUES ('t',1,NULL,'Guide',NULL), ('t',2,1,'A','a'), ('t',3,1,'B','b'), ('t',4,3,'A2','a') AS t(tree, ord, parent, title, topic)"


@query("w9_footer_category", "SELECT * FROM (VALUES ('a','A','Guide'), ('b','B','Guide')) AS t(topic, label, category)")
def w9(spark, d):
    o = rows(spark, OUT)
    first = o.where("topic is not null").groupBy("tree", "topic").agg(F.min_by(F.struct("title", "parent"), "ord").alias("r"))
    up = o.select("tree", F.col("ord").alias("p"), F.col("title").alias("up"))
    out = first.select("tree", "topic", "r.title", "r.parent").join(up.withColumnRenamed("tree", "tree_"), (F.col("tree") == F.col("tree_")) & (F.col("parent") == F.col("p")), "left")
    return out.select("topic", F.col("title").alias("label"), F.coalesce("up", "title").alias("category"))


@query("o4_destinations", "SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS pos FROM supplier")
def o4(spark, d):
    return numbered(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), [F.desc("s_acctbal"), "s_suppkey"], "pos").select("s_suppkey", "pos")


@query("o7_first_hundred", "SELECT doc_id FROM documents WHERE contains(lower(text), 'of') ORDER BY doc_id LIMIT 100")
def o7(spark, d):
    return table(spark, d, "documents").where(F.contains(F.lower("text"), F.lit("of"))).select("doc_id").orderBy("doc_id").limit(100)


@query("t3_t4_level_expansion", "SELECT * FROM (VALUES (1,0), (2,1), (3,1), (4,2)) AS t(node, steps)")
def t4(spark, d):
    edges = rows(spark, "VALUES (1,2), (1,3), (2,4), (3,4), (4,1), (9,8) AS t(src, dst)")
    return G.reachable(edges, rows(spark, "VALUES (1) AS t(node)"))


TILES = "VALUES ('g',0,'t0',false), ('g',1,'t1',true), ('g',2,'t2',true) AS t(guide, ord, tile, served)"


@query("t6_first_tile", "SELECT 'g' AS guide, 't1' AS tile")
def t6(spark, d):
    return J.first_served(rows(spark, TILES), "guide", "ord", "served", "tile")


CAPTIONS = "'<p><img src=\"i' || p_size || '.png\" alt=\"' || p_name || '\"></p>'"


@query("h12_captions", "SELECT p_partkey, 0 AS ord, left(sha256('i' || p_size || '.png'), 16) AS identity, p_name AS alt FROM part")
def h12(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.expr(CAPTIONS).alias("html"), F.lit("").alias("url"))
    e = H.extract(p, "p_partkey")
    return e.select("p_partkey", F.explode("images").alias("i")).select("p_partkey", "i.ord", F.left(F.sha2("i.src", 256), F.lit(16)).alias("identity"), "i.alt")
