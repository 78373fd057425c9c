"""Queries of sources, sinks, search and state."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import search as Q
from ..operators.gram_index import GramIndex
from ..sources import catalogue as C
from ..sources import sinks as K
from ..sources.shared import shared_root
from .registry import query, rows, table, values

FILES = """VALUES (0, 'g1', '{"10.10": {"p1": "a", "p2": "b"}, "10.13": {"p1": "c"}}'), (1, 'g2', '{"10.10": {"p1": "a", "p1": "b"}}'), (2, 'g3', '{"10.10": {"p1": " "}}'), (3, 'g4', '{"1": {}} x') AS t(guide_ord, guide_id, body)"""


@query("s3_s4_mappings", "SELECT * FROM (VALUES (0,'g1','10.10','p1','a',NULL), (0,'g1','10.10','p2','b',NULL), (0,'g1','10.13','p1','c',NULL), (1,'g2',NULL,NULL,NULL,'duplicate key'), (2,'g3',NULL,NULL,NULL,'invalid mapping'), (3,'g4',NULL,NULL,NULL,'invalid mapping')) AS t(guide_ord, guide_id, release, platform, target, error)")
def s3(spark, d):
    return C.read_mappings(rows(spark, FILES))


@query("s5_strict_json")
def s5(spark, d):
    return table(spark, d, "events").select("event_id", C.canonical_json(F.col("props")).alias("j")).select("event_id", "j.*")


@query("s6_charset", "SELECT doc_id, sha256(text) AS sha FROM documents")
def s6(spark, d):
    body = F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))
    return table(spark, d, "documents").select("doc_id", F.sha2(C.charset_text(body, F.lit("text/html; charset=utf-8")), 256).alias("sha"))


MODULES = """VALUES (1, 'define({a: 1, ''b'': [0x10, .5,], /* c */ "d": null});', '{"a":1,"b":[16,0.5],"d":null}'), (2, 'var links = {"x": "y"};', '{"x":"y"}'), (3, 'alert(1)', NULL) AS t(id, src, want)"""


@query("s7_data_module", f"SELECT id, want AS body FROM {values(MODULES)}")
def s7(spark, d):
    return rows(spark, MODULES).select("id", C.module_body(F.col("src")).alias("body"))


@query("s11_verified_cache", "SELECT page_id, strlen(html) AS size, page_id % 3 != 0 AS valid FROM pages")
def s11(spark, d):
    p = table(spark, d, "pages").select("page_id", F.encode("html", "UTF-8").alias("body"), F.octet_length("html").cast("long").alias("size"), F.when(F.col("page_id") % 3 == 0, "x").otherwise(F.sha2("html", 256)).alias("sha256"))
    return C.verified(p).select("page_id", "size", "valid")


@query("s12_revalidated", "SELECT * FROM (VALUES ('a','h1',5,['ETag']), ('b','h9',5,['ETag']), ('c','h3',1,['ETag']), ('d','h4',5,['ETag'])) AS t(url, sha256, checked_at, names)")
def s12(spark, d):
    cache = spark.sql("SELECT * FROM VALUES ('a','h1',1,map('ETag','1','Set-Cookie','s')), ('b','h2',1,map('ETag','2')), ('c','h3',1,map('ETag','3')) AS t(url, sha256, checked_at, headers)")
    new = spark.sql("SELECT * FROM VALUES ('a',304,cast(null as string),5,cast(null as map<string,string>)), ('b',200,'h9',5,map('ETag','9','Cookie','c')), ('d',200,'h4',5,map('ETag','4')) AS t(url, status, sha256, checked_at, headers)")
    return C.revalidated(cache, new).select("url", "sha256", "checked_at", F.map_keys("headers").alias("names"))


@query("s14_robots", "SELECT status, CASE WHEN status = 200 THEN 'rules' WHEN status BETWEEN 400 AND 499 AND status != 429 THEN 'allow all' ELSE 'stop' END AS policy FROM (VALUES (200), (404), (403), (429), (500), (301)) AS t(status)")
def s14(spark, d):
    return rows(spark, "VALUES (200), (404), (403), (429), (500), (301) AS t(status)").select("status", C.robots_policy(F.col("status")).alias("policy"))


PDFS = "VALUES (1, '%PDF-1.4' || chr(10) || 'xref' || chr(10) || '0 1' || chr(10) || 'startxref 9 %%EOF', NULL), (2, 'GIF89a', 'no header'), (3, '%PDF-1.4 cut', 'no trailer'), (4, '%PDF-1.4 startxref 3 %%EOF', 'no cross-reference') AS t(id, body, want)"


@query("s15_pdf_check", f"SELECT id, want AS problem FROM {values(PDFS)}")
def s15(spark, d):
    return rows(spark, PDFS).select("id", C.pdf_problem(F.encode("body", "UTF-8")).alias("problem"))


XML = """VALUES (1, '<document><page><block><line bbox="1 2 3 4"><font size="9"><char c="H"/><char c="i"/></font></line></block></page></document>') AS t(doc, body)"""


@query("s17_structured_text", "SELECT 1 AS doc, 1 AS page, 0 AS ord, 0 AS block, 'Hi' AS text, 1.0::DOUBLE AS x0, 2.0::DOUBLE AS y0, 3.0::DOUBLE AS x1, 4.0::DOUBLE AS y1, 9.0::DOUBLE AS font")
def s17(spark, d):
    return C.structured_lines(rows(spark, XML))


SUMS = "VALUES (repeat('a', 64) || '  x/y.txt'), (repeat('b', 64) || ' *z.bin'), (repeat('c', 64) || '  z.bin'), ('bad line') AS t(value)"


@query("s20_checksums", "SELECT * FROM (VALUES ('x/y.txt', repeat('a', 64), 1), ('z.bin', repeat('b', 64), 2)) AS t(path, sha256, n)")
def s20(spark, d):
    return C.checksums(rows(spark, SUMS))


@query("s21_last_record", "SELECT l_partkey, l_suppkey, arg_max(l_quantity, (l_orderkey * 10 + l_linenumber) * 100 + l_quantity) AS last FROM lineitem GROUP BY 1, 2")
def s21(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max_by("l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100 + F.col("l_quantity")).alias("last"))


@query("c2_tree_digest", "SELECT left(url, 12) AS root, sha256(string_agg(url || chr(9) || sha256(html), chr(10) ORDER BY url, sha256(html))) AS digest FROM pages GROUP BY 1")
def c2(spark, d):
    p = table(spark, d, "pages").select(F.left("url", F.lit(12)).alias("root"), F.col("url").alias("path"), F.sha2("html", 256).alias("sha256"))
    return C.tree_digest(p, "root")


LINES = "SELECT l_returnflag AS guide, l_orderkey || '/' || l_linenumber AS path, sha256(l_orderkey || '/' || l_linenumber) AS sha256, l_quantity::BIGINT AS size FROM lineitem"


def line_files(spark, d):
    """One file for each line, in a few large trees."""
    path = F.concat(F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"))
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("guide"), path.alias("path"), F.sha2(path, 256).alias("sha256"), F.col("l_quantity").cast("long").alias("size"))


@query("c2_large_trees", f"SELECT guide, sha256(string_agg(path || chr(9) || sha256, chr(10) ORDER BY path)) AS digest FROM ({LINES}) GROUP BY 1")
def c2_large(spark, d):
    return C.tree_digest(line_files(spark, d), "guide")


# -- sinks -----------------------------------------------------------------


@query("k1_guide_index", "SELECT page_id AS ord, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, url, regexp_replace(html, '<[^>]*>', ' ', 'g') AS text, url AS source_url FROM pages")
def k1(spark, d):
    p = table(spark, d, "pages").select(F.col("page_id").alias("ord"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), "url", F.regexp_replace("html", "<[^>]*>", " ").alias("text"), F.col("url").alias("source_url"))
    return K.guide_index(p)


@query("k2_q5_release_index", """
SELECT source AS guide, 0 AS part, 0::BIGINT AS ord, 'Guide ' || source AS title, source || '/index.html' AS url, 'Offline HTML guide.' AS text FROM (SELECT DISTINCT source FROM documents)
UNION ALL SELECT source, 1, doc_id, lang, source || '/' || doc_id || '.html', text FROM documents""")
def k2(spark, d):
    docs = table(spark, d, "documents")
    guides = docs.select(F.col("source").alias("guide")).distinct().select("guide", F.concat(F.lit("Guide "), "guide").alias("title"), F.concat("guide", F.lit("/index.html")).alias("url"), F.lit("html").alias("format"))
    topics = docs.select(F.col("source").alias("guide"), F.col("doc_id").alias("ord"), F.col("lang").alias("title"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".html")).alias("url"), "text")
    return Q.index_rows(guides, topics)


@query("k4_manifest")
def k4(spark, d):
    p = table(spark, d, "pages").select(F.substring_index("url", "/", 3).alias("guide"), F.col("url").alias("path"), F.sha2("html", 256).alias("sha256"), F.octet_length("html").alias("size"))
    return K.manifest_json(p, "guide")


@query("k4_manifest_parts", f"""
WITH f AS (SELECT *, row_number() OVER (PARTITION BY guide ORDER BY path, size) - 1 AS k FROM ({LINES})),
p AS (SELECT guide, k // 1000 AS part, string_agg('{{"path":"' || path || '","sha256":"' || sha256 || '","size":' || size || '}}', ',' ORDER BY k) AS text FROM f GROUP BY ALL)
SELECT guide, -1::BIGINT AS part, '{{"count":' || count(*) || ',"bytes":' || sum(size) || ',"files":[' AS text FROM f GROUP BY guide
UNION ALL SELECT guide, part, CASE WHEN part > 0 THEN ',' ELSE '' END || text FROM p
UNION ALL SELECT DISTINCT guide, 4611686018427387904, ']}}' FROM f""")
def k4_parts(spark, d):
    return K.manifest_parts(line_files(spark, d), "guide")


# -- search ----------------------------------------------------------------

INDEX = "SELECT doc_id AS ord, source AS guide, lang AS title, source || '/' || doc_id || '.html' AS url, text FROM documents"


def index(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.col("source").alias("guide"), F.col("lang").alias("title"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".html")).alias("url"), "text")


@query("q1_release_search", f"""
WITH i AS ({INDEX}), m AS (SELECT *, lower(nfc_normalize(guide || ' ' || title || ' ' || text)) AS hay FROM i), h AS (SELECT * FROM m WHERE contains(hay, 'the') AND contains(hay, 'and') AND contains(hay, 'src1'))
SELECT ord, guide, title, url, (SELECT count(*) FROM h) AS n_matches FROM h ORDER BY ord LIMIT 50""")
def q1(spark, d):
    return Q.release_search(index(spark, d), "The  AND src1").select("ord", "guide", "title", "url", "n_matches")


@query("q2_guide_search", f"SELECT ord, url FROM ({INDEX}) WHERE contains(lower(title || ' ' || text), 'of the') ORDER BY ord LIMIT 100")
def q2(spark, d):
    return Q.guide_search(index(spark, d), " Of the ").select("ord", "url")


@query("q3_snippets", f"""
WITH i AS ({INDEX}), h AS (SELECT * FROM i WHERE contains(lower(guide || ' ' || title || ' ' || text), 'that'))
SELECT ord, substring(text, greatest(strpos(lower(text), 'that') - 1 - 70, 0) + 1, 240) AS snippet FROM h ORDER BY ord LIMIT 50""")
def q3(spark, d):
    return Q.release_search(index(spark, d), "that", ascii_only=True).select("ord", "snippet")


_INDEXES: dict[tuple[str, str, str], GramIndex] = {}


def gram_index(spark, d, kind):
    """The index of a table's texts, built once for an application and table."""
    key = (spark.sparkContext.applicationId, d, kind)
    if key not in _INDEXES:
        hay = Q.release_text() if kind == "release" else Q.guide_text()
        _INDEXES[key] = GramIndex.build(index(spark, d), hay, f"{shared_root(spark)}/grams-{kind}-{uuid.uuid4().hex}")
    return _INDEXES[key]


@query("q1_indexed_search", f"""
WITH i AS ({INDEX}), m AS (SELECT *, lower(nfc_normalize(guide || ' ' || title || ' ' || text)) AS hay FROM i),
h AS (SELECT * FROM m WHERE contains(hay, 'rights') AND contains(hay, 'th') AND contains(hay, 'src'))
SELECT ord, guide, title, url, (SELECT count(*) FROM h) AS n_matches FROM h ORDER BY ord LIMIT 50""")
def q1_indexed(spark, d):
    return Q.release_search_indexed(gram_index(spark, d, "release"), "Rights TH src").select("ord", "guide", "title", "url", "n_matches")


@query("q2_indexed_search", f"SELECT ord, url FROM ({INDEX}) WHERE contains(lower(title || ' ' || text), 'all rights') ORDER BY ord LIMIT 100")
def q2_indexed(spark, d):
    return Q.guide_search_indexed(gram_index(spark, d, "guide"), "  All Rights ").select("ord", "url")


@query("q3_indexed_snippets", f"""
WITH i AS ({INDEX}), h AS (SELECT * FROM i WHERE contains(lower(nfc_normalize(guide || ' ' || title || ' ' || text)), 'qu'))
SELECT ord, (SELECT count(*) FROM h) AS n_matches, substring(text, greatest(strpos(lower(nfc_normalize(text)), 'qu') - 1 - 70, 0) + 1, 240) AS snippet FROM h ORDER BY ord LIMIT 50""")
def q3_indexed(spark, d):
    return Q.release_search_indexed(gram_index(spark, d, "release"), "qu").select("ord", "n_matches", "snippet")


HREFS = "VALUES (1,'a/b.html',true), (2,'../x',false), (3,'a/../../x',false), (4,'a/../x',true), (5,'javascript:x',false), (6,'/x',false), (7,'C:x',false), (8,'./a#../..',true) AS t(id, url, want)"


@query("q4_safe_link", f"SELECT id, want AS safe FROM {values(HREFS)}")
def q4(spark, d):
    return rows(spark, HREFS).select("id", Q.safe_link(F.col("url")).alias("safe"))


# -- state -----------------------------------------------------------------


@query("r2_single_flight", "SELECT regexp_replace(url, '#.*$', '') AS url, min(page_id) AS page_id FROM pages GROUP BY 1")
def r2(spark, d):
    from ..functions.urls import canonical

    return table(spark, d, "pages").groupBy(canonical(F.col("url")).alias("url")).agg(F.min("page_id").alias("page_id"))


