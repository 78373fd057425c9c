"""Queries of text, name, URL, release and class functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import releases as R
from ..functions import text as T
from ..functions import urls as U
from ..operators.ordered import numbered
from .registry import query, rows, table, values

RE2_WORDS = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{Nd}}]+', ' ', 'g'))"
SINGULAR = "array_to_string([CASE WHEN strlen(w) > 4 AND suffix(w, 'ies') THEN w[:-4] || 'y' WHEN strlen(w) > 3 AND suffix(w, 's') AND NOT suffix(w, 'ss') THEN w[:-2] ELSE w END FOR w IN string_split(" + RE2_WORDS + ", ' ')], ' ')"


@query("x4_title_words", f"SELECT doc_id, {RE2_WORDS.format('text')} AS words FROM documents")
def x4(spark, d):
    return table(spark, d, "documents").select("doc_id", T.title_words(F.col("text")).alias("words"))


@query("x5_singular_words", f"SELECT p_partkey, {SINGULAR.format('p_name')} AS words FROM part")
def x5(spark, d):
    return table(spark, d, "part").select("p_partkey", T.singular_words(F.col("p_name")).alias("words"))


@query("x6_title_names_guide", f"""
SELECT a.p_partkey, b.p_partkey AS other,
       len([w FOR w IN string_split({SINGULAR.format('a.p_type')}, ' ') IF w NOT IN ('a','an','and','for','guide','introduction','of','the','to','') AND NOT contains(' ' || {SINGULAR.format('b.p_name')} || ' ', ' ' || w || ' ')]) = 0 AS named
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def x6(spark, d):
    p = table(spark, d, "part")
    b = p.select((F.col("p_partkey") - 1).alias("k"), F.col("p_partkey").alias("other"), F.col("p_name").alias("name_b"))
    return p.join(b, F.col("p_partkey") == F.col("k")).select("p_partkey", "other", T.title_names(F.col("p_type"), F.col("name_b")).alias("named"))


NAMES = r"VALUES (1, 'Getting Started. Guide'), (2, '  CON '), (3, 'a/b|c: d'), (4, 'nul.txt'), (5, '...'), (6, 'plain-name_1.0'), (7, 'x . . y--z'), (8, '1234567890123456789012345678901234567890123456789012345678901234567890'), (9, '../up'), (10, 'a//b'), (11, 'ok/path.html'), (12, '.') AS t(id, name)"


@query("x7_safe_stem", r"""
WITH p AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages),
k AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(title), '[^A-Za-z0-9_\-.\s]+', '', 'g'), '^[\s.]+', ''), '-[\s.]+', '-', 'g'), '[\s.]+', '-', 'g') AS s FROM p),
t AS (SELECT page_id, regexp_replace(left(s, 60), '^[-._]+|[-._]+$', '', 'g') AS s FROM k)
SELECT page_id, CASE WHEN s = '' THEN 'resource' ELSE s END AS stem FROM t""")
def x7(spark, d):
    return table(spark, d, "pages").select("page_id", T.safe_stem_ascii(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("stem"))


@query("x7_safe_stem_any")
def x7_any(spark, d):
    return table(spark, d, "pages").select("page_id", T.safe_stem(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("stem"))


@query("x8_file_name", r"""
WITH p AS (SELECT page_id, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_replace(url, '#.*$', '') AS canon FROM pages)
SELECT page_id, 'topic-' || left(sha256(canon), 12) || CASE WHEN regexp_extract(path, '(\.[^./]*)$', 1) = '' OR strlen(regexp_extract(path, '(\.[^./]*)$', 1)) > 10 OR regexp_matches(regexp_extract(path, '(\.[^./]*)$', 1), '[%&=?]') THEN '.html' ELSE lower(regexp_extract(path, '(\.[^./]*)$', 1)) END AS name FROM p""")
def x8(spark, d):
    return table(spark, d, "pages").select("page_id", U.file_name(F.col("url"), F.lit("topic"), lambda c: c).alias("name"))


@query("x9_safe_component", f"""
WITH c AS (SELECT id, name, regexp_replace(regexp_replace(name, '[^A-Za-z0-9._\\-]+', '-', 'g'), '^[.\\-]+|[.\\-]+$', '', 'g') AS k FROM {values(NAMES)}
UNION ALL SELECT p_partkey, p_name, regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9._\\-]+', '-', 'g'), '^[.\\-]+|[.\\-]+$', '', 'g') FROM part),
n AS (SELECT id, name, k, CASE WHEN regexp_matches(k, '(?i)^(?:con|prn|aux|nul|com[1-9]|lpt[1-9])(?:\\..*)?$') THEN '_' || k ELSE k END AS m FROM c)
SELECT id, CASE WHEN trim(name) = '' OR k = '' THEN NULL WHEN m != name OR strlen(m) > 100 THEN left(m, 80) || '-' || left(sha256(name), 10) ELSE m END AS component FROM n""")
def x9(spark, d):
    both = rows(spark, NAMES).unionByName(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))
    return both.select("id", T.safe_component(F.col("name")).alias("component"))


@query("x10_pdf_name")
def x10(spark, d):
    return table(spark, d, "documents").select("doc_id", T.pdf_name(F.concat_ws(" ", "source", "lang", F.substring_index("text", "\n", 1))).alias("name"))


@query("x11_nfkc_text")
def x11(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(T.nfkc_words(F.col("text")), 256).alias("sha"))


@query("x12_outline_token", r"SELECT p_partkey, regexp_replace(lower(p_name), '[^\p{L}\p{Nd}]+', '', 'g') AS token FROM part")
def x12(spark, d):
    return table(spark, d, "part").select("p_partkey", T.outline_token(F.col("p_name")).alias("token"))


@query("x14_bounded_text", r"""
WITH f AS (SELECT doc_id, text, trim(regexp_replace(text, '[\t\n\f\r ]+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 120 THEN left(t, 117) || '...' ELSE t END AS short,
       CASE WHEN length(text) > 200 THEN left(text, 200) || '…' ELSE text END AS cut FROM f""")
def x14(spark, d):
    return table(spark, d, "documents").select("doc_id", T.bounded(F.col("text"), 120).alias("short"), T.shortened(F.col("text")).alias("cut"))


WORDS = "VALUES (1, 'show interface brief', 'interface'), (2, 'show interfaces', 'interface'), (3, 'a_b c', 'b'), (4, 'x.y (z)', 'y'), (5, 'über alles', 'über'), (6, 'c++ code', 'c++') AS t(id, hay, word)"


@query("x15_whole_word", f"SELECT id, id IN (1, 4, 5, 6) AS held FROM {values(WORDS)}")
def x15(spark, d):
    return rows(spark, WORDS).select("id", T.word_contains(F.col("hay"), F.col("word")).alias("held"))


@query("x16_common_prefix", """
WITH g AS (SELECT n_regionkey, min(n_name) AS a, max(n_name) AS b FROM nation GROUP BY 1)
SELECT n_regionkey, left(a, CAST((SELECT max(i) FROM range(0, 30) t(i) WHERE i <= least(length(a), length(b)) AND left(a, CAST(i AS INT)) = left(b, CAST(i AS INT))) AS INT)) AS prefix FROM g""")
def x16(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.array(F.min("n_name"), F.max("n_name")).alias("names")).select("n_regionkey", T.common_prefix(F.col("names")).alias("prefix"))


@query("x17_folded_path")
def x17(spark, d):
    return table(spark, d, "part").select("p_partkey", T.folded_path(F.col("p_name")).alias("folded"))


@query("x18_plural", "SELECT n_regionkey, count(*) || ' ' || CASE WHEN count(*) = 1 THEN 'nation' ELSE 'nations' END AS label FROM nation GROUP BY 1")
def x18(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n")).select("n_regionkey", T.plural(F.col("n"), "nation", "nations").alias("label"))


STYLES = "VALUES (1, 'color: red; display:none; margin:0', 'color: red; margin:0'), (2, 'DISPLAY : NONE', ''), (3, 'display:block', 'display:block') AS t(id, style, want)"


@query("x19_display_none", f"SELECT id, want AS style FROM {values(STYLES)}")
def x19(spark, d):
    return rows(spark, STYLES).select("id", T.without_display_none(F.col("style")).alias("style"))


# -- URLs ------------------------------------------------------------------


@query("u1_normalise_url")
def u1(spark, d):
    return table(spark, d, "pages").select("page_id", U.normalise(F.col("url")).alias("url"))


@query("u2_canonical_url", "SELECT page_id, regexp_replace(url, '#.*$', '') AS url FROM pages")
def u2(spark, d):
    return table(spark, d, "pages").select("page_id", U.canonical(F.col("url")).alias("url"))


@query("u3_origin", r"SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1)), '^(https://.*):443$', '\1'), '^(http://.*):80$', '\1') AS origin FROM pages")
def u3(spark, d):
    return table(spark, d, "pages").select("page_id", U.origin(F.col("url")).alias("origin"))


REFS = "VALUES (1, 'https://h.example/a/b/c.html', '../d.html#x', 'https://h.example/a/d.html#x'), (2, 'https://h.example/a/', 'q?x=1&y=2', 'https://h.example/a/q?x=1&y=2'), (3, 'https://h.example/a', 'ftp://h/x', NULL), (4, 'https://h.example/a/b', '//o.example/z z', 'https://o.example/z%20z'), (5, 'https://h.example/', 'http://u:p@h/', NULL) AS t(id, base, ref, want)"


@query("u4_resolve_reference", f"SELECT id, want AS url FROM {values(REFS)}")
def u4(spark, d):
    return rows(spark, REFS).select("id", U.resolve(F.col("base"), F.col("ref")).alias("url"))


@query("u5_resolve_page_links")
def u5(spark, d):
    p = table(spark, d, "pages").select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("ord", "href"))
    return p.select("page_id", "ord", "href", U.resolve(F.col("url"), F.col("href")).alias("resolved"))


ROOTS = "VALUES (1, 'https://h.example/AOS/HTML/cli/Content/Chp/x.htm', 'https://h.example/AOS/HTML/cli/'), (2, 'https://h.example/g/index.html?x=/y#z', 'https://h.example/g/'), (3, 'https://h.example/a/Content/Content/b.htm', 'https://h.example/a/') AS t(id, url, want)"


@query("u7_guide_root", f"SELECT id, want AS root FROM {values(ROOTS)}")
def u7(spark, d):
    return rows(spark, ROOTS).select("id", U.guide_root(F.col("url")).alias("root"))


@query("u8_inside_root", r"""
WITH p AS (SELECT page_id, url, regexp_extract(url, '^([A-Za-z]+://[^/]*/)', 1) || 'en/' AS root, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, starts_with(url, root) AND len([x FOR x IN string_split(path, '/') IF x IN ('.', '..')]) = 0 AS inside FROM p""")
def u8(spark, d):
    root = F.concat(F.regexp_extract("url", "^([A-Za-z]+://[^/]*/)", 1), F.lit("en/"))
    return table(spark, d, "pages").select("page_id", U.inside(F.col("url"), root).alias("inside"))


IDS = "VALUES (1, 'https://s.example/doc?docId=a1&page=p.html&docLocale=en#f', 'a1', 'p.html', '', 'f'), (2, 'https://s.example/doc?docId=a1&mask=1&z=2&b=3', 'a1', '', 'b=3&z=2', ''), (3, 'https://o.example/doc?docId=a1', NULL, NULL, NULL, NULL), (4, 'https://s.example/doc?docId=a1&docId=a2', NULL, NULL, NULL, NULL) AS t(id, url, w1, w2, w3, w4)"


@query("u9_document_identity", f"SELECT id, w1 AS document, w2 AS page, w3 AS query, w4 AS fragment FROM {values(IDS)}")
def u9(spark, d):
    return rows(spark, IDS).select("id", U.document_identity(F.col("url"), F.lit("s.example")).alias("x")).select("id", "x.*")


PATHS = "VALUES (1, 'g/topics/a.html', 'g/topics/b.html', 'b.html'), (2, 'g/topics/a.html', 'h/x.html', '../../h/x.html'), (3, 'a.html', 'g/b.html', 'g/b.html') AS t(id, owner, target, want)"


@query("u11_relative_reference", f"SELECT id, want AS ref FROM {values(PATHS)}")
def u11(spark, d):
    return rows(spark, PATHS).select("id", U.relative_reference(F.col("owner"), F.col("target")).alias("ref"))


@query("u13_fragment", "SELECT page_id, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages")
def u13(spark, d):
    return table(spark, d, "pages").select("page_id", U.fragment(F.col("url")).alias("fragment"))


HOSTS = "VALUES (1, 'https://docs.example.com/x', 'public'), (2, 'http://127.0.0.1:8080/', 'loopback'), (3, 'http://10.0.0.1/', 'refused'), (4, 'http://[::1]/', 'loopback'), (5, 'http://[::ffff:127.0.0.1]/', 'loopback'), (6, 'http://0x7f.1/', 'refused'), (7, 'http://intranet/', 'refused'), (8, 'ftp://a.example/', 'refused'), (9, 'http://localhost/', 'loopback') AS t(id, url, want)"


@query("u14_destination_class", f"SELECT id, want AS class FROM {values(HOSTS)}")
def u14(spark, d):
    return rows(spark, HOSTS).select("id", U.destination_class(F.col("url")).alias("class"))


@query("u16_link_tests", r"SELECT page_id, regexp_matches(url, '(?i)^https?://') AS online, regexp_matches(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1)), '\.(png|jpe?g|gif|webp|bmp|svg|avif)$') AS image FROM pages")
def u16(spark, d):
    return table(spark, d, "pages").select("page_id", U.is_online(F.col("url")).alias("online"), U.is_image(F.col("url")).alias("image"))


# -- releases and classes --------------------------------------------------

ORDER = "VALUES ('10.9', '10.10', -1), ('10.10', '10.10.0', 0), ('10.17.xxxx', '10.17', 1), ('10.17.xx', '10.17', 0), ('10.4.x', '10.4.1', -1), ('11', '10.99', 1), ('10.13.1010', '10.13.1000', 1), ('10.17.XXXX', '10.17.9999', 0) AS t(first, second, want)"


@query("v1_compare_releases", f"SELECT first, second, want AS result FROM {values(ORDER)}")
def v1(spark, d):
    return rows(spark, ORDER).select("first", "second", R.compare_releases(F.col("first"), F.col("second")).alias("result"))


@query("v1_release_order", "WITH e AS (SELECT DISTINCT '10.' || l_linenumber || '.' || l_quantity::INT AS label, l_linenumber AS a, l_quantity::INT AS b FROM lineitem) SELECT label, row_number() OVER (ORDER BY a, b) AS pos FROM e")
def v1_order(spark, d):
    labels = table(spark, d, "lineitem").select(F.concat_ws(".", F.lit("10"), "l_linenumber", F.col("l_quantity").cast("int")).alias("label")).distinct()
    return numbered(labels.withColumn("key", R.release_key(F.col("label"))), ["key"], "pos").select("label", "pos")


ROUTES = "VALUES (1, '10.17', 'cli', 'CLI Guide', 'static', 'https://d.example/AOS/10.17.xxxx/HTML/CLI%20Guide/index.html'), (2, '10.13', 'cli', 'cli_x', 'pdf', 'https://d.example/AOS/10.13/PDF/cli_x.pdf'), (3, '10.13', 'vsx', 'vsx', 'flare', 'https://d.example/AOS/10.13/HTML/vsx/Content/home.htm'), (4, '10.12', 'vsx', 'vsx', 'pdf', 'https://d.example/Archived/AOS/10.12/PDF/vsx.pdf'), (5, '10.17', 'vsx', '../x', NULL, NULL), (6, 'latest', 'vsx', 'x', NULL, NULL) AS t(id, release, guide, target, kind, url)"


@query("v2_route", f"SELECT id, kind, url, url IS NULL AS failed FROM {values(ROUTES)}")
def v2(spark, d):
    made = rows(spark, ROUTES).select("id", R.route(F.col("release"), F.col("guide"), F.col("target"), F.lit("https://d.example/"), "AOS").alias("r"))
    return made.select("id", "r.kind", "r.url", F.col("r.error").isNotNull().alias("failed"))


VERSIONS = "VALUES ('0.5', 0, 5, 0), ('1.2.3', 1, 2, 3), ('v2.0', 2, 0, 0), ('x', NULL, NULL, NULL) AS t(label, a, b, c)"


@query("v3_application_version", f"SELECT label, a AS major, b AS minor, c AS patch FROM {values(VERSIONS)}")
def v3(spark, d):
    return rows(spark, VERSIONS).select("label", R.application_version(F.col("label")).alias("v")).select("label", "v.*")


@query("c1_body_hash", "SELECT page_id, sha256(html) AS sha FROM pages")
def c1(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("sha"))


@query("c3_topic_anchor", "SELECT page_id, 'topic-' || left(sha256(regexp_replace(url, '#.*$', '')), 24) AS anchor FROM pages")
def c3(spark, d):
    return table(spark, d, "pages").select("page_id", T.anchor(U.canonical(F.col("url"))).alias("anchor"))


ASSETS = "VALUES (1, '', 'text/css; charset=utf-8', '/a', 'style'), (2, '', '', '/x/f.WOFF2', 'font'), (3, 'image', 'text/css', '/a', 'image'), (4, '', 'image/png', '/a', 'image'), (5, '', 'text/html', '/a.html', 'other') AS t(id, hint, mime, path, want)"


@query("c4_asset_kind", f"SELECT id, want AS kind FROM {values(ASSETS)}")
def c4(spark, d):
    return rows(spark, ASSETS).select("id", R.asset_kind(F.col("hint"), F.col("mime"), F.col("path")).alias("kind"))


STATUS = "VALUES (200), (204), (301), (403), (404), (410), (429), (500), (503), (NULL) AS t(status)"


@query("c5_availability", f"SELECT status, CASE WHEN status BETWEEN 200 AND 299 THEN 'available' WHEN status IN (404, 410) THEN 'unavailable' ELSE 'unknown' END AS state, coalesce(status IN (408, 425, 429, 500, 502, 503, 504), false) AS retry FROM {values(STATUS)}")
def c5(spark, d):
    return rows(spark, STATUS).select("status", R.availability(F.col("status")).alias("state"), F.coalesce(R.retryable(F.col("status")), F.lit(False)).alias("retry"))


FAILS = "VALUES (1, 404, '', 'http-404'), (2, 410, '', 'http-410'), (3, 0, 'timeout', 'timeout'), (4, 0, 'unexpected EOF', 'incomplete-body'), (5, 503, '', 'retry-exhausted'), (6, 403, '', NULL) AS t(id, status, error, want)"


@query("c6_raster_failure", f"SELECT id, want AS class FROM {values(FAILS)}")
def c6(spark, d):
    return rows(spark, FAILS).select("id", R.raster_failure(F.col("status"), F.col("error")).alias("class"))


WAITS = "VALUES (0, NULL, 1), (3, NULL, 8), (1, 30, 30), (5, 2, 32), (0, 301, NULL) AS t(attempt, asked, want)"


@query("c8_retry_delay", f"SELECT attempt, asked, want AS seconds FROM {values(WAITS)}")
def c8(spark, d):
    return rows(spark, WAITS).select("attempt", "asked", R.retry_delay(F.col("attempt"), F.col("asked")).alias("seconds"))


@query("c9_library_status", "SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'incomplete' WHEN bool_or(o_orderstatus = 'O') THEN 'degraded' ELSE 'complete' END AS status FROM orders GROUP BY 1")
def c9(spark, d):
    named = F.when(F.col("o_orderstatus") == "P", "incomplete").when(F.col("o_orderstatus") == "O", "degraded").otherwise("complete")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set(named).alias("s")).select("o_custkey", R.library_status(F.col("s")).alias("status"))


# -- predicates ------------------------------------------------------------


@query("f1_valid_label", "SELECT p_partkey, trim(p_name) != '' AND length(p_name) <= 4096 AS valid FROM part")
def f1(spark, d):
    return table(spark, d, "part").select("p_partkey", (F.is_valid_utf8("p_name") & (F.trim("p_name") != "") & (F.char_length("p_name") <= 4096)).alias("valid"))


@query("f2_patterns", r"SELECT p_partkey, regexp_matches(p_brand, '^[A-Za-z0-9_-]+$') AS book, regexp_matches(p_name, '^[A-Za-z0-9](?:[A-Za-z0-9 _().,-]*[A-Za-z0-9)_.-])?$') AS folder FROM part")
def f2(spark, d):
    return table(spark, d, "part").select("p_partkey", F.col("p_brand").rlike("^[A-Za-z0-9_-]+$").alias("book"), F.col("p_name").rlike(R.FOLDER).alias("folder"))


@query("f22_safe_path", f"SELECT id, name != '.' AND NOT contains(name, chr(92)) AND len([p FOR p IN string_split(name, '/') IF p IN ('', '.', '..')]) = 0 AS safe FROM {values(NAMES)}")
def f22(spark, d):
    return rows(spark, NAMES).select("id", T.safe_path(F.col("name")).alias("safe"))
