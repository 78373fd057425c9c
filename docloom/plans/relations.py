"""Queries of joins, aggregates, order-dependent and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import ordered as O
from ..operators import sets as E
from ..operators.asof import asof_join
from ..operators.folds import numbered as number_sorted
from .registry import placed, query, rows, table, values

# -- joins -----------------------------------------------------------------


@query("j1_resolve_documents", """
SELECT s.s_suppkey AS guide_id, s.s_name AS title, n.n_name AS target FROM supplier s
JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey WHERE r.r_name = 'ASIA'""")
def j1(spark, d):
    mappings = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 rows, fixed
    mappings = mappings.join(table(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("guide_id"), F.lit("1").alias("release"), F.col("r_name").alias("platform"), F.col("n_name").alias("target"))
    guides = table(spark, d, "supplier").select(F.col("s_suppkey").alias("guide_id"), F.col("s_name").alias("title"))
    return J.resolve_documents(guides, mappings, "1", "ASIA").select("guide_id", "title", "target")


@query("j2_override", """
SELECT o.o_orderkey, coalesce(c.c_name, o.o_orderpriority) AS target, CASE WHEN c.c_name IS NULL THEN 'mapping' ELSE 'override' END AS origin
FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_acctbal < 0""")
def j2(spark, d):
    base = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("target"))
    over = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("target"))
    return J.override(base, over, ["k"], "target", "origin").select("o_orderkey", "target", "origin")


@query("j3_selected", "SELECT c.c_custkey, min(o.o_orderkey) AS first_ord, c.c_name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY 1, 3")
def j3(spark, d):
    wanted = O.first_by_key(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("first_ord"), "o_orderstatus"), "c_custkey", "first_ord")
    return wanted.select("c_custkey", "first_ord").join(table(spark, d, "customer"), "c_custkey").select("c_custkey", "first_ord", "c_name")


MAPPED = """VALUES ('g1','10.10','p1','t'), ('g1','10.10','p2','t'), ('g1','10.10','p3','u'), ('g1','10.13','p2','n'), ('g1','10.13','p3','m'), ('g1','10.15','p1','w'), ('g1','10.15','p2','w'),
('g2','10.10','p1','t'), ('g2','10.10','p2','x'), ('g2','10.13','p2','n'), ('g3','10.9','p1','a'), ('g3','10.9','p2','a'), ('g3','10.9','p3','a'), ('g3','10.13','p2','n'), ('g3','10.13','p3','m'),
('g4','10.15','p1','a'), ('g4','10.15','p3','a'), ('g4','10.13','p3','z'), ('g4','10.13','p1','z') AS t(guide_id, release, platform, target)"""


@query("j5_peer_target", "SELECT 'g1' AS guide_id, 'n' AS target, ['p2'] AS peers, ['10.10', '10.15'] AS releases")
def j5(spark, d):
    return J.peer_targets(rows(spark, MAPPED), "p1", "10.13")


PEERS = """m AS (SELECT o_custkey AS guide_id, CAST(year(o_orderdate) AS VARCHAR) AS release, left(o_orderpriority, 1) AS platform, min(o_orderstatus) AS target FROM orders GROUP BY ALL)"""


@query("j5_peers_of_orders", f"""WITH {PEERS},
own AS (SELECT * FROM m WHERE platform = '1' AND release <> '1995'),
near AS (SELECT guide_id, max(release) AS release FROM own WHERE release < '1995' GROUP BY 1 UNION ALL SELECT guide_id, min(release) FROM own WHERE release > '1995' GROUP BY 1),
s AS (SELECT * FROM own JOIN near USING (guide_id, release)),
p AS (SELECT s.guide_id, s.release, m.platform FROM s LEFT JOIN m ON m.guide_id = s.guide_id AND m.release = s.release AND m.platform <> '1' AND m.target = s.target),
n AS (SELECT guide_id, release, count(platform) AS n FROM p GROUP BY ALL),
ok AS (SELECT guide_id, list_sort(list(release)) AS releases FROM n GROUP BY 1 HAVING min(n) > 0),
here AS (SELECT q.guide_id, q.platform, m.target FROM (SELECT DISTINCT guide_id, platform FROM p) q JOIN m ON m.guide_id = q.guide_id AND m.platform = q.platform AND m.release = '1995'),
one AS (SELECT guide_id, min(target) AS target, list_sort(list(platform)) AS peers FROM here GROUP BY 1 HAVING count(DISTINCT target) = 1)
SELECT one.guide_id, one.target, peers, releases FROM one JOIN ok USING (guide_id) LEFT JOIN m ON m.guide_id = one.guide_id AND m.release = '1995' AND m.platform = '1' WHERE m.target IS NULL OR m.target <> one.target""")
def j5_orders(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("guide_id"), F.year("o_orderdate").cast("string").alias("release"), F.left("o_orderpriority", F.lit(1)).alias("platform")).agg(F.min("o_orderstatus").alias("target"))
    return J.peer_targets(o, "1", "1995")


@query("j6_unique_alias", "SELECT l_orderkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1")
def j6(spark, d):
    return J.unique_targets(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), "l_orderkey", "l_suppkey")


@query("j7_cross_guide_links", """
WITH k AS (SELECT DISTINCT l_partkey AS key, l_suppkey AS target FROM lineitem WHERE l_quantity > 48)
SELECT l.l_orderkey AS link, count(DISTINCT k.target) AS n_targets, CASE WHEN count(DISTINCT k.target) = 1 THEN min(k.target) END AS target,
       CASE WHEN count(DISTINCT k.target) = 0 THEN 'keep' WHEN count(DISTINCT k.target) > 1 THEN 'warn' ELSE 'rewrite' END AS action
FROM lineitem l LEFT JOIN k ON k.key = l.l_partkey GROUP BY 1""")
def j7(spark, d):
    li = table(spark, d, "lineitem")
    keys = li.where("l_quantity > 48").select(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("target"))
    return J.resolve_unique(li.select(F.col("l_orderkey").alias("link"), F.col("l_partkey").alias("key")), keys, "link", "key", "target")


@query("j9_restored_links", """
SELECT l.l_orderkey, l.l_linenumber, coalesce(c.p_name, p.p_name) AS name FROM lineitem l
LEFT JOIN (SELECT * FROM part WHERE p_size > 25) c ON c.p_partkey = l.l_partkey LEFT JOIN (SELECT * FROM part WHERE p_size > 10) p ON p.p_partkey = l.l_partkey
WHERE l.l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 40)""")
def j9(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name"), "p_size")
    links = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return J.restored(links, part.where("p_size > 40"), part.where("p_size > 25"), part.where("p_size > 10"), "l_partkey", "name").select("l_orderkey", "l_linenumber", "name")


@query("j10_missing_fragments", """
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS fragment FROM pages), t AS (SELECT DISTINCT regexp_extract(html, 'href="/([^"]*)"', 1) AS fragment FROM pages)
SELECT DISTINCT page_id, fragment FROM l WHERE fragment NOT IN (SELECT fragment FROM t)""")
def j10(spark, d):
    p = table(spark, d, "pages")
    required = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), 1)).alias("fragment")).distinct()
    return J.missing(required, p.select(F.regexp_extract("html", 'href="/([^"]*)"', 1).alias("fragment")), ["fragment"]).select("page_id", "fragment")


@query("j12_j26_full_compare", """
WITH a AS (SELECT c_nationkey AS k, count(*) AS v FROM customer WHERE c_acctbal > 5000 GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS v FROM supplier GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, a.v AS left_value, b.v AS right_value, CASE WHEN b.k IS NULL THEN 'only left' WHEN a.k IS NULL THEN 'only right' WHEN a.v = b.v THEN 'same' ELSE 'changed' END AS status
FROM a FULL JOIN b ON a.k = b.k""")
def j12(spark, d):
    a = table(spark, d, "customer").where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("v"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("v"))
    return J.compare(a, b, ["k"], "v")


GUIDES = "VALUES ('a','complete'), ('b','degraded'), ('c','degraded'), ('d','incomplete'), ('e','degraded') AS t(guide, status)"
BEFORE = "VALUES ('a','complete'), ('b','degraded'), ('c','degraded'), ('e','complete') AS t(guide, status)"
MISS = "VALUES ('b','r1'), ('c','r1'), ('c','r9') AS t(guide, resource)"
MISSED = "VALUES ('b','r1'), ('b','r2'), ('c','r1') AS t(guide, resource)"


@query("j16_accept", "SELECT * FROM (VALUES ('a','complete','complete',true), ('b','degraded','degraded',true), ('c','degraded','degraded',false), ('d','incomplete',NULL,false), ('e','degraded','complete',false)) AS t(guide, status, before, accepted)")
def j16(spark, d):
    return J.accept(*(rows(spark, x) for x in (GUIDES, BEFORE, MISS, MISSED)))


@query("j16_accept_suppliers", """
WITH g AS (SELECT s_suppkey AS guide, CASE WHEN s_acctbal > 5000 THEN 'complete' WHEN s_acctbal > 0 THEN 'degraded' ELSE 'incomplete' END AS status FROM supplier),
b AS (SELECT s_suppkey AS guide, CASE WHEN s_acctbal < 8000 THEN 'degraded' ELSE 'complete' END AS before FROM supplier WHERE s_nationkey > 5),
w AS (SELECT DISTINCT l_suppkey AS guide FROM (SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 49 EXCEPT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_tax < 0.08))
SELECT guide, status, before, CASE WHEN status = 'complete' THEN true WHEN status <> 'degraded' THEN false WHEN before IS NULL THEN true WHEN before = 'complete' THEN false ELSE w.guide IS NULL END AS accepted
FROM g LEFT JOIN b USING (guide) LEFT JOIN w USING (guide)""")
def j16_suppliers(spark, d):
    s, li = table(spark, d, "supplier"), table(spark, d, "lineitem").where("l_returnflag = 'R'")
    guides = s.select(F.col("s_suppkey").alias("guide"), F.expr("CASE WHEN s_acctbal > 5000 THEN 'complete' WHEN s_acctbal > 0 THEN 'degraded' ELSE 'incomplete' END").alias("status"))
    before = s.where("s_nationkey > 5").select(F.col("s_suppkey").alias("guide"), F.when(F.col("s_acctbal") < 8000, "degraded").otherwise("complete").alias("status"))
    missing = lambda rows_: rows_.select(F.col("l_suppkey").alias("guide"), F.col("l_partkey").alias("resource"))
    return J.accept(guides, before, missing(li.where("l_quantity >= 49")), missing(li.where("l_tax < 0.08")))


@query("j17_listing", """
SELECT c.c_custkey, c.c_name, n.n_name, count(o.o_orderkey) AS orders, CASE WHEN count(o.o_orderkey) = 0 THEN 'not mapped' ELSE 'mapped' END AS state
FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1, 2, 3""")
def j17(spark, d):
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    out = J.with_tables(c, (n, c["c_nationkey"] == n["n_nationkey"], "left"), (counts, c["c_custkey"] == counts["k"], "left"))
    total = F.coalesce("n", F.lit(0).cast("long"))
    return out.select("c_custkey", "c_name", "n_name", total.alias("orders"), F.when(total == 0, "not mapped").otherwise("mapped").alias("state"))


@query("j18_last_attempt", "SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1")
def j18(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", "o_orderkey").alias("status"))


NEEDED = "VALUES ('x.css','x','note'), ('x.css','x','tip'), ('y.css','y','note'), ('z.css','z','a') AS t(broken, base, family)"
DEFINED = "VALUES ('x','s1','note-x'), ('x','s1','tip'), ('y','s2','note'), ('y','s3','note'), ('z','s4','b') AS t(base, sheet, defined)"


@query("j19_covering_style", "SELECT 'x.css' AS broken, 's1' AS sheet")
def j19(spark, d):
    return J.covered(rows(spark, NEEDED), rows(spark, DEFINED))


@query("j20_first_served", "SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderstatus = 'F') AS choice FROM orders GROUP BY 1")
def j20(spark, d):
    o = table(spark, d, "orders").withColumn("served", F.col("o_orderstatus") == "F")
    return J.first_served(o, "o_custkey", "o_orderkey", "served", "o_orderpriority").withColumnRenamed("o_orderpriority", "choice")


@query("j22_style_groups", "SELECT l_orderkey, l_suppkey, count(*) AS refs, count(*) FILTER (l_returnflag = 'R') AS broken FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 2 AND count(*) FILTER (l_returnflag = 'R') >= 1")
def j22(spark, d):
    return A.mix(table(spark, d, "lineitem"), ["l_orderkey", "l_suppkey"], refs=F.lit(True), broken=F.col("l_returnflag") == "R").where("refs >= 2 and broken >= 1")


#: Text lines of pages, made from the line items: boxes on a small grid.
LINES = """SELECT l_orderkey AS page, l_linenumber AS ord, l_linenumber % 2 AS block, l_returnflag || l_linestatus AS text,
  l_quantity AS x0, l_discount * 1000 AS y0, l_quantity + 40 AS x1, l_discount * 1000 + 12 AS y1, l_tax * 300 AS font FROM lineitem"""


def lines(spark, d):
    table(spark, d, "lineitem").createOrReplaceTempView("docloom_lineitem")
    return spark.sql(LINES.replace("FROM lineitem", "FROM docloom_lineitem"))


@query("j23_text_overlap", f"""
WITH l AS ({LINES}), p AS (SELECT a.page, a.ord AS ord_a, b.ord AS ord_b, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS w, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS h,
  least(a.x1 - a.x0, b.x1 - b.x0) AS mw, least(a.y1 - a.y0, b.y1 - b.y0) AS mh, least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) AS ma
  FROM l a JOIN l b ON a.page = b.page AND a.ord < b.ord AND a.text != b.text)
SELECT page, ord_a, ord_b, w / mw AS width, h / mh AS height, w * h / ma AS area FROM p WHERE w > 0 AND h > 0 AND w / mw >= 0.25 AND h / mh >= 0.55 AND w * h / ma >= 0.18""")
def j23(spark, d):
    return J.overlaps(lines(spark, d))


@query("j25_table_header_lines", r"SELECT p_partkey FROM part p WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT split_part(p_name, ' ', 2) AS head FROM part WHERE p_size = 1) r WHERE regexp_matches(lower(p.p_name), '(^|[^a-z0-9_])' || lower(r.head) || '($|[^a-z0-9_])'))")
def j25(spark, d):
    """A line holds a header as a whole word: the line's words meet the headers."""
    p = table(spark, d, "part")
    heads = p.where("p_size = 1").select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("word")).where("word != ''").distinct()
    words = p.select("p_partkey", F.explode(F.array_distinct(F.split(F.lower("p_name"), "[^a-z0-9_]+"))).alias("word"))
    return words.join(heads, "word", "left_semi").select("p_partkey").distinct()


@query("j33_name_clash", "SELECT lower(p_name) AS folded, list_sort(list(DISTINCT p_partkey)) AS keys FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1")
def j33(spark, d):
    return J.name_clashes(table(spark, d, "part"), "p_partkey", "p_name")


# -- aggregates ------------------------------------------------------------


@query("a1_ordered_distinct", "SELECT source, min(doc_id) AS doc_id FROM documents WHERE trim(source) != '' GROUP BY 1")
def a1(spark, d):
    return O.ordered_distinct(table(spark, d, "documents"), "source", "doc_id")


@query("a2_ordered_distinct_capped", "SELECT event_type, min(event_id) AS event_id FROM events GROUP BY 1 ORDER BY 2 LIMIT 3")
def a2(spark, d):
    return O.ordered_distinct(table(spark, d, "events"), "event_type", "event_id", 3)


@query("a3_count_distinct_ids", "SELECT count(DISTINCT nullif(source, '')) AS n FROM documents")
def a3(spark, d):
    return table(spark, d, "documents").agg(F.count_distinct(F.nullif("source", F.lit(""))).alias("n"))


NOTICES = "VALUES ('g','external-link-retained','a'), ('g','external-link-retained','a'), ('g','css-cleanup','b'), ('g','new','c'), ('g','','d'), ('h','source-policy','x') AS t(guide, kind, message)"


@query("a4_notice_summary", "SELECT * FROM (VALUES ('g', '3 publisher notices (1 external link retained; 1 CSS cleanup; 1 other)'), ('h', '1 publisher notice (1 source policy)')) AS t(guide, summary)")
def a4(spark, d):
    return A.notice_summary(rows(spark, NOTICES), "guide")


KINDS = "CASE left(o_orderpriority, 1) WHEN '1' THEN 'external-link-retained' WHEN '2' THEN 'css-cleanup' WHEN '3' THEN 'source-policy' WHEN '4' THEN 'unknown' ELSE '' END"


@query("a4_notices_of_orders", f"""
WITH d AS (SELECT DISTINCT o_custkey AS guide, {KINDS} AS kind, o_orderstatus AS message FROM orders),
c AS (SELECT guide, count(*) AS n, count(*) FILTER (kind = 'external-link-retained') AS e, count(*) FILTER (kind = 'css-cleanup') AS s, count(*) FILTER (kind = 'source-policy') AS p FROM d WHERE kind <> '' GROUP BY 1)
SELECT guide, n || CASE n WHEN 1 THEN ' publisher notice (' ELSE ' publisher notices (' END || array_to_string(list_filter([
  CASE WHEN e > 0 THEN e || CASE e WHEN 1 THEN ' external link retained' ELSE ' external links retained' END END, CASE WHEN s > 0 THEN s || ' CSS cleanup' END,
  CASE WHEN p > 0 THEN p || ' source policy' END, CASE WHEN n - e - s - p > 0 THEN (n - e - s - p) || ' other' END], lambda x: x IS NOT NULL), '; ') || ')' AS summary FROM c""")
def a4_orders(spark, d):
    return A.notice_summary(table(spark, d, "orders").select(F.col("o_custkey").alias("guide"), F.expr(KINDS).alias("kind"), F.col("o_orderstatus").alias("message")), "guide")


@query("a5_count_map", "SELECT source, string_agg(lang || ' (' || n || ')', ', ' ORDER BY lang) AS summary FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1")
def a5(spark, d):
    return A.count_map_text(table(spark, d, "documents"), "lang", ["source"])


@query("a6_a7_format_mix", "SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (n_chars > 1000) AS long FROM documents GROUP BY 1")
def a6(spark, d):
    return A.mix(table(spark, d, "documents"), ["source"], en=F.col("lang") == "en", long=F.col("n_chars") > 1000)


@query("a8_per_release", "SELECT r_name, count(n_nationkey) FILTER (n_name < 'J') AS mapped, count(n_nationkey) FILTER (n_name >= 'J') AS failed FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def a8(spark, d):
    counts = A.mix(table(spark, d, "nation"), ["n_regionkey"], mapped=F.col("n_name") < "J", failed=F.col("n_name") >= "J")
    return table(spark, d, "region").join(counts, F.col("r_regionkey") == F.col("n_regionkey"), "left").select("r_name", F.coalesce("mapped", F.lit(0)).alias("mapped"), F.coalesce("failed", F.lit(0)).alias("failed"))


@query("a9_available_releases", "SELECT r_regionkey, r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_name > 'NATION_2')")
def a9(spark, d):
    return table(spark, d, "region").join(table(spark, d, "nation").where("n_name > 'NATION_2'"), F.col("r_regionkey") == F.col("n_regionkey"), "left_semi").orderBy("r_regionkey")


@query("a11_inventory", "SELECT count(*) AS entries, count(DISTINCT l_partkey) AS topics FROM lineitem")
def a11(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("entries"), F.count_distinct("l_partkey").alias("topics"))


@query("a12_byte_total", "SELECT sum(strlen(html)) AS total, sum(strlen(html)) > 1000000 AS over FROM pages")
def a12(spark, d):
    return O.capped_total(table(spark, d, "pages").select(F.octet_length("html").alias("size")), "size", 1_000_000)


@query("a13_page_frequency", f"SELECT text, count(DISTINCT page) AS pages FROM ({LINES}) GROUP BY 1")
def a13(spark, d):
    return A.page_frequency(lines(spark, d))


@query("a14_repeated_texts", f"SELECT text, list_sort(list(DISTINCT page)) AS pages FROM ({LINES}) WHERE length(text) >= 2 AND font >= 14 GROUP BY 1 HAVING count(DISTINCT page) > 10")
def a14(spark, d):
    return A.repeated_texts(lines(spark, d), 10, least_chars=2)


@query("a15_blocks", f"SELECT page, block, string_agg(text, ' ' ORDER BY ord, text) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(font) AS font FROM ({LINES}) GROUP BY 1, 2")
def a15(spark, d):
    return A.blocks(lines(spark, d))


@query("a17_manifest_counts", "SELECT c_custkey, count(o_orderkey) AS orders, count(DISTINCT o_orderpriority) AS kinds FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def a17(spark, d):
    counts = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("o"), F.count_distinct("o_orderpriority").alias("k"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return table(spark, d, "customer").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", zero("o").alias("orders"), zero("k").alias("kinds"))


@query("a21_attempt_summary", "SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey)[1:3] AS first, greatest(count(*) - 3, 0) AS more, list_sort(list(DISTINCT o_orderstatus)) AS statuses FROM orders GROUP BY 1")
def a21(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    few = O.first_in_group(o, ["o_custkey"], "o_orderkey", 3).groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("first"))
    all_ = o.groupBy("o_custkey").agg(F.greatest(F.count("*") - 3, F.lit(0).cast("long")).alias("more"), F.sort_array(F.collect_set("o_orderstatus")).alias("statuses"))
    return few.join(all_, "o_custkey")


MARKS = "VALUES ('g',1,'a'), ('g',1,'b'), ('g',2,'a'), ('g',2,'b'), ('g',2,'c'), ('g',3,'x'), ('g',3,'y'), ('g',4,'z') AS t(guide, ord, id)"


@query("a24_bookmark_evidence", "SELECT * FROM (VALUES ('g',1,['a','b'],true), ('g',2,[],false), ('g',3,['x','y'],true), ('g',4,[],false)) AS t(guide, ord, ids, complete)")
def a24(spark, d):
    return A.evidence(rows(spark, MARKS), 2, 4)


@query("a25_affected_topics", "SELECT l_suppkey, list_sort(list(DISTINCT l_orderkey)) AS topics FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def a25(spark, d):
    return table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.sort_array(F.collect_set("l_orderkey")).alias("topics"))


@query("a24_page_evidence", """
WITH RECURSIVE d AS (SELECT DISTINCT l_suppkey AS guide, year(l_shipdate) * 12 + month(l_shipdate) AS ord, CAST(l_partkey AS VARCHAR) AS id FROM lineitem),
p AS (SELECT guide, ord, count(*) AS n, list_sort(list(id)) AS ids, row_number() OVER (PARTITION BY guide ORDER BY ord) AS k FROM d GROUP BY guide, ord),
f AS (
  SELECT DISTINCT guide, 0::BIGINT AS k, 0::BIGINT AS used, false AS complete FROM p
  UNION ALL
  SELECT p.guide, p.k, CASE WHEN n <= 9 AND used + n <= 200 THEN used + n ELSE used END, n <= 9 AND used + n <= 200
  FROM f JOIN p ON p.guide = f.guide AND p.k = f.k + 1)
SELECT guide, ord, CASE WHEN complete THEN ids ELSE [] END AS ids, complete FROM p JOIN f USING (guide, k)""")
def a24_pages(spark, d):
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    return A.evidence(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("guide"), month.alias("ord"), F.col("l_partkey").cast("string").alias("id")), 9, 200)


@query("a25_affected_rows", "SELECT l_returnflag, l_partkey, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_partkey) - 1 AS nth FROM (SELECT DISTINCT l_returnflag, l_partkey FROM lineitem)")
def a25_rows(spark, d):
    return A.affected_topics(table(spark, d, "lineitem"), "l_returnflag", "l_partkey")


FOOT = "VALUES (1, 700.0, '1'), (1, 700.0, 'Intro'), (2, 700.0, '2'), (3, 100.0, '3'), (4, 705.0, 'iv'), (4, 705.0, 'Body'), (4, 706.0, 'Extra') AS t(page, y0, text)"
FOOT_PAGES = "VALUES (1), (2), (3), (4) AS t(page)"


@query("a26_footer_audit", "SELECT * FROM (VALUES (1,1,1,true), (2,1,0,false), (3,0,0,false), (4,1,2,false)) AS t(page, numbers, labels, ok)")
def a26(spark, d):
    return A.footer_audit(rows(spark, FOOT), rows(spark, FOOT_PAGES), 650.0)


@query("a27_report", f"""
SELECT 'empty' AS rule, count(*) AS violations, count(*) = 0 AS passed FROM documents WHERE trim(text) = ''
UNION ALL SELECT 'language', count(*), count(*) = 0 FROM documents WHERE lang NOT IN ('en', 'fr', 'de', 'es')""")
def a27(spark, d):
    docs = table(spark, d, "documents")
    return A.report(empty=docs.where("trim(text) = ''"), language=docs.where("lang not in ('en', 'fr', 'de', 'es')"))


# -- order -----------------------------------------------------------------


@query("w1_nearest_releases", """
WITH m AS (SELECT o_orderpriority AS guide, year(o_orderdate) AS y, month(o_orderdate) AS mo, o_orderstatus AS target FROM orders WHERE o_totalprice > 400000),
k AS (SELECT guide, y * 100 + mo AS k, y || '.' || mo AS release, max(target) AS target FROM m GROUP BY ALL),
w AS (SELECT DISTINCT o_orderpriority AS guide, year(o_orderdate) * 100 + month(o_orderdate) AS k, year(o_orderdate) || '.' || month(o_orderdate) AS release FROM orders)
SELECT w.guide, w.release, b.release AS before, b.target AS before_target, a.release AS after, a.target AS after_target
FROM w ASOF LEFT JOIN k b ON b.guide = w.guide AND b.k < w.k ASOF LEFT JOIN k a ON a.guide = w.guide AND a.k > w.k""")
def w1_nearest(spark, d):
    label = F.concat(F.year("o_orderdate"), F.lit("."), F.month("o_orderdate"))
    rows_ = table(spark, d, "orders").select(F.col("o_orderpriority").alias("guide"), label.alias("release"), F.col("o_orderstatus").alias("target"), "o_totalprice")
    return J.nearest_releases(rows_.select("guide", "release").distinct(), rows_.where("o_totalprice > 400000"), ["guide"])


@query("w1_click_before_error", """
WITH c AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY ALL)
SELECT e.event_id, e.user_id, c.event_id AS click_id, c.ts AS click_ts FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN c ON c.user_id = e.user_id AND c.ts <= e.ts""")
def w1_clicks(spark, d):
    e = table(spark, d, "events")
    found = asof_join(e.where("event_type = 'error'").select("event_id", "user_id", "ts"), e.where("event_type = 'click'"), ["user_id"], F.col("ts"), F.col("ts"), {"click_id": "event_id", "click_ts": "ts"})
    return found.drop("ts")


@query("w1_order_before_shipment", """
WITH l AS (SELECT DISTINCT l_orderkey, l_shipdate, CASE WHEN l_returnflag = 'R' THEN 'R' ELSE 'all' END AS k FROM lineitem),
o AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 'R' ELSE 'all' END AS k, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL)
SELECT l.l_orderkey, l.k, o.o_orderkey, o.o_orderdate FROM l ASOF LEFT JOIN o ON o.k = l.k AND o.o_orderdate < l.l_shipdate""")
def w1_shipments(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", F.when(F.col("l_returnflag") == "R", "R").otherwise("all").alias("k")).distinct()
    orders = table(spark, d, "orders").withColumn("k", F.when(F.col("o_orderstatus") == "P", "R").otherwise("all"))
    return asof_join(lines, orders, ["k"], F.col("l_shipdate"), F.col("o_orderdate"), {"o_orderkey": "o_orderkey", "o_orderdate": "o_orderdate"}, strict=True).drop("l_shipdate")


@query("w1_neighbour_releases", "SELECT * FROM (VALUES ('a','10.4',NULL,'10.9'), ('a','10.9','10.4','10.10'), ('a','10.10','10.9',NULL)) AS t(guide, release, before, after)")
def w1(spark, d):
    return J.neighbour_releases(rows(spark, "VALUES ('a','10.10'), ('a','10.4'), ('a','10.9') AS t(guide, release)"), ["guide"])


@query("w2_navigation", "SELECT conv_id, turn, lag(role) OVER w AS previous, lead(role) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def w2(spark, d):
    return O.navigation(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", "role").drop("role")


@query("w3_first_occurrence", "SELECT user_id, min(event_id) AS event_id, coalesce(arg_min(CASE WHEN event_type != 'click' THEN event_type END, CASE WHEN event_type != 'click' THEN event_id END), '') AS title FROM events GROUP BY 1")
def w3(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type")).alias("title"))
    return O.first_by_key(e, "user_id", "event_id", "title")


@query("w4_carried_label", "SELECT event_id, last_value(CASE WHEN value > 50 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS label FROM events")
def w4(spark, d):
    e = table(spark, d, "events").withColumn("mark", F.when(F.col("value") > 50, F.col("event_type")))
    return O.carried_forward(e, ["user_id"], "event_id", "mark", "label").select("event_id", "label")


BOUND = "VALUES (1,1,'a'), (1,2,'b'), (1,3,'c'), (2,1,'b'), (2,2,'c'), (2,3,'d'), (3,1,'x'), (4,1,'x'), (4,2,'y') AS t(page, ord, text)"


@query("w5_boundary_repeats", "SELECT * FROM (VALUES (1, 2, 'b' || chr(10) || 'c'), (3, 1, 'x')) AS t(page, k, text)")
def w5(spark, d):
    return O.boundary_repeats(rows(spark, BOUND))


@query("w5_order_boundaries", """
WITH p AS (SELECT l_orderkey AS page, list(l_returnflag || l_linestatus ORDER BY l_linenumber, l_returnflag || l_linestatus) AS t FROM lineitem GROUP BY 1),
b AS (SELECT a.page, a.t, b.t AS u FROM p a JOIN p b ON b.page = a.page + 1),
k AS (SELECT page, u, CASE WHEN len(t) >= 3 AND len(u) >= 3 AND t[-3:] = u[1:3] THEN 3 WHEN len(t) >= 2 AND len(u) >= 2 AND t[-2:] = u[1:2] THEN 2 WHEN t[-1] = u[1] THEN 1 ELSE 0 END AS k FROM b)
SELECT page, k, array_to_string(u[1:k], chr(10)) AS text FROM k WHERE k > 0""")
def w5_orders(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("ord"), F.concat("l_returnflag", "l_linestatus").alias("text"))
    return O.boundary_repeats(lines)


OUTLINE = "VALUES ('t',1,0), ('t',2,1), ('t',3,2), ('t',4,2), ('t',5,1), ('t',6,0), ('t',7,1) AS t(doc, ord, depth)"


@query("w7_children", "SELECT * FROM (VALUES ('t',1,0,2), ('t',2,1,2), ('t',3,2,0), ('t',4,2,0), ('t',5,1,0), ('t',6,0,1), ('t',7,1,0)) AS t(doc, ord, depth, n_children)")
def w7(spark, d):
    return O.children(rows(spark, OUTLINE), ["doc"]).select("doc", "ord", "depth", "n_children")


@query("w7_region_children", """
WITH e AS (SELECT n_regionkey AS doc, n_nationkey AS a, -1 AS b, 0 AS depth FROM nation UNION ALL SELECT n_regionkey, n_nationkey, c_custkey, 1 FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY a, b) - 1 AS ord, depth, CASE depth WHEN 0 THEN count(*) OVER (PARTITION BY a) - 1 ELSE 0 END AS n_children FROM e""")
def w7_regions(spark, d):
    nations = table(spark, d, "nation")
    top = nations.select(F.col("n_regionkey").alias("doc"), F.col("n_nationkey").alias("a"), F.lit(-1).cast("long").alias("b"), F.lit(0).alias("depth"))
    low = table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("doc"), F.col("n_nationkey").alias("a"), F.col("c_custkey").cast("long").alias("b"), F.lit(1).alias("depth"))
    return O.children(number_sorted(top.unionByName(low), ["doc"], ["a", "b"], "ord"), ["doc"]).select("doc", "ord", "depth", "n_children")


@query("w8_duplicate_ids", "SELECT l_orderkey, l_partkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def w8(spark, d):
    """Of lines with one number the row that stands first in the table counts;
    lines without a number come last."""
    return O.first_in_group(placed(spark, d, "lineitem"), ["l_orderkey", "l_suppkey"], ["l_linenumber", "place"]).select("l_orderkey", "l_partkey", "l_linenumber")


@query("w10_strictly_ascending", "SELECT event_id, value, before FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE value <= before")
def w10(spark, d):
    return O.descents(table(spark, d, "events").select("event_id", "user_id", "value"), ["user_id"], "event_id", "value").select("event_id", "value", "before")


@query("o1_platform_order", "SELECT n_name, row_number() OVER (ORDER BY CASE n_regionkey WHEN 3 THEN 0 WHEN 1 THEN 1 END NULLS LAST, n_name) AS pos FROM nation")
def o1(spark, d):
    from pyspark.sql import Window

    place = F.when(F.col("n_regionkey") == 3, 0).when(F.col("n_regionkey") == 1, 1)
    return table(spark, d, "nation").select("n_name", F.row_number().over(Window.orderBy(place.asc_nulls_last(), "n_name")).cast("long").alias("pos"))


@query("o3_reading_order", f"SELECT page, ord, row_number() OVER (PARTITION BY page ORDER BY y0, x0, block, ord) AS pos FROM ({LINES})")
def o3(spark, d):
    from pyspark.sql import Window

    return lines(spark, d).select("page", "ord", F.row_number().over(Window.partitionBy("page").orderBy(*O.in_reading_order(None))).cast("long").alias("pos"))


@query("o6_first_matches", "SELECT doc_id FROM documents WHERE contains(text, 'the') ORDER BY doc_id LIMIT 50")
def o6(spark, d):
    return table(spark, d, "documents").where(F.contains("text", F.lit("the"))).select("doc_id").orderBy("doc_id").limit(50)


@query("o8_diagnostic_caps", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn <= 5")
def o8(spark, d):
    return O.first_in_group(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id", 5)


# -- sets ------------------------------------------------------------------


@query("e1_ordered_union", "SELECT 0 AS source, n_name AS name FROM nation UNION ALL SELECT 1, r_name FROM region")
def e1(spark, d):
    return E.ordered_union(table(spark, d, "nation").select(F.col("n_name").alias("name")), table(spark, d, "region").select(F.col("r_name").alias("name")))


@query("e2_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def e2(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


NOW = "VALUES ('a','u1','html'), ('b','u2','html'), ('c','u3','pdf'), ('d','u4','html') AS t(guide, url, format)"
THEN = "VALUES ('b','u2','html'), ('c','u3','html'), ('d','u4','html') AS t(guide, url, format)"
DIG = "VALUES ('b','x','1'), ('b','y','2'), ('d','z','3') AS t(guide, url, digest)"
DIG_OLD = "VALUES ('b','x','1'), ('d','z','3') AS t(guide, url, digest)"


@query("e3_change_set", "SELECT * FROM (VALUES ('a','added'), ('b','changed'), ('c','replaced'), ('d','same')) AS t(guide, change)")
def e3(spark, d):
    return E.change_set(*(rows(spark, x) for x in (NOW, THEN, DIG, DIG_OLD)))


@query("e4_subset", "SELECT l_partkey AS k FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45) WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def e4(spark, d):
    used = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("k")).distinct()
    return E.subset_violations(used, table(spark, d, "part").where("p_size > 5").select(F.col("p_partkey").alias("k")), ["k"])


@query("e5_set_equality", "(SELECT c_nationkey AS k, 'left' AS side FROM (SELECT DISTINCT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)) UNION ALL (SELECT s_nationkey, 'right' FROM (SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal > 5000 EXCEPT SELECT c_nationkey FROM customer))")
def e5(spark, d):
    return E.differences(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).distinct(), table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")).distinct())


MEMBERS = "VALUES ('a.html', 10), ('A.html', 10), ('b/../c', 5), ('d', 1), ('d', 1) AS t(name, size)"


@query("e6_member_rules", "SELECT * FROM (VALUES ('b/../c','unsafe'), ('d','repeated'), ('A.html','confusable'), ('','too large')) AS t(name, problem)")
def e6(spark, d):
    return E.member_problems(rows(spark, MEMBERS), "name", "size", 20)


PART_NAMES = "CASE WHEN p_size = 1 THEN '../' || p_partkey WHEN p_size < 10 THEN 'type/' || p_type WHEN p_size < 20 THEN 'TYPE/' || upper(p_type) ELSE 'part/' || p_partkey END"


@query("e6_part_members", f"""
WITH m AS (SELECT {PART_NAMES} AS name, p_size AS size FROM part)
SELECT name, 'unsafe' AS problem FROM m WHERE name LIKE '../%'
UNION ALL SELECT name, 'repeated' FROM m GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT min(name), 'confusable' FROM (SELECT DISTINCT name FROM m) GROUP BY lower(name) HAVING count(*) > 1
UNION ALL SELECT '', 'too large' FROM m HAVING sum(size) > 1000""")
def e6_parts(spark, d):
    return E.member_problems(table(spark, d, "part").select(F.expr(PART_NAMES).alias("name"), F.col("p_size").alias("size")), "name", "size", 1000)
