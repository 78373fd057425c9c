"""The thin queries of this subpackage, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, line_dedup, lm_scoring, merkle, near_dedup, packing, periodic_runs, quality_classifier, quality_rules, sharding, token_prefixes, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (
  SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
judged AS (
  SELECT d.doc_id, d.line, d.pos, s.k IS NOT NULL AND d.doc_id > s.first AS dropped
  FROM keyed d LEFT JOIN shared s ON d.k = s.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(_table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assign_shards(_table(spark, sf_dir, "documents"), shards=8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(spark, _table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest,
             max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM d
"""


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = quality_classifier.features(_table(spark, sf_dir, "documents"))
    model = quality_classifier.fit_features(known.where(_remainder(4) != 2), _table(spark, sf_dir, "labels"))
    rows = quality_classifier.score_features(known, model)
    return rows.select("doc_id", (_remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= quality_classifier.KEEP_SCORE).cast("int").alias("predicted"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS body FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY body ORDER BY chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY chars DESC, doc_id) = 1 AS kept,
       sha256(body) AS text_sha256
FROM n
"""


def _crc(name: str):
    """crc32 of a column as text; null counts as empty."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")))


def _remainder(of: int):
    """crc32 of the id as text, modulo `of`."""
    return _crc("doc_id") % of


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = lm_scoring.fit(docs, _remainder(7) != 2)
    rows = lm_scoring.score(docs, model)
    return rows.select("doc_id", (_remainder(7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.quality_report(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")


def op9_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = bpe.with_token_counts(_table(spark, sf_dir, "documents").select("doc_id", "text"), path or tokenizer_path())
    return packing.pack(docs.select("doc_id", "n_tokens"))


def op10_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return bpe.encode_digests(_table(spark, sf_dir, "documents"), path or tokenizer_path())


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.planted(_table(spark, sf_dir, "documents").select("doc_id", "text"), _crc("doc_id"))
    rows = periodic_runs.collapse_runs(docs)
    top = periodic_runs.strongest(F.col("runs"))
    rows = rows.select("doc_id", "runs", "collapsed", top.alias("top"))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "top.start",
        "top.length",
        "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(periodic_runs.runs_text(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(_remainder(3) == 0, merkle.leaf(*LEAF_FIELDS[:-1], lowered))
    rows = merkle.manifest(_table(spark, sf_dir, "documents"), LEAF_FIELDS, "lang", "doc_id", {"tampered": tampered})
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof"), F.col("slots"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _merkle_sql(levels: int, top_levels: int) -> str:
    """Level by level for that many levels of eight: enough for 8 ** levels
    rows of a language and 8 ** top_levels languages."""
    frame = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    head = " || ".join(frame(c) for c in LEAF_FIELDS[:-1])
    crc = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: ascii(d)::BIGINT)),
             lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))))"""
    parts = [
        f"""d AS (SELECT doc_id, lang, sha256({head} || {frame("text")}) AS leaf, CASE WHEN {crc} % 3 = 0 THEN sha256({head} || {frame(lowered)}) END AS other FROM documents)""",
        "l AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d)",
        "a0 AS (SELECT g, pos, leaf AS h, count(*) OVER (PARTITION BY g) AS c FROM l)",
    ]

    def tree(name: str, count: int) -> None:
        for i in range(count):
            run = f"PARTITION BY g, pos // 8 ORDER BY pos ROWS BETWEEN"
            parts.append(f"""{name}p{i} AS (SELECT g, pos, c, CASE WHEN c = 1 THEN '' ELSE coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS lft,
              CASE WHEN c = 1 THEN '' ELSE coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS rgt FROM {name}{i})""")
            parts.append(f"{name}{i + 1} AS (SELECT g, pos // 8 AS pos, CASE WHEN max(c) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h, (max(c) + 7) // 8 AS c FROM {name}{i} GROUP BY g, pos // 8)")

    tree("a", levels)
    parts.append(f"b0 AS (SELECT 1 AS g, g - 1 AS pos, h, count(*) OVER () AS c FROM a{levels})")
    tree("b", top_levels)
    last = "f0"
    parts.append(f"f0 AS (SELECT l.*, s.h AS subroot, r.h AS root, '' AS proof, coalesce(other, leaf) AS f FROM l JOIN a{levels} s USING (g) CROSS JOIN b{top_levels} r)")
    for i, (name, level, on) in enumerate([("a", k, f"p.g = f.g AND p.pos = f.pos // {8**k}") for k in range(levels)] + [("b", k, f"p.pos = (f.g - 1) // {8**k}") for k in range(top_levels)], 1):
        parts.append(f"f{i} AS (SELECT f.* REPLACE (proof || lft || rgt AS proof, CASE WHEN c = 1 THEN f ELSE sha256(lft || f || rgt) END AS f) FROM {last} f JOIN {name}p{level} p ON {on})")
        last = f"f{i}"
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM {last}"


OP12_SQL = _merkle_sql(6, 2)


def op13_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    rows = token_prefixes.count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), path or tokenizer_path("byte_bpe_50k.json"), budgets=[TOKEN_LIMIT])
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), F.col(f"fits_{TOKEN_LIMIT}").alias("chars_within_limit"))


#: Tokens of a text that op13 allows.
TOKEN_LIMIT = 1024


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_minhash_near_dedup, op3_sharding, op4_warc, op5_quality_classifier, op6_exact_dedup, op7_lm_scoring, op8_quality_rules, op9_packing, op10_bpe, op11_periodic_runs, op12_merkle_manifest, op13_token_counts)}
SQL = {"op1_line_dedup": OP1_SQL, "op4_warc": OP4_SQL, "op6_exact_dedup": OP6_SQL, "op12_merkle_manifest": OP12_SQL}
