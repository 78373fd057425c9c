"""A corpus pipeline: rules, classifier, exact and near dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the caller may
write it and hand the table to the next stage. All but the last return the
columns of the documents they were given, whatever other columns there are.
Near duplicates are judged on five-word shingles at a similarity of 0.8.

Every stage gives an empty table for an empty one. Rows that share an id are
one document where a stage chooses among documents; rows without an id are
never dropped as copies of one another by the near-duplicate stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import bpe, exact_dedup, near_dedup, packing, quality_classifier, quality_rules, queries
from docloom.llm._common import discard, shared_folder


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the divergence limits stay. Null
    and empty texts go; a null or unlisted language is judged against all such
    documents; equal rows are judged alike."""
    return quality_rules.drop_low_quality(docs)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay that the classifier scores at least KEEP_SCORE. It is
    fitted on all labelled documents of the corpus: those that earlier stages
    have dropped are the examples of the poor class. Null and empty texts are
    scored like any other; without labels of both classes all rows stay."""
    corpus = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality_classifier.fit(corpus, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.drop_poor(docs, model)


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: the longest as written, then
    that of the smallest id, ids before null; null and empty texts are equal."""
    return exact_dedup.drop_copies(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts stays, that of the smallest
    id. Texts without words are linked with nothing; rows without an id stay."""
    return near_dedup.drop_near_copies(docs, shingle=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every row with its bucket, batch and slot, by the tokens of the public
    tokenizer file; null and empty texts have none."""
    counted = bpe.with_token_counts(docs.select("doc_id", "text"), path or queries.tokenizer_path())
    return packing.pack(counted.select("doc_id", "n_tokens"))


STAGES = [("quality_rules", rules), ("quality_classifier", classify), ("exact_dedup", dedup_exact), ("near_dedup", dedup_near), ("packing", pack)]

#: The stages learn references and a classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written as
    Parquet to the shared folder and read again for the next. A table goes as
    soon as its successor is written; the last one stays, as the result reads
    it."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, f"pipeline-{name}")
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if last:
            discard(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
