"""Search over index rows (guide, title, url, text, ord). Two different rules
exist and stay apart: all terms anywhere, or the whole query as one text."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.html import pieces
from ..sources.shared import stored
from .gram_index import GramIndex


@F.arrow_udf(StringType())
def _nfkc(values: pa.Array) -> pa.Array:
    """Texts are normalised in pieces: of all others a task holds Arrow's bytes."""

    def made(v: str | None) -> str | None:
        return None if v is None else unicodedata.normalize("NFKC", v).lower()

    return pa.concat_arrays([pa.array([], pa.string()), *(pa.array([made(v) for v in values.slice(at, n).to_pylist()], pa.string()) for at, n in pieces(values))])


def normalised(c: Column, ascii_only: bool = False) -> Column:
    """Compatibility form in lower case; plain lower case (JVM side) serves
    where the caller knows that texts are ASCII."""
    if ascii_only:
        return F.lower(c)
    plain = F.octet_length(c) == F.length(c)  # ASCII texts never leave the JVM
    return F.when(plain, F.lower(c)).otherwise(_nfkc(F.when(~plain, c)))


def safe_link(url: Column) -> Column:
    """A relative link that stays inside the library: no scheme, no leading
    slash or backslash, and no `..` that climbs out."""
    parts = F.split(F.regexp_replace(url, r"[?#].*$", ""), "/")
    depth = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")),
        lambda s, p: F.struct((s["at"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("at"), F.least(s["low"], s["at"] + F.when(p == "..", -1).otherwise(0)).alias("low")),
    )
    return ~url.rlike(r"(?i)^[a-z][a-z\d+.\-]*:") & ~url.rlike(r"^[/\\]") & (depth["low"] >= 0)


def query_terms(query: str) -> list[str]:
    return unicodedata.normalize("NFKC", query).lower().split()


def release_text(ascii_only: bool = False) -> Column:
    """What a release search looks at."""
    return normalised(F.concat_ws(" ", "guide", "title", "text"), ascii_only)


def guide_text() -> Column:
    """What a guide search looks at."""
    return F.lower(F.concat_ws(" ", "title", "text"))


def _first_matches(rows: DataFrame, terms: list[str], limit: int, ascii_only: bool) -> DataFrame:
    """The first rows in index order with a snippet and the number of all:
    matches are found and counted in one pass; a snippet is made of few rows."""
    found = Observation()
    first = stored(rows.observe(found, F.count("*").alias("n")).orderBy("ord").limit(limit), "search")
    at = F.greatest(F.locate(terms[0] if terms else "", normalised(F.col("text"), ascii_only)) - 1 - 70, F.lit(0))
    return first.withColumns({"snippet": F.substring(F.col("text"), at + 1, F.lit(240)), "n_matches": F.lit(found.get["n"]).cast("long")}).orderBy("ord")


def release_search(index: DataFrame, query: str, limit: int = 50, ascii_only: bool = False) -> DataFrame:
    """Rows whose guide, title and text together hold every term, with a
    snippet and the number of all matches; the first `limit` in index order.
    Every row is looked at: for one search, or a few rows."""
    terms = query_terms(query)
    rows = index.where(safe_link(F.col("url"))).withColumn("hay_", release_text(ascii_only))
    for t in terms:
        rows = rows.where(F.contains("hay_", F.lit(t)))
    rows = rows if terms else rows.limit(0)
    return _first_matches(rows.drop("hay_"), terms, limit, ascii_only)


def guide_search(index: DataFrame, query: str, limit: int = 100) -> DataFrame:
    """Rows whose title and text hold the whole query as one text."""
    q = query.strip().lower()
    rows = index.where(F.contains(guide_text(), F.lit(q))) if q else index.limit(0)
    return rows.orderBy("ord").limit(limit)


def release_search_indexed(index: GramIndex, query: str, limit: int = 50) -> DataFrame:
    """release_search over an index of release_text: the same rows."""
    terms = query_terms(query)
    return _first_matches(index.holding(terms).where(safe_link(F.col("url"))).drop("hay"), terms, limit, False)


def guide_search_indexed(index: GramIndex, query: str, limit: int = 100) -> DataFrame:
    """guide_search over an index of guide_text: the same rows."""
    q = query.strip().lower()
    return index.holding([q] if q else []).drop("hay").orderBy("ord").limit(limit)


#: What the index holds for a guide whose pages it does not list (fixed text).
HTML_GUIDE = "Offline HTML guide."


def index_rows(guides: DataFrame, topics: DataFrame) -> DataFrame:
    """A guide's title row, then its topics: ordinals (guide, 0 or 1, ord)."""
    titles = guides.select("guide", F.lit(0).alias("part"), F.lit(0).cast("long").alias("ord"), "title", "url", F.when(F.col("format") == "pdf", "").otherwise(HTML_GUIDE).alias("text"))
    return titles.unionByName(topics.select("guide", F.lit(1).alias("part"), F.col("ord").cast("long").alias("ord"), "title", "url", "text"))
