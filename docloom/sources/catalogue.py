"""Catalogue sources: mapping files, strict JSON, checksums, robots rules.

Publisher JSON rejects duplicate keys and trailing data, which no built-in
JSON function does, so it is parsed in Arrow-batched Python; a file that fails
gets an error row and does not stop the others."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.folds import sorted_digest

MAX_RELEASES, MAX_ENTRIES, MAX_DEPTH = 1_000, 100_000, 100


class Duplicate(ValueError):
    pass


def _pairs(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise Duplicate("duplicate key")
    return out


def strict_json(text: str):
    """JSON without duplicate keys, trailing data or excessive depth; numbers
    stay as written. A byte-order mark is tolerated."""
    value = json.loads(text.removeprefix("\ufeff"), object_pairs_hook=_pairs, parse_int=str, parse_float=str)
    todo = [(value, 1)]
    while todo:
        v, depth = todo.pop()
        if depth > MAX_DEPTH:
            raise ValueError("too deep")
        todo += [(x, depth + 1) for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())]
    return value


def read_mappings(files: DataFrame) -> DataFrame:
    """files (guide_ord, guide_id, body) of {release: {platform: target}}:
    one row per mapping, or one with the file's error."""

    def rows(batch: pd.DataFrame) -> Iterator[tuple]:
        for at, guide, body in zip(batch["guide_ord"], batch["guide_id"], batch["body"]):
            try:
                data = strict_json(body or "")
                if not isinstance(data, dict) or len(data) > MAX_RELEASES or sum(len(p) if isinstance(p, dict) else 0 for p in data.values()) > MAX_ENTRIES:
                    raise ValueError("not a mapping of acceptable size")
                found = []
                for release, platforms in data.items():
                    if not release.strip() or not isinstance(platforms, dict):
                        raise ValueError("bad release")
                    for platform, target in platforms.items():
                        if not platform.strip() or not isinstance(target, str) or not target.strip():
                            raise ValueError("bad target")
                        found.append((at, guide, release, platform, target, None))
                yield from found
            except ValueError as e:
                yield at, guide, None, None, None, "duplicate key" if isinstance(e, Duplicate) else "invalid mapping"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(list(rows(batch)), columns=["guide_ord", "guide_id", "release", "platform", "target", "error"])

    return files.select("guide_ord", "guide_id", "body").mapInPandas(run, "guide_ord int, guide_id string, release string, platform string, target string, error string")


@F.pandas_udf(StructType([StructField("value", StringType()), StructField("error", StringType())]))
def canonical_json(texts: pd.Series) -> pd.DataFrame:
    """Strictly parsed JSON written with sorted keys, or the error."""

    def one(text):
        try:
            return json.dumps(strict_json(text), sort_keys=True, ensure_ascii=False), None
        except (ValueError, TypeError, RecursionError) as e:
            return None, "duplicate key" if isinstance(e, Duplicate) else "invalid JSON"

    return pd.DataFrame([one(t) for t in texts], columns=["value", "error"])


_JSON5 = re.compile(r"""\s+|//[^\n]*|/\*.*?\*/|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[A-Za-z_$][\w$]*|[-+]?(?:0[xX][0-9A-Fa-f]+|\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+)|[{}\[\]:,]""", re.S)


def json5(text: str) -> str:
    """JSON5 (bare keys, single quotes, comments, trailing commas, hex
    numbers) rewritten as JSON."""
    out, at = [], 0
    while at < len(text):
        m = _JSON5.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at]!r}")
        t, at = m[0], m.end()
        if t.isspace() or t.startswith(("//", "/*")):
            continue
        if t in "]}" and out and out[-1] == ",":
            out.pop()
        if t[0] == "'":
            t = json.dumps(re.sub(r"\\(['\"])", r"\1", t[1:-1]))
        elif t[0].isalpha() or t[0] in "_$":
            t = t if t in ("true", "false", "null") else json.dumps(t)
        elif re.match(r"[-+]?0[xX]", t):
            t = str(int(t, 16))
        elif t[0] in "+." or t[-1] == ".":
            t = str(float(t))
        out.append(t)
    return "".join(out)


@F.pandas_udf(StringType())
def module_body(sources: pd.Series) -> pd.Series:
    """The object of `define({...})` or `name = {...};`, as JSON; null if the
    script holds none."""

    def one(source):
        m = re.search(r"(?:define\s*\(|=)\s*(\{.*\})\s*\)?\s*;?\s*$", source or "", re.S)
        try:
            return json5(m[1]) if m else None
        except ValueError:
            return None

    return sources.map(one)


def charset_text(body: Column, content_type: Column) -> Column:
    """Decoded text: a byte-order mark is dropped, the header's charset holds
    (UTF-8 by default), and invalid UTF-8 is null."""
    charset = F.upper(F.regexp_extract(content_type, r"(?i)charset=\"?([A-Za-z0-9_\-]+)", 1))
    utf8 = F.when(F.is_valid_utf8(body.cast("string")), body.cast("string"))
    latin = F.decode(body, "ISO-8859-1")
    return F.regexp_replace(F.when(charset.isin("ISO-8859-1", "LATIN1"), latin).otherwise(utf8), "^\ufeff", "")


def checksums(lines: DataFrame, line: str = "value") -> DataFrame:
    """`<64 hex>  <path>` lines: path, sha256 and how often the path occurs."""
    parts = lines.select(F.regexp_extract(line, r"^([0-9a-f]{64}) [ *](.+)$", 1).alias("sha256"), F.regexp_extract(line, r"^([0-9a-f]{64}) [ *](.+)$", 2).alias("path"))
    return parts.where("path != ''").groupBy("path").agg(F.min("sha256").alias("sha256"), F.count("*").alias("n"))


def robots_policy(status: Column) -> Column:
    """What a robots.txt status means: its rules, no limits, or stop."""
    return F.when(status == 200, "rules").when((status >= 400) & (status < 500) & (status != 429), "allow all").otherwise("stop")


@F.pandas_udf(StringType())
def robots_problem(bodies: pd.Series, content_types: pd.Series) -> pd.Series:
    """Why a robots.txt body holds no recognisable rules (null: it does, or it
    is empty and sets no limits)."""

    def one(body: bytes | None, kind: str | None) -> str | None:
        try:
            text = (body or b"").decode("utf-8").removeprefix("\ufeff")
        except UnicodeDecodeError:
            return "encoding"
        media = (kind or "").partition(";")[0].strip().lower()
        if media == "text/html" or "json" in media or "xml" in media:
            return "content type"
        agent = known = some = False
        for line in text.split("\n"):
            line = line.partition("#")[0].strip()
            if not line:
                continue
            some = True
            name, colon, value = (p.strip() for p in line.partition(":"))
            if not colon or not re.fullmatch(r"[A-Za-z][A-Za-z0-9-]*", name):
                return "directive"
            name = name.lower()
            if name == "user-agent":
                if not value:
                    return "empty user-agent"
                agent = known = True
            elif name in ("allow", "disallow", "crawl-delay"):
                if not agent:
                    return "rule before any user-agent"
                if name == "crawl-delay" and not re.fullmatch(r"\d{1,9}(?:\.\d*)?|\.\d+", value):
                    return "crawl-delay"
            elif name == "sitemap":
                if not re.match(r"(?i)https?://[^/\s]", value):
                    return "sitemap"
                known = True
            elif name == "host":
                if not value or re.search(r"[/?#\s]", value):
                    return "host"
                known = True
        return "nothing recognisable" if some and not known else None

    return pd.Series([one(b, k) for b, k in zip(bodies, content_types)], dtype=object)


def verified(cache: DataFrame) -> DataFrame:
    """Cache rows with whether body, hash and size agree."""
    return cache.withColumn("valid", (F.sha2("body", 256) == F.col("sha256")) & (F.octet_length("body") == F.col("size")))


def revalidated(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """Keyed upsert: 304 only refreshes checked_at, 200 replaces the entry;
    credentials never stay in stored headers."""
    new = answers.select("url", F.col("status").alias("s_"), F.col("sha256").alias("h_"), F.col("checked_at").alias("c_"), F.col("headers").alias("m_"))
    out = cache.join(new, "url", "full")
    fresh = F.col("s_") == 200
    clean = lambda m: F.map_filter(m, lambda k, _: ~F.lower(k).isin("set-cookie", "cookie", "authorization", "proxy-authorization"))
    return out.select("url", F.when(fresh, F.col("h_")).otherwise(F.col("sha256")).alias("sha256"), F.coalesce(F.when(F.col("s_").isin(200, 304), F.col("c_")), "checked_at").alias("checked_at"), clean(F.when(fresh, F.col("m_")).otherwise(F.col("headers"))).alias("headers"))


@F.pandas_udf(StringType())
def pdf_problem(bodies: pd.Series) -> pd.Series:
    """Why bytes are no complete PDF, null if they are: header, trailer and a
    cross-reference section at the place that the trailer names."""

    def one(body: bytes | None):
        body = body or b""
        if not body.startswith(b"%PDF-"):
            return "no header"
        m = re.search(rb"startxref\s+(\d+)\s+%%EOF\s*$", body[-1024:])
        if not m:
            return "no trailer"
        at = body[int(m[1]) : int(m[1]) + 32]
        return None if at.startswith(b"xref") or re.match(rb"\d+\s+\d+\s+obj", at) else "no cross-reference"

    return bodies.map(one)


def tree_digest(files: DataFrame, by: str, path: str = "path", sha256: str = "sha256") -> DataFrame:
    """A digest of each tree: the hash of its files' sorted paths and hashes.
    Bodies are hashed where they lie; a tree's lines are sorted by ranges and
    hashed part by part, so a tree of any size is in no cell."""
    line = F.concat(F.col(path), F.lit("\t"), F.col(sha256))
    return sorted_digest(files, [by], [path, sha256], line, "\n")


def structured_lines(documents: DataFrame) -> DataFrame:
    """Structured-text XML (doc, body) as positioned lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xml.etree import ElementTree

        for batch in batches:
            out = []
            for doc, body in zip(batch["doc"], batch["body"]):
                for p, page in enumerate(ElementTree.fromstring(body).iter("page"), 1):
                    n = 0
                    for b, block in enumerate(page.iter("block")):
                        for line in block.iter("line"):
                            box = [float(x) for x in line.get("bbox", "0 0 0 0").split()]
                            font = max((float(f.get("size", 0)) for f in line.iter("font")), default=0.0)
                            out.append((doc, p, n, b, " ".join("".join(c.get("c", "") for c in line.iter("char")).split()), *box, font))
                            n += 1
            yield pd.DataFrame(out, columns=["doc", "page", "ord", "block", "text", "x0", "y0", "x1", "y1", "font"])

    return documents.select("doc", "body").mapInPandas(run, "doc long, page int, ord int, block int, text string, x0 double, y0 double, x1 double, y1 double, font double")


def hashed(value: bytes) -> str:
    return hashlib.sha256(value).hexdigest()
