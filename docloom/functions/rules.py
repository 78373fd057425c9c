"""Rule chains over records: gates, classes and reasons, first match wins."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .html import parse


def topic_gate(content_type: Column, body: Column) -> Column:
    """Why a body is no topic page, null if it may be one: its media type, a
    PDF signature, or a JSON answer in its place."""
    media = F.lower(F.trim(F.regexp_extract(content_type, "^([^;]*)", 1)))
    return F.when(~media.isin("", "text/html", "application/xhtml+xml"), "media type").when(body.startswith("%PDF-"), "pdf").when(F.trim(body).rlike(r"^[\[{]") & F.try_parse_json(body).isNotNull(), "json placeholder")


def stalled(error: Column, sent: Column, wanted: Column) -> Column:
    """Did a transfer stop before its end, rather than fail?"""
    return error.isin("timeout", "unexpected EOF") & (F.coalesce(sent, F.lit(0)) < F.coalesce(wanted, F.lit(1)))


def pdf_route(origin: Column, verified: Column, probed: Column) -> Column:
    """Which form a guide is taken in: a verified PDF by how it was found, or
    HTML with a warning."""
    return F.when(~probed, "html").when(verified & (origin == "direct"), "pdf direct").when(verified & (origin == "advertised"), "pdf advertised").when(verified & (origin == "export"), "pdf export").otherwise("html with warning")


def release_label_differs(text: Column, release: Column) -> Column:
    """Does the first release that a page names differ from the selected one?"""
    found = F.regexp_extract(text, r"(\d+\.\d+)", 1)
    return (found != "") & (found != F.regexp_extract(release, r"^(\d+\.\d+)", 1))


def navigation_class(url: Column, inside: Column) -> Column:
    """A navigation entry: a topic, a notice (outside, kept) or an error."""
    return F.when(~inside, "notice").when(F.lower(url).rlike(r"\.html?([?#].*)?$"), "topic").otherwise("error")


def root_wrapper(title: Column, url: Column, n_roots: Column, n_children: Column) -> Column:
    """Is the only root of a contents tree a wrapper around the real one?"""
    return (n_roots == 1) & (n_children > 0) & (F.coalesce(url, F.lit("")) == "") | F.lower(F.trim(title)).isin("contents", "table of contents")


def library_problem(exists: Column, has_manifest: Column, platform_ok: Column, version_ok: Column, only_pdfs: Column) -> Column:
    """Why a folder is refused as a library, null if it is not."""
    return F.when(~exists, None).when(only_pdfs, None).when(~has_manifest, "not a library").when(~platform_ok, "other platform").when(~version_ok, "other application version")


def generated_pdf_ok(pages: Column, bookmarks: Column, links: Column, sha256: Column) -> Column:
    return (pages > 0) & (bookmarks >= 0) & (links >= 0) & sha256.rlike("^[0-9a-f]{64}$")


def split_local(reference: Column) -> Column:
    """struct(target, query, fragment, local) of a local reference."""
    target = F.regexp_extract(reference, r"^([^?#]*)", 1)
    return F.struct(target.alias("target"), F.regexp_extract(reference, r"^[^?#]*\?([^#]*)", 1).alias("query"), F.regexp_extract(reference, r"#(.*)$", 1).alias("fragment"), (~reference.rlike(r"(?i)^([a-z][a-z0-9+.\-]*:|//|/)")).alias("local"))


def export_url(host: str, document: Column) -> Column:
    return F.concat(F.lit(f"https://{host}/export/pdf?docId="), document)


@F.pandas_udf(StringType())
def markup_text(markup: pd.Series) -> pd.Series:
    """The text of a title that is stored as markup."""
    return markup.map(lambda m: None if m is None else parse(m)[3])


@F.pandas_udf(StringType())
def pdf_title(bodies: pd.Series) -> pd.Series:
    """The title in a PDF's information dictionary (literal or hex string,
    UTF-16 with a mark or Latin); null if there is none."""

    def one(body: bytes | None):
        m = re.search(rb"/Title\s*(?:\(((?:[^()\\]|\\.)*)\)|<([0-9A-Fa-f\s]*)>)", body or b"", re.S)
        if not m:
            return None
        if m[2] is not None:
            digits = re.sub(rb"\s", b"", m[2])
            raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        else:
            named = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
            raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda e: bytes([int(e[1], 8) & 255]) if e[1].isdigit() else named.get(e[1], e[1]), m[1], flags=re.S)
        text = raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("latin-1")
        return " ".join(text.split())

    return bodies.map(one)


def pdf_counts(body: Column) -> Column:
    """struct(pages, links) counted in a PDF's text."""
    return F.struct(F.regexp_count(body, F.lit(r"/Type\s*/Page\b")).alias("pages"), F.regexp_count(body, F.lit(r"/Subtype\s*/Link\b")).alias("links"))
