"""Rewriting of page content by allow-lists: removed elements go with what
they hold, unknown ones leave their text, handlers and foreign URLs go."""

from __future__ import annotations

from html import escape
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..operators.folds import framed_parts, sorted_parts
from .html import VOID, pieces

#: Elements that go with their content, and attributes that stay (fixed).
REMOVED = frozenset("script style iframe object embed form input button select textarea noscript template nav".split())
ATTRIBUTES = frozenset("id class title alt href src srcset colspan rowspan scope width height lang dir start type value headers".split())
URL_ATTRIBUTES = frozenset(["href", "src"])


class _Cleaner(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.problems: list[str] = []
        self.skip: list[str] = []
        self.ids: set[str] = set()

    def handle_starttag(self, tag, attrs):
        if self.skip or tag in REMOVED:
            if tag in REMOVED and not self.skip:
                self.problems.append(f"element {tag}")
            if tag not in VOID:
                self.skip.append(tag)
            return
        kept = []
        for key, value in attrs:
            value = value or ""
            if key not in ATTRIBUTES:
                if key.startswith("on"):
                    self.problems.append(f"attribute {key}")
                continue
            if key in URL_ATTRIBUTES and value.strip().lower().startswith(("javascript:", "data:text", "vbscript:")):
                self.problems.append(f"url {key}")
                continue
            if key == "id":
                if value in self.ids:
                    self.problems.append(f"repeated id {value}")
                    continue
                self.ids.add(value)
            kept.append(f' {key}="{escape(value)}"')
        self.out.append(f"<{tag}{''.join(kept)}>")

    def handle_endtag(self, tag):
        if self.skip:
            if tag in self.skip:
                while self.skip.pop() != tag:
                    pass
        elif tag not in VOID:
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(escape(data, quote=False))


def cleaned(html: str | None) -> tuple[str, list[str]]:
    parser = _Cleaner()
    parser.feed(html or "")
    parser.close()
    return "".join(parser.out), parser.problems


_CLEANED = pa.struct([("html", pa.string()), ("problems", pa.list_(pa.string()))])


@F.arrow_udf(StructType([StructField("html", StringType()), StructField("problems", ArrayType(StringType()))]))
def sanitise(pages: pa.Array) -> pa.Array:
    """Pages are cleaned in pieces; of all others a task holds Arrow's bytes."""
    made = (pa.array([cleaned(p) for p in pages.slice(at, n).to_pylist()], _CLEANED) for at, n in pieces(pages))
    return pa.concat_arrays([pa.array([], _CLEANED), *made])


def anchor_action(target: Column, href: Column, online: Column, image: Column | None = None) -> Column:
    """What becomes of a link: local if its page is archived, image if it leads
    to an archived image, online if it is absolute, kept if it is a fragment,
    removed otherwise."""
    to_image = image.isNotNull() if image is not None else F.lit(False)
    return F.when(target.isNotNull(), "local").when(to_image, "image").when(online, "online").when(href.startswith("#"), "fragment").otherwise("removed")


@F.pandas_udf(StringType())
def nested_list(paths: pd.Series, titles: pd.Series, hrefs: pd.Series) -> pd.Series:
    """A contents list (arrays in preorder: path, title, href) as HTML."""

    def one(path, title, href):
        out, depth = [], 0
        for p, t, h in zip(path, title, href):
            while depth < len(p):
                out.append("<ul>")
                depth += 1
            while depth > len(p):
                out.append("</ul>")
                depth -= 1
            label = escape(t or "", quote=False)
            out.append(f'<li><a href="{escape(h)}">{label}</a></li>' if h else f"<li>{label}</li>")
        return "".join(out) + "</ul>" * depth

    return pd.Series([one(p, t, h) for p, t, h in zip(paths, titles, hrefs)])


def escaped(text: Column) -> Column:
    """Text as it stands in markup and in quoted attributes."""
    out = text
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def topic_page(guide: Column, kind: Column, title: Column, url: Column, content: Column, before: Column, before_title: Column, after: Column, after_title: Column, footer: Column, toc: Column) -> Column:
    """A generated topic page: header, contents frame, content, navigation to
    the neighbours (null: none) and the notice of its source."""
    step = lambda rel, word, to, name: F.when(to.isNull(), F.lit("<span></span>")).otherwise(F.concat(F.lit(f'<a rel="{rel}" href="'), escaped(to), F.lit(f'">{word}: '), escaped(name), F.lit("</a>")))
    notice = F.coalesce(F.nullif(footer, F.lit("")), F.lit("Archived from the publisher source without altering substantive document content."))
    return F.concat(
        F.lit('<!doctype html><html lang="en"><head><meta charset="utf-8"><title>'), escaped(title), F.lit(" - "), escaped(guide),
        F.lit('</title></head><body class="archive-source-'), escaped(kind),
        F.lit('"><header class="archive-header"><a href="../index.html">'), escaped(guide),
        F.lit('</a></header><div class="archive-layout"><aside class="archive-toc"><iframe title="Guide contents" src="../toc.html#topic-'), escaped(toc),
        F.lit('"></iframe></aside><main class="archive-content">'), content,
        F.lit('</main></div><nav class="archive-nav">'), step("prev", "Previous", before, before_title), F.lit('<a href="../index.html">Guide index</a>'), step("next", "Next", after, after_title),
        F.lit('</nav><footer class="archive-footer"><p>'), escaped(notice), F.lit('</p><p><a href="'), escaped(url), F.lit('">View publisher source</a></p></footer></body></html>'),
    )


def _index_frame(topics, guide: str, order: str, title: str, path: str):
    """The head of each guide's index page, an item of it, and its end."""
    item = F.concat(F.lit('<li><a href="'), escaped(F.col(path)), F.lit('">'), escaped(F.col(title)), F.lit("</a></li>"))
    head = topics.groupBy(guide).agg(F.count("*").alias("topics"))
    head = head.withColumn("head", F.concat(F.lit("<!doctype html><title>"), escaped(F.col(guide).cast("string")), F.lit('</title><ol class="archive-index">')))
    return head, item, "</ol>"


def index_parts(topics, guide: str, order: str, title: str, path: str):
    """One generated index for each guide: its topics in reading order, as rows
    (guide, part, text) that make up the page in the order of part."""
    head, item, tail = _index_frame(topics, guide, order, title, path)
    narrow = topics.select(*dict.fromkeys([guide, order, path, title]))
    return framed_parts(sorted_parts(narrow, [guide], [order, path, title], item), [guide], head, tail)


def index_page(topics, guide: str, order: str, title: str, path: str):
    """One generated index for each guide: its topics in reading order."""
    item = F.concat(F.lit('<li><a href="'), escaped(F.col(path)), F.lit('">'), escaped(F.col(title)), F.lit("</a></li>"))
    rows = topics.groupBy(guide).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("i")))).alias("rows"), F.count("*").alias("topics"))
    body = F.concat(F.lit("<!doctype html><title>"), escaped(F.col(guide).cast("string")), F.lit('</title><ol class="archive-index">'), F.array_join(F.transform("rows", lambda r: r["i"]), ""), F.lit("</ol>"))
    return rows.select(guide, "topics", body.alias("html"))
