"""One extractor over HTML: a page is parsed once, by a streaming parser of
the standard library with its own void and implied-end rules, and leaves flat
columns (title, headings, texts, links, ids, metadata, styles, flags)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType, StructField, StructType, _parse_datatype_string

#: Elements without content, and those whose start ends an open one (fixed).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {
    "p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
}
HIDDEN = frozenset(["script", "style", "template", "noscript"])

#: Titles of error and login pages (fixed pattern).
ERROR_TITLE = r"(?i)^(?:error(?:\s+\d+)?|access denied|unauthorized|forbidden|(?:404[ :\-]*)?(?:page|document|file) not found|sign in|log in|request rejected|service unavailable)(?:[.!:]|$)"

#: Bytes and rows of text that a task works on together.
PIECE, PIECE_ROWS = 1 << 20, 500

SPACE = re.compile(r"[\t\n\f\r ]+")

COLUMNS = "title string, h1 array<string>, h2 array<string>, text_joined string, text_spaced string, body_text string, links array<struct<ord:int,href:string,text:string>>, ids array<string>, metadata map<string,string>, styles array<string>, bases array<string>, images array<struct<ord:int,src:string,alt:string,srcset:string>>, toc array<struct<path:array<int>,title:string,href:string>>, has_password boolean, has_script boolean, n_elements int"


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.joined: list[str] = []
        self.spaced: list[str] = []
        self.body: list[str] = []
        self.caught: list[tuple[str, list[str]]] = []  # elements whose text is wanted
        self.found: dict[str, list[str]] = {"title": [], "h1": [], "h2": []}
        self.links, self.images, self.ids, self.styles, self.bases = [], [], {}, {}, []
        self.metadata: dict[str, str] = {}
        self.password = self.script = False
        self.elements = 0
        self.lists: list[int] = []  # position in each open list
        self.toc: list[list] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while self.open and tag in CLOSES.get(self.open[-1], ()):
            self._end(self.open[-1])
        at = {k: v or "" for k, v in reversed(attrs)}
        self.elements += 1
        for name in ("id", "name"):
            if at.get(name) and (name == "id" or tag == "a"):
                self.ids.setdefault(at[name])
        if tag == "a":
            self.links.append([at.get("href"), []])
            if self.lists and self.toc and self.toc[-1][2] is None:
                self.toc[-1][2] = at.get("href")
        elif tag == "img":
            self.images.append((len(self.images), at.get("src", ""), at.get("alt", ""), at.get("srcset", "")))
        elif tag == "meta" and at.get("name"):
            self.metadata.setdefault(at["name"].lower(), at.get("content", ""))
        elif tag == "link" and "stylesheet" in at.get("rel", "").lower().split() and at.get("href"):
            self.styles.setdefault(at["href"])
        elif tag == "base" and at.get("href"):
            self.bases.append(at["href"])
        elif tag == "input" and at.get("type", "").strip().lower() == "password":
            self.password = True
        elif tag == "script":
            self.script = True
        elif tag in ("ul", "ol"):
            self.lists.append(0)
        elif tag == "li" and self.lists:
            self.toc.append([[*(i - 1 for i in self.lists[:-1]), self.lists[-1]], [], None])
            self.lists[-1] += 1
        if tag in self.found:
            self.caught.append((tag, []))
        if tag not in VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            while self.open[-1] != tag:
                self._end(self.open[-1])
            self._end(tag)

    def _end(self, tag: str) -> None:
        self.open.pop()
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        if self.caught and self.caught[-1][0] == tag:
            name, parts = self.caught.pop()
            self.found[name].append(" ".join("".join(parts).split()))

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1] in HIDDEN:
            return
        for _, parts in self.caught:
            parts.append(data)
        if "a" in self.open and self.links:
            self.links[-1][1].append(data)
        if "title" in self.open:
            return
        self.joined.append(data)
        self.spaced.append(data + " ")
        if not {"nav", "header", "footer", "aside"} & set(self.open):
            self.body.append(data + " ")
        if "li" in self.open and self.toc:
            self.toc[-1][1].append(data)


def _flat(parts: list[str]) -> str:
    return SPACE.sub(" ", "".join(parts)).strip(" ")


def parse(html: str | None) -> tuple:
    page = _Page()
    page.feed(html or "")
    page.close()
    while page.open:
        page._end(page.open[-1])
    links = [(i, href, " ".join("".join(t).split())) for i, (href, t) in enumerate(page.links) if href is not None]
    toc = [(path, " ".join("".join(t).split()), href) for path, t, href in page.toc]
    return (next(iter(page.found["title"]), ""), page.found["h1"], page.found["h2"], " ".join("".join(page.joined).split()), _flat(page.spaced), _flat(page.body), links, list(page.ids), page.metadata, list(page.styles), page.bases, page.images, toc, page.password, page.script, page.elements)


def pieces(texts: pa.Array, size: int = PIECE, most: int = PIECE_ROWS) -> Iterator[tuple[int, int]]:
    """(start, rows) of runs of texts that hold about `size` bytes together, or
    one longer text, and at most `most` rows."""
    at, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).tolist()):
        if i > at and (held + n > size or i - at >= most):
            yield at, i - at
            at, held = i, 0
        held += n
    if len(texts):
        yield at, len(texts) - at


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """id, url and the extracted columns of each page: a map over rows, whose
    result is worth keeping, as parsing is the dear step. A task parses, and
    sends, pieces of a batch: their trees and texts are all that Python holds."""
    kinds = f"id long, url string, {COLUMNS}"
    schema = to_arrow_schema(StructType(_parse_datatype_string(kinds).fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in pieces(batch.column(2)):
                some = batch.slice(at, n)
                made = zip(*(parse(h) for h in some.column(2).to_pylist()))
                columns = [[list(m.items()) for m in c] if pa.types.is_map(f.type) else c for c, f in zip(made, list(schema)[2:])]
                yield pa.record_batch([some.column(0), some.column(1), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[2:]))], schema=schema)

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, kinds).withColumnsRenamed({"id": id_col, "url": url_col})


@F.pandas_udf(ArrayType(StructType([StructField("url", StringType()), StructField("descriptor", StringType())])))
def srcset(values: pd.Series) -> pd.Series:
    """The candidates of a srcset attribute, in order."""

    def one(value: str | None) -> list:
        out = []
        for m in re.finditer(r"[\s,]*([^\s,]\S*?)(,+(?=\s|$)|\s+([^,]*)(?:,|$)|$)", value or ""):
            out.append((m[1].rstrip(","), " ".join((m[3] or "").split())))
        return out

    return values.map(one)


def content_problem(title, h1, text, body_text, has_password, has_script, n_images):
    """Why a page is no content, null if it is: empty, login, error or shell."""
    heading = F.exists(F.concat(F.array(title), h1), lambda h: h.rlike(ERROR_TITLE))
    return F.when((text == "") & (n_images == 0), "empty").when(has_password, "login").when(heading, "error").when(has_script & (body_text == "") & (n_images == 0), "shell")
