"""Rules over a page's tree: content, evidence, images, styles, policy."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from posixpath import basename, splitext
from urllib.parse import unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .css import problem as css_problem
from .css import unescape as css_unescape
from .dom import Node, markup, tree

#: What a publisher's page holds at least one of (fixed pattern).
SHAPE = r"(?i)<(?:html|main|article|body|div|nav)\b"

# Names, classes and attributes that the formats define.
CONTENT_RULES = {
    "flare": [("id", "mc-main-content"), ("tag", "main"), ("tag", "article"), ("tag", "body")],
    "hpe": [("main", "ditasrc"), ("tag", "main"), ("tag", "article"), ("tag", "body")],
    "static": [("class", "wh_topic_content"), ("tag", "main"), ("tag", "article")],
    "other": [("tag", "main"), ("tag", "article"), ("tag", "body")],
}
RASTER_MEDIA = {"image/png": "png", "image/jpeg": "jpeg", "image/gif": "gif", "image/webp": "webp", "image/avif": "avif"}
RASTER_NAMES = {".png": "png", ".jpg": "jpeg", ".jpeg": "jpeg", ".gif": "gif", ".webp": "webp", ".avif": "avif"}
SOURCE_KEYS = ("data-original", "data-mc-popup-src", "data-src", "src")
SET_KEYS = ("data-srcset", "srcset")
COMMAND_CLASSES = {"screen", "codeblock"}
EXCLUDED_CLASSES = {"archive-nav", "archive-provenance", "archive-footer"}
LAZY_CLASSES = {"loading", "is-loading", "lazy", "lazy-load", "not-ready", "toc-loading", "wh_toc_loading"}
CONTENTS_LABELS = {"contents", "table of contents", "detailed table of contents"}
FAMILY = "TableStyle-"
#: Pages whose results a task sends together.
PAGES = 1000


def per_page(pages: DataFrame, rule: Callable[..., list[tuple]], schema: str, keys: list[str], inputs: list[str]) -> DataFrame:
    """Rows of rule(*inputs) for each page, with the page's keys: a map over
    rows in Arrow batches."""
    names = [c.split(" ")[0] for c in re.split(r", (?=\w+ )", schema)]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keys).schema)
    arguments = [f"in{i}_" for i in range(len(inputs))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), PAGES):
                own, made, some = [], [], batch.iloc[at : at + PAGES]
                for key, given in zip(some[keys].itertuples(index=False), some[arguments].itertuples(index=False)):
                    for row in rule(*given):
                        own.append(tuple(key))
                        made.append(tuple(row))
                yield pd.concat([pd.DataFrame(own, columns=keys), pd.DataFrame(made, columns=names)], axis=1)

    rows = pages.select(*keys, *(F.col(c).alias(a) for c, a in zip(inputs, arguments)))
    return rows.mapInPandas(run, f"{fields}, {schema}")


def has_shape(html: Column) -> Column:
    """Whether a response is a publisher's page and no stray body."""
    return F.coalesce(html.rlike(SHAPE), F.lit(False))


# -- content ---------------------------------------------------------------


def content_node(doc: Node, kind: str) -> Node | None:
    """The first element, in document order, of the first rule that has one."""
    tests = {
        "id": lambda n, v: n.at.get("id") == v,
        "class": lambda n, v: v in n.classes(),
        "tag": lambda n, v: n.tag == v,
        "main": lambda n, v: n.tag == "main" and v in n.classes(),
    }
    for how, value in CONTENT_RULES.get(kind, CONTENT_RULES["other"]):
        if found := doc.find(lambda n: tests[how](n, value)):
            return found
    return None


def flat(text: str) -> str:
    return " ".join(text.split())


def main_content(html: str | None, kind: str) -> list[tuple]:
    """(element, id, text, whether it is an empty topic) of the main content."""
    node = content_node(tree(html), kind)
    if node is None:
        return []
    text = flat(node.text(" "))
    topic = node.find(lambda n: "topic/topic" in n.classes())
    seen = node.find(lambda n: n.tag in ("img", "svg", "picture", "object", "video"))
    return [(node.tag, node.at.get("id"), text, text == "" and topic is not None and seen is None)]


def contents_links(html: str | None, url: str | None, root: str | None) -> list[tuple]:
    """Links labelled as a table of contents, inside root, not to the page
    itself, once each."""
    own, out = urljoin(url or "", "").partition("#")[0], {}
    for a in tree(html).walk():
        if a.tag == "a" and "href" in a.at and flat(a.text()).lower() in CONTENTS_LABELS:
            link = urljoin(url or "", a.at["href"]).partition("#")[0]
            if link.startswith(root or "") and link != own:
                out.setdefault(link)
    return [(i, link) for i, link in enumerate(out)]


def advertised_pdfs(html: str | None, url: str | None) -> list[tuple]:
    """The one PDF of the page's own origin that it advertises by type,
    download name, relation, embedding or label; nothing if there are several."""
    where, found = {"a": "href", "link": "href", "iframe": "src", "embed": "src", "object": "data"}, {}
    home = urlsplit(url or "")
    for n in tree(html).walk():
        if not n.at.get(where.get(n.tag, "")):
            continue
        link = urljoin(url or "", n.at[where[n.tag]])
        to = urlsplit(link)
        if (to.scheme, to.netloc) != (home.scheme, home.netloc):
            continue
        pdf, label = to.path.lower().endswith(".pdf"), bool(re.search(r"(?i)\bpdf\b", n.text()))
        named = "download" in n.at and (pdf or n.at["download"].lower().endswith(".pdf") or label)
        shown = n.tag in ("embed", "iframe", "object") or "alternate" in n.at.get("rel", "").lower().split() or label
        if n.at.get("type", "").partition(";")[0].strip().lower() == "application/pdf" or named or pdf and shown:
            found.setdefault(link)
    return [(link,) for link in found] if len(found) == 1 else []


def containers(html: str | None) -> list[tuple]:
    """Tables of contents: (ord, element, whether it loads later, its nearest
    list item or null, list items inside)."""
    out = []
    for n in tree(html).walk():
        toc = n.tag == "nav" and (n.at.get("role", "").lower() == "doc-toc" or n.at.get("aria-label", "").lower() == "table of contents" or "toc" in n.classes())
        if "wh_publication_toc" in n.classes() or n.at.get("id") == "toc" or toc:
            state = {k: n.at.get(k, "").strip().lower() for k in ("data-state", "data-ready", "data-loaded", "data-lazy", "aria-busy")}
            later = state["aria-busy"] == "true" or state["data-state"] in ("not-ready", "loading", "pending") or state["data-ready"] == "false" or state["data-loaded"] == "false" or state["data-lazy"] == "true" or bool(LAZY_CLASSES & set(n.at.get("class", "").lower().split()))
            item = next((p for p in n.above() if p.tag == "li"), None)
            out.append((len(out), n.tag, later, item.at.get("id") if item else None, sum(k.tag == "li" for k in n.walk())))
    return out


def anchors(html: str | None) -> list[tuple]:
    """(ord, href, excluded): links below an archive's own navigation,
    provenance or footer are not rewritten across guides."""
    links = [n for n in tree(html).walk() if n.tag == "a" and "href" in n.at]
    return [(i, n.at["href"], any(EXCLUDED_CLASSES & set(p.classes()) for p in n.above())) for i, n in enumerate(links)]


# -- evidence --------------------------------------------------------------


def evidence_rows(text: str) -> list[str]:
    """The lines of a text in compatibility form, blanks dropped."""
    return [row for line in text.split("\n") if (row := flat(unicodedata.normalize("NFKC", line)))]


def evidence(html: str | None) -> list[tuple]:
    """(kind, value) of a page: its command rows, table headers and texts.
    Text inside `pre` and `code` counts by rows of the outermost of them."""
    out: list[tuple] = []
    texts: list[tuple] = []

    def enter(n: Node, state: tuple[bool, bool, bool]) -> tuple[bool, bool, bool]:
        in_command, in_head, in_literal = state
        command, literal = bool(COMMAND_CLASSES & set(n.classes())), n.tag in ("pre", "code")
        if command and not in_command:
            out.extend(("command", row) for row in evidence_rows(n.text()))
        if n.tag in ("th", "td") and in_head and (value := flat(unicodedata.normalize("NFKC", n.text()))):
            out.append(("header", value))
        if literal and not in_literal:
            found = evidence_rows(n.text())
            out.extend(("text", row) for row in found)
            if not command and not in_command:
                out.extend(("command", row) for row in found)
        if not literal and not in_literal:
            texts.extend(("text", row) for k in n.kids if isinstance(k, str) for row in evidence_rows(k))
        return in_command or command, in_head or n.tag == "thead", in_literal or literal

    tree(html).visit((False, False, False), enter)
    return out + texts


# -- images ----------------------------------------------------------------


def raster(raw: str, declared: str) -> str | None:
    """The raster kind that a declared type or the name tells; null if they
    disagree or it is none."""
    name = splitext(urlsplit(raw).path)[1].lower()
    known, declared = RASTER_NAMES.get(name), declared.partition(";")[0].strip().lower()
    if not declared:
        return known
    kind = RASTER_MEDIA.get(declared)
    return kind if name != ".svg" and known in (None, kind) else None


def set_members(value: str) -> list[str]:
    return [m[1].rstrip(",") for m in re.finditer(r"[\s,]*([^\s,]\S*?)(?:,+(?=\s|$)|\s+[^,]*(?:,|$)|$)", value)]


def image_candidates(html: str | None) -> list[tuple]:
    """(image, ord, source, kind): the sources of each image slot in order of
    preference, if all of them are rasters. An empty source has the kind null
    and spoils its slot."""
    out = []
    images = [n for n in tree(html).walk() if n.tag == "img"]
    for i, image in enumerate(images):
        given: list[tuple[str, str]] = []
        slot = image.up if image.up.tag == "picture" else image
        if slot.tag == "picture":
            for s in slot.kids:
                if isinstance(s, Node) and s.tag == "source":
                    for key in ("src", "srcset", "data-srcset"):
                        if key in s.at:
                            given += [(v, s.at.get("type", "")) for v in ([s.at[key]] if key == "src" else set_members(s.at[key]))]
        given += [(image.at[k], image.at.get("type", "")) for k in SOURCE_KEYS if k in image.at]
        given += [(v, image.at.get("type", "")) for k in SET_KEYS if k in image.at for v in set_members(image.at[k])]
        kinds: dict[tuple[str, str | None], None] = {}
        for raw, declared in given:
            raw = raw.strip()
            kinds.setdefault((raw, "data" if raw.lower().startswith("data:") else raster(raw, declared) if raw else None))
        if kinds and all(kind for _, kind in kinds):
            out += [(i, k, raw, kind) for k, (raw, kind) in enumerate(kinds)]
        elif any(not raw for raw, _ in kinds):
            out.append((i, 0, "", None))
    return out


def rewritten_images(html: str | None, url: str | None, files: dict[str, str] | None) -> list[tuple]:
    """(html, missing): each image's first source that is no data becomes the
    local file of its address; what has no file is named."""
    doc, missing, files = tree(html), [], dict(files or {})

    def local(raw: str) -> str:
        address = urljoin(url or "", raw)
        if address not in files:
            missing.append(address)
        return files.get(address, raw)

    for n in doc.walk():
        if n.tag == "img":
            for key in SOURCE_KEYS:
                value = n.at.get(key, "").strip()
                if value and not value.lower().startswith("data:"):
                    n.at["src"] = local(value)
                    for old in SOURCE_KEYS[:-1]:
                        n.at.pop(old, None)
                    break
        if n.tag in ("img", "source") and n.at.get("srcset"):
            parts = [p.split() for p in re.split(r",\s+", n.at["srcset"].strip()) if p.strip()]
            n.at["srcset"] = ", ".join(" ".join([local(p[0]), *p[1:]]) for p in parts)
        if n.at.get("background", "").strip():
            n.at["background"] = local(n.at["background"].strip())
    return [(markup(doc), missing)]


def full_images(html: str | None, url: str | None) -> list[tuple]:
    """(html, problem): thumbnails of old guides give way to the full image
    that they advertise."""
    doc, problem = tree(html), None
    marked = lambda n, name: name.lower() in map(str.lower, n.classes())
    for n in list(doc.walk()):
        if n.tag == "a" and marked(n, "MCPopupThumbnailLink"):
            inside = [k for k in n.walk() if k.tag == "img"]
            if len(inside) != 1:
                problem = problem or "a popup must hold exactly one image"
                continue
            image, full = inside[0], n.at.get("href", "").strip()
        elif n.tag == "img" and marked(n, "MCPopupThumbnail"):
            image, full = n, ""
        else:
            continue
        full = full or next((v for k in ("data-mc-popup-src", "data-original") if (v := image.at.get(k, "").strip())), "")
        address = urljoin(url or "", full)
        if not full or urlsplit(address).scheme not in ("http", "https"):
            problem = problem or "a thumbnail names no full image"
            continue
        for key in ("srcset", "data-srcset", "sizes", "data-original", "data-mc-popup-src", "data-src", "width", "height", "style"):
            image.at.pop(key, None)
        image.at |= {"src": address, "class": " ".join([*(c for c in image.classes() if not c.lower().startswith("mcpopup")), "archive-full-image"])}
        if image.up.tag == "picture":
            image.up.kids = [k for k in image.up.kids if not (isinstance(k, Node) and k.tag == "source")]
        if n is not image:
            n.tag = "span"
            for key in ("href", "target", "rel", "download", "role", "aria-haspopup", "aria-expanded", "aria-controls"):
                n.at.pop(key, None)
            n.at["class"] = " ".join([*(c for c in n.classes() if not c.lower().startswith("mcpopup")), "archive-full-image-container"])
    return [(markup(doc), problem)]


# -- styles and policy -----------------------------------------------------


def style_family(address: str) -> str | None:
    """The table style that a stylesheet of that name defines."""
    name, kind = splitext(unquote(basename(urlsplit(address).path)))
    return FAMILY + name if name and kind.lower() == ".css" else None


def table_styles(html: str | None, url: str | None) -> list[tuple]:
    """(stylesheet, family): families that a table uses and whose sheet the
    page names, by the table itself or by a link for tables."""
    doc, used, named = tree(html), set(), {}
    for n in doc.walk():
        if n.tag == "table":
            families = {c for c in n.classes() if c.startswith(FAMILY) and c != FAMILY}
            used |= families
            sheet = n.at.get("mc-table-style", "").strip()
            if sheet and style_family(urljoin(url or "", sheet)) in families:
                named.setdefault(urljoin(url or "", sheet))
    for n in doc.walk():
        if n.tag == "link" and "stylesheet" in n.at.get("rel", "").lower().split() and not n.at.get("disabled"):
            sheet = urljoin(url or "", n.at.get("href", ""))
            if n.at.get("data-mc-stylesheet-type", "").strip().lower() == "table" and style_family(sheet) in used:
                named.setdefault(sheet)
    return [(sheet.partition("#")[0], style_family(sheet)) for sheet in named]


def defined_families(sheet: str | None) -> list[tuple]:
    """The table styles that the selectors of a stylesheet name."""
    plain = re.sub(r"/\*.*?\*/|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'", " ", sheet or "", flags=re.S)
    found = {css_unescape(c) for head in re.findall(r"([^{}]*)\{", plain) for c in re.findall(r"\.((?:[\w-]|\\.)+)", head)}
    return [(c,) for c in sorted(found) if c.startswith(FAMILY)]


def one_font_source(entry: str | None) -> bool:
    """Whether a font source loads exactly one address."""
    plain = re.sub(r"/\*.*?\*/", " ", entry or "", flags=re.S)
    return not re.search(r"(?i)(?:-webkit-)?image-set\(", plain) and len(re.findall(r"(?i)(?<![\w-])url\(", plain)) == 1


# -- identity --------------------------------------------------------------


def page_identity_problem(requested: Column, received: Column, document_header: Column, page_header: Column, mains: Column, text: Column, structured: Column) -> Column:
    """Why a support-center response is not the requested page (null: it is).
    requested and received: structs of document_identity with their address."""
    same = lambda part: requested[part].eqNullSafe(received[part])
    differs = lambda header, part: (F.coalesce(header, F.lit("")) != "") & (header != requested[part])
    return (
        F.when(requested["document"].isNull(), "invalid request identity")
        .when(~(same("document") & same("page") & same("query") & same("address")), "document, page or query mismatch")
        .when(differs(document_header, "document"), "document header mismatch")
        .when(differs(page_header, "page"), "page header mismatch")
        .when((mains != 1) | (F.trim(text) == "") | ~structured, "no genuine topic content")
    )


def main_elements(html: str | None) -> list[tuple]:
    """(number of support-center content elements, text of the first, whether
    it holds a heading or an article)."""
    found = [n for n in tree(html).walk() if n.tag == "main" and "ditasrc" in n.classes()]
    if not found:
        return [(0, "", False)]
    return [(len(found), flat(found[0].text(" ")), found[0].find(lambda n: n.tag in ("h1", "article")) is not None)]


# -- support-center contents ----------------------------------------------

#: A topic of a support-center document (fixed pattern).
TOPIC_LINK = re.compile(r"^[A-Za-z0-9][A-Za-z0-9_.-]*\.html?(?:#[^#\s]*)?$")


def support_contents(text: str | None) -> list[tuple]:
    """(path, title, page, fragment, problem) in reading order of a contents
    file: an array of topics with a name, a link or children."""
    import json

    try:
        top = json.loads(text or "")
    except ValueError:
        top = None
    if not isinstance(top, list) or not top:
        return [([], None, None, None, "no topic array")]
    out, todo = [], [([i], node) for i, node in reversed(list(enumerate(top)))]
    while todo:
        path, node = todo.pop()
        title = node.get("topicName") if isinstance(node, dict) else None
        if not isinstance(title, str) or not title.strip():
            out.append((path, None, None, None, "no topic name"))
            continue
        link, below = node.get("topicLink") or None, node.get("children") or []
        if not isinstance(below, list):
            out.append((path, title, None, None, "invalid children"))
            continue
        if link is None:
            out.append((path, title, None, None, None if below else "leaf without link"))
        elif not isinstance(link, str) or not TOPIC_LINK.match(link):
            out.append((path, title, None, None, "unsupported link"))
        else:
            page, mark, fragment = link.partition("#")
            out.append((path, title, page, fragment if mark else None, None))
        todo += [([*path, i], child) for i, child in reversed(list(enumerate(below)))]
    return out
