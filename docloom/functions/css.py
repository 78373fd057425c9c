"""Stylesheets and vector images: references, relevance and sanitising.

A stylesheet is cut into tokens (comments, strings, url(...), punctuation,
the rest), so that a reference inside a string or comment is never touched."""

from __future__ import annotations

import re
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructField, StructType

TOKEN = re.compile(
    r"""(?P<comment>/\*.*?(?:\*/|$))|(?P<url>url\(\s*(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[^)"'\s]*)\s*\))|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<at>@[\w-]+)|(?P<punct>[{};,])|(?P<space>\s+)|(?P<other>(?:(?!url\()[^{};,"'@/\s])+|.)""",
    re.S | re.I,
)


def unescape(text: str) -> str:
    """CSS escapes resolved: a backslash and one to six hex digits, or the
    character itself."""
    return re.sub(r"\\(?:([0-9A-Fa-f]{1,6})\s?|(.))", lambda m: chr(int(m[1], 16)) if m[1] and int(m[1], 16) < 0x110000 else m[2] or "\ufffd", text)


def _reference(token: str) -> str:
    inner = re.sub(r"(?is)^url\(\s*|\s*\)$", "", token)
    if inner[:1] in "\"'" and inner:
        inner = inner[1:-1]
    return unescape(inner)


def references(css: str | None) -> list[tuple[str, str]]:
    """(kind, reference) in order: import, font or image."""
    out, at, open_font, depth = [], "", False, 0
    for m in TOKEN.finditer(css or ""):
        kind, token = m.lastgroup, m[0]
        if kind == "at":
            at = token.lower()
            open_font = at == "@font-face"
        elif token == "{":
            depth += 1
        elif token == "}":
            depth -= 1
            open_font = False
            at = ""
        elif token == ";":
            at = "" if not open_font else at
        elif kind == "url" or (kind == "string" and at == "@import"):
            ref = _reference(token) if kind == "url" else unescape(token[1:-1])
            out.append(("import" if at == "@import" else "font" if open_font else "image", ref))
    return out


def rewritten(css: str | None, local: dict[str, str]) -> tuple[str, int, list[str]]:
    """The sheet with references replaced by their local files; others become
    an empty image. Also the number replaced, and those that were not known."""
    out, n, lost, importing, dropping = [], 0, [], False, False
    for m in TOKEN.finditer(css or ""):
        kind, token = m.lastgroup, m[0]
        if kind == "comment":
            continue
        if kind == "at":
            importing = token.lower() == "@import"
            start = len(out)
        if kind == "url" or (kind == "string" and importing):
            ref = _reference(token) if kind == "url" else unescape(token[1:-1])
            if ref in local:
                n += 1
                token = f'url("{local[ref]}")'
            elif not ref.startswith(("#", "data:")):
                lost.append(ref)
                dropping = importing
                token = "url(\"data:,\")"
        out.append(token)
        if token == ";" and importing:
            if dropping:
                del out[start:]
            importing = dropping = False
    return "".join(out), n, lost


@F.pandas_udf(ArrayType(StructType([StructField("kind", StringType()), StructField("reference", StringType())])))
def css_references(sheets: pd.Series) -> pd.Series:
    return sheets.map(references)


@F.pandas_udf(StructType([StructField("css", StringType()), StructField("rewritten", IntegerType()), StructField("lost", ArrayType(StringType()))]))
def css_rewrite(sheets: pd.Series, local: pd.Series) -> pd.DataFrame:
    """local: the known references of each sheet and their files (a map)."""
    return pd.DataFrame([rewritten(s, dict(m or {})) for s, m in zip(sheets, local)], columns=["css", "rewritten", "lost"])


LOCAL = MapType(StringType(), StringType())


def problem(css: str | None) -> str | None:
    """The first reference that leaves the archive, null if there is none."""
    for _, ref in references(css):
        clean = ref.strip()
        if re.match(r"(?i)^([a-z][a-z0-9+.\-]*:|//|/|\\)", clean) and not clean.startswith(("data:image/", "data:font/", "data:,")):
            return clean
    return None


@F.pandas_udf(StringType())
def css_problem(sheets: pd.Series) -> pd.Series:
    return sheets.map(problem)


#: Vector elements and attributes that stay (fixed values).
SVG_ELEMENTS = frozenset("svg g defs symbol use title desc path rect circle ellipse line polyline polygon text tspan lineargradient radialgradient stop clippath mask pattern marker filter fegaussianblur feoffset feblend fecolormatrix femerge femergenode".split())
_NS = "{http://www.w3.org/2000/svg}"


def sanitised_svg(text: str | None, prefix: str) -> tuple[str | None, list[str]]:
    """The image without scripts, handlers, foreign elements and outside
    references, its ids under a prefix of their own; and what was wrong."""
    problems: list[str] = []
    if text is None or re.search(r"<!(DOCTYPE|ENTITY)", text):
        return None, ["document type"]
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError:
        return None, ["not well-formed"]
    if root.tag != f"{_NS}svg":
        return None, ["not a vector image"]

    def clean(node: ElementTree.Element) -> None:
        for child in list(node):
            name = child.tag.removeprefix(_NS).lower() if isinstance(child.tag, str) else ""
            if not isinstance(child.tag, str) or not child.tag.startswith(_NS) or name not in SVG_ELEMENTS:
                problems.append(f"element {name or child.tag}")
                node.remove(child)
            else:
                clean(child)
        for key, value in list(node.attrib.items()):
            bare = key.rpartition("}")[2].lower()
            if bare.startswith("on") or (bare == "href" and not value.startswith("#")) or re.search(r"(?i)javascript:|url\(\s*['\"]?(?!#)", value):
                problems.append(f"attribute {bare}")
                del node.attrib[key]
            elif bare == "id":
                node.set(key, prefix + value)
            elif bare == "href":
                node.set(key, f"#{prefix}{value[1:]}")
            elif "url(#" in value:
                node.set(key, value.replace("url(#", f"url(#{prefix}"))

    clean(root)
    ids = {n.get("id") for n in root.iter()}
    used = {v[1:] for n in root.iter() for k, v in n.attrib.items() if k.endswith("href")}
    problems += [f"fragment {u}" for u in sorted(used - ids)]
    return ElementTree.tostring(root, encoding="unicode"), problems


@F.pandas_udf(StructType([StructField("svg", StringType()), StructField("problems", ArrayType(StringType()))]))
def svg_sanitise(images: pd.Series, prefixes: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([sanitised_svg(t, p or "") for t, p in zip(images, prefixes)], columns=["svg", "problems"])
