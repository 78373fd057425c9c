"""URL functions. Clean URLs are served by built-in expressions; those that
must be checked and escaped go through Arrow-batched functions."""

from __future__ import annotations

import ipaddress
import posixpath
import re
import unicodedata
from urllib.parse import parse_qsl, unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

_SCHEME = re.compile(r"^([A-Za-z][A-Za-z0-9+.\-]*):")
#: Bytes that stay as they are in a path, and in a query or fragment (fixed).
SAFE_PATH = "/%:@!$&'()*+,;=-._~"
SAFE_QUERY = "/?%:@!$&'()*+,;=-._~"


def _escape(part: str, safe: str) -> str:
    return "".join(chr(b) if chr(b).isascii() and (chr(b).isalnum() or chr(b) in safe) else f"%{b:02X}" for b in part.encode())


def normalised(raw: str | None) -> str | None:
    """The URL with unsafe bytes escaped, or None where it is refused: control
    characters, backslashes, other schemes than http(s), user information, a
    bad port, address or escape. Query order, plus signs, existing escapes,
    the host's case, default ports and the fragment stay."""
    if raw is None or "\\" in raw or any(unicodedata.category(ch) == "Cc" for ch in raw):
        return None
    scheme = _SCHEME.match(raw)
    if not scheme or scheme[1].lower() not in ("http", "https") or not raw[scheme.end() :].startswith("//"):
        return None
    rest, mark, fragment = raw[scheme.end() + 2 :].partition("#")
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    path, ask, query = tail.partition("?")
    if not host or "@" in host or any(ch.isspace() for ch in host):
        return None
    if host.startswith("["):
        inside, bracket, port = host[1:].partition("]")
        try:
            ipaddress.ip_address(inside)
        except ValueError:
            return None
        if not bracket or (port and not port.startswith(":")):
            return None
        has_port, port = port.startswith(":"), port[1:]
    else:
        if host.count(":") > 1 or "]" in host or "[" in host:
            return None
        _, colon, port = host.partition(":")
        has_port = bool(colon)
        if not host.partition(":")[0]:
            return None
    if has_port and not (port.isascii() and port.isdigit() and 1 <= int(port) <= 65535):
        return None
    if any(re.search(r"%(?![0-9A-Fa-f]{2})", x) for x in (path, query, fragment)):
        return None
    out = f"{scheme[1].lower()}://{host}{_escape(path, SAFE_PATH)}"
    out += ask + _escape(query, SAFE_QUERY)
    return out + (("#" + _escape(fragment, SAFE_QUERY)) if fragment else "")


@F.pandas_udf(StringType())
def normalise(urls: pd.Series) -> pd.Series:
    return urls.map(normalised)


@F.pandas_udf(StringType())
def resolve(bases: pd.Series, references: pd.Series) -> pd.Series:
    """The reference as seen from the base, normalised; null if refused."""

    def one(base, ref):
        if base is None or ref is None:
            return None
        try:
            return normalised(urljoin(base, ref.strip()))
        except ValueError:
            return None

    return pd.Series([one(b, r) for b, r in zip(bases, references)])


@F.pandas_udf(StringType())
def relative_reference(owners: pd.Series, targets: pd.Series) -> pd.Series:
    """The local reference from one archive path to another."""

    def one(owner, target):
        if owner is None or target is None:
            return None
        return posixpath.relpath(target, posixpath.dirname(owner) or ".")

    return pd.Series([one(o, t) for o, t in zip(owners, targets)])


def _numeric_host(host: str) -> bool:
    last = host.rstrip(".").rpartition(".")[2]
    return bool(re.fullmatch(r"\d+|0[xX][0-9A-Fa-f]*", last))


def destination(raw: str | None) -> str | None:
    """public, loopback or refused: where a request to this URL would go."""
    clean = normalised(raw)
    if clean is None:
        return "refused"
    host = (urlsplit(clean).hostname or "").rstrip(".").lower()
    if host == "localhost" or host.endswith(".localhost"):
        return "loopback"
    try:
        address = ipaddress.ip_address(host)
    except ValueError:
        return "refused" if _numeric_host(host) or "." not in host else "public"
    inner = [address]
    if address.version == 6:
        inner += [a for a in (address.ipv4_mapped, address.sixtofour) if a is not None]
        if address in ipaddress.ip_network("64:ff9b::/96"):
            inner.append(ipaddress.ip_address(int(address) & 0xFFFFFFFF))
    if any(a.is_loopback for a in inner):
        return "loopback"
    return "public" if all(a.is_global and not a.is_multicast for a in inner) else "refused"


@F.pandas_udf(StringType())
def destination_class(urls: pd.Series) -> pd.Series:
    return urls.map(destination)


IDENTITY = StructType([StructField(name, StringType()) for name in ("document", "page", "query", "fragment")])


@F.pandas_udf(IDENTITY)
def document_identity(urls: pd.Series, hosts: pd.Series) -> pd.DataFrame:
    """Identity of a support-center link: its document and page, the other
    query fields sorted (presentation fields left out), and the fragment.
    Null where the link is of another host or names no document."""
    rows = []
    for raw, host in zip(urls, hosts):
        parts = urlsplit(normalised(raw) or "")
        fields = parse_qsl(parts.query, keep_blank_values=True)
        ids = [v for k, v in fields if k == "docId"]
        if parts.hostname != host or len(ids) != 1 or not re.fullmatch(r"[A-Za-z0-9_-]+", ids[0]):
            rows.append((None, None, None, None))
            continue
        page = next((v for k, v in fields if k == "page"), "")
        other = sorted(f"{k}={v}" for k, v in fields if k not in ("docId", "page", "docLocale", "mask", "ignorePayload"))
        rows.append((ids[0], page, "&".join(other), unquote(parts.fragment)))
    return pd.DataFrame(rows, columns=["document", "page", "query", "fragment"])


def _support_key(raw: str) -> str | None:
    """Document and page of a support-center address, however it is written;
    presentation fields don't count, other query fields do."""
    parts = urlsplit(raw)
    fields = parse_qsl(parts.query, keep_blank_values=True)
    of = lambda name: [v for k, v in fields if k == name]
    if len(of("docId")) > 1 or len(of("page")) > 1:
        return None
    document, page = next(iter(of("docId")), ""), next(iter(of("page")), "")
    way = parts.path.strip("/").split("/")
    shown = parts.path == "/hpesc/public/docDisplay"
    if not shown:
        if len(way) == 5 and way[:4] == ["hpesc", "public", "api", "document"] and document in ("", way[4]):
            document = way[4]
        elif len(way) == 4 and way[0] == "documents" and way[2] == "html" and document in ("", way[1]) and page in ("", way[3]):
            document, page = way[1], way[3]
        else:
            return None
    if not page and (shown or "true" in of("ignorePayload")[:1]):
        page = "index.html"
    if not document or not page:
        return None
    rest = sorted((k, v) for k, v in fields if k not in ("docId", "page", "mask", "ignorePayload"))
    return "\n".join([f"hpe:{parts.scheme.lower()}://{parts.netloc.lower()}", document, page, "&".join(f"{k}={v}" for k, v in rest)])


@F.pandas_udf(ArrayType(StringType()))
def identity_keys(urls: pd.Series) -> pd.Series:
    """Keys under which guides know a page: its canonical address, and the
    identity of a support-center page. No key for what is no address."""

    def one(raw: str | None) -> list[str]:
        clean = normalised(raw) if raw else None
        if not clean:
            return []
        address = clean.partition("#")[0]
        key = _support_key(address)
        return [f"url:{address}", *([key] if key else [])]

    return urls.map(one)


# -- built-in expressions for URLs that are clean already ------------------


def canonical(url: Column) -> Column:
    """Without the fragment."""
    return F.regexp_replace(url, "#.*$", "")


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, "#(.*)$", 1)


def origin(url: Column) -> Column:
    """Scheme and lower-case host; a default port is dropped."""
    base = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1))
    return F.regexp_replace(F.regexp_replace(base, r"^(https://.*):443$", "$1"), r"^(http://.*):80$", "$1")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def guide_root(url: Column) -> Column:
    """Up to the /Content/ folder, or else the document's directory."""
    clean = F.regexp_replace(url, "[?#].*$", "")
    return F.when(F.contains(clean, F.lit("/Content/")), F.regexp_extract(clean, "^(.*?/)Content/", 1)).otherwise(F.regexp_extract(clean, "^(.*/)", 1))


def inside(url: Column, root: Column) -> Column:
    """Is the URL under root, without dot segments that climb?"""
    parts = F.split(path(url), "/")
    return url.startswith(root) & ~F.exists(parts, lambda p: F.lower(F.replace(F.lower(p), F.lit("%2e"), F.lit("."))).isin(".", ".."))


def is_online(url: Column) -> Column:
    return url.rlike(r"(?i)^https?://")


def is_image(url: Column) -> Column:
    return F.lower(path(url)).rlike(r"\.(png|jpe?g|gif|webp|bmp|svg|avif)$")


def is_void(ref: Column) -> Column:
    """Links that lead nowhere: empty, a bare fragment mark or a script."""
    return (F.trim(ref) == "") | (F.trim(ref) == "#") | F.lower(F.trim(ref)).startswith("javascript:")


def file_name(url: Column, title: Column, stem_of, fallback: str = ".html") -> Column:
    """stem-hash.ext: the title's safe stem, 12 digits of the canonical URL's
    hash, and the path's extension if it is a plain one."""
    ext = F.lower(F.regexp_extract(path(url), r"(\.[^./]*)$", 1))
    ext = F.when((ext == "") | (F.octet_length(ext) > 10) | ext.rlike("[%&=?]"), fallback).otherwise(ext)
    return F.concat(stem_of(title), F.lit("-"), F.left(F.sha2(canonical(url), 256), F.lit(12)), ext)
