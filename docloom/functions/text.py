"""Text and name functions as Column expressions (JVM side, no UDF but where
Spark has no such function)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space that RE2's \\s knows (fixed): not U+000B, which Java's \\s has.
SPACE = r"[\t\n\f\r ]+"

#: Words that do not tell one guide from another (fixed values).
GENERIC_WORDS = ["a", "an", "and", "for", "guide", "introduction", "of", "the", "to"]

#: Device names that no path component may have (fixed pattern).
RESERVED_NAME = r"(?i)^(?:con|prn|aux|nul|com[1-9]|lpt[1-9])(?:\..*)?$"


def collapse(c: Column) -> Column:
    """White-space runs to one space, trimmed."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def title_words(c: Column) -> Column:
    """Lower-case words of letters and digits, joined by a space."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{Nd}]+", " "))


def _singular(w: Column) -> Column:
    size = F.octet_length(w)
    return (
        F.when((size > 4) & w.endswith("ies"), F.concat(F.substring(w, F.lit(1), F.length(w) - 3), F.lit("y")))
        .when((size > 3) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), F.length(w) - 1))
        .otherwise(w)
    )


def singular_words(c: Column) -> Column:
    """title_words without plural endings (sizes are in bytes)."""
    return F.array_join(F.transform(F.split(title_words(c), " "), _singular), " ")


def title_names(guide_title: Column, pdf_title: Column) -> Column:
    """Does the PDF's title hold every distinctive word of the guide's?"""
    hay = F.concat(F.lit(" "), singular_words(pdf_title), F.lit(" "))
    words = F.filter(F.split(singular_words(guide_title), " "), lambda w: ~w.isin(*GENERIC_WORDS) & (w != ""))
    return F.forall(words, lambda w: F.contains(hay, F.concat(F.lit(" "), w, F.lit(" "))))


def bounded(c: Column, limit: int) -> Column:
    """Collapsed text of at most `limit` code points, cut with three dots."""
    flat = collapse(c)
    return F.when(F.char_length(flat) > limit, F.concat(F.left(flat, F.lit(limit - 3)), F.lit("..."))).otherwise(flat)


def shortened(c: Column, limit: int = 200) -> Column:
    """At most `limit` code points, cut with an ellipsis; not collapsed."""
    return F.when(F.char_length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("…"))).otherwise(c)


def safe_stem_ascii(c: Column) -> Column:
    """Safe stem of ASCII input: letters, digits, - and _; white space or a
    dot becomes one hyphen; at most 60 bytes; `resource` if nothing is left."""
    kept = F.regexp_replace(F.trim(c), r"[^A-Za-z0-9_\-.\s]+", "")
    # a separator after a hyphen (kept or made) adds nothing, nor one that leads
    hyphens = F.regexp_replace(F.regexp_replace(F.regexp_replace(kept, r"^[\s.]+", ""), r"-[\s.]+", "-"), r"[\s.]+", "-")
    stem = F.regexp_replace(F.left(hyphens, F.lit(60)), r"^[-._]+|[-._]+$", "")
    return F.when(stem == "", "resource").otherwise(stem)


@F.pandas_udf(StringType())
def safe_stem(values: pd.Series) -> pd.Series:
    """Safe stem of any input; the 60 bytes are counted as letters arrive."""

    def one(value: str | None) -> str | None:
        if value is None:
            return None
        out, size = [], 0
        for ch in value.strip():
            if ch in "-_" or unicodedata.category(ch) == "Nd" or ch.isalpha():
                out.append(ch)
                size += len(ch.encode())
            elif (ch.isspace() or ch == ".") and out and out[-1] != "-":
                out.append("-")
                size += 1
            if size >= 60:
                break
        return "".join(out).strip("-._") or "resource"

    return values.map(one)


def safe_component(c: Column) -> Column:
    """A path component; one that had to change, or is over 100 bytes, gets 10
    digits of its hash. Null where nothing usable is left."""
    clean = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._\-]+", "-"), r"^[.\-]+|[.\-]+$", "")
    named = F.when(clean.rlike(RESERVED_NAME), F.concat(F.lit("_"), clean)).otherwise(clean)
    hashed = F.concat(F.left(named, F.lit(80)), F.lit("-"), F.left(F.sha2(c, 256), F.lit(10)))
    usable = F.trim(c) != ""
    return F.when(usable & (clean != ""), F.when((named != c) | (F.octet_length(named) > 100), hashed).otherwise(named))


def safe_path(c: Column) -> Column:
    """Is it a relative slash path without empty, `.` or `..` parts?"""
    parts = F.split(c, "/")
    return (c != ".") & ~F.contains(c, F.lit("\\")) & ~F.exists(parts, lambda p: p.isin("", ".", ".."))


@F.pandas_udf(StringType())
def nfkc_words(values: pd.Series) -> pd.Series:
    """Compatibility form with white-space runs collapsed."""
    return values.map(lambda v: None if v is None else " ".join(unicodedata.normalize("NFKC", v).split()))


@F.pandas_udf(StringType())
def folded_path(values: pd.Series) -> pd.Series:
    """Case-folded canonical form: equal for names a file system may confuse."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", unicodedata.normalize("NFC", v).casefold()))


@F.pandas_udf(StringType())
def pdf_name(titles: pd.Series) -> pd.Series:
    """A readable PDF name: canonical form, no control, format or separator
    characters, collapsed; over 240 bytes it is cut and gets 10 hash digits."""
    import hashlib

    def one(title: str | None) -> str | None:
        if title is None:
            return None
        text = "".join(" " if ch in '<>:"/\\|?*' else ch for ch in unicodedata.normalize("NFC", title) if unicodedata.category(ch) not in ("Cc", "Cf") or ch in "\t\n\r")
        text = " ".join(text.split()).strip(" .") or "document"
        if len(text.encode()) > 236:
            text = text.encode()[:225].decode("utf-8", "ignore").rstrip(" .") + "-" + hashlib.sha256(title.encode()).hexdigest()[:10]
        return text + ".pdf"

    return titles.map(one)


def word_contains(text: Column, value: Column) -> Column:
    """Does text hold value as a whole word (letters, digits, underscore)?"""
    quoted = F.regexp_replace(value, r"([\\\[\](){}.*+?^$|])", r"\\$1")
    return F.call_function("rlike", text, F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), quoted, F.lit(r"(?![\p{L}\p{N}_])")))


def common_prefix(values: Column) -> Column:
    """The longest common prefix of an array of strings: that of its least
    and its greatest member."""
    lo, hi = F.array_min(values), F.array_max(values)
    same = F.filter(F.sequence(F.lit(0), F.least(F.char_length(lo), F.char_length(hi))), lambda n: F.substring(lo, F.lit(1), n) == F.substring(hi, F.lit(1), n))
    return F.substring(lo, F.lit(1), F.coalesce(F.array_max(same), F.lit(0)))


def without_display_none(style: Column) -> Column:
    """An inline style without its display:none declarations."""
    kept = F.filter(F.split(style, ";"), lambda d: ~d.rlike(r"(?i)^\s*display\s*:\s*none\b") & (F.trim(d) != ""))
    return F.array_join(F.transform(kept, lambda d: F.trim(d)), "; ")


def plural(n: Column, singular: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, singular).otherwise(many))


def outline_token(c: Column) -> Column:
    """Lower-case letters and digits only: the identity of an outline title."""
    return F.regexp_replace(F.lower(collapse(c)), r"[^\p{L}\p{Nd}]+", "")


def anchor(url: Column, prefix: str = "topic") -> Column:
    """A stable anchor from the hash of a canonical URL."""
    return F.concat(F.lit(f"{prefix}-"), F.left(F.sha2(url, 256), F.lit(24)))
