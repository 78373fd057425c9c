"""Release labels, routes, availability and failure classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of release labels and folder names (fixed).
RELEASE = r"^\d+\.\d+(?:\.(?:\d+|[xX]+))*$"
FOLDER = r"^[A-Za-z0-9](?:[A-Za-z0-9 _().,-]*[A-Za-z0-9)_.-])?$"


def release_key(label: Column) -> Column:
    """A key whose order is the releases' order: leading digits of each
    component (none: 0), a last `.xxxx` as 9999, without zeros at the end."""
    last = F.regexp_replace(label, r"(?i)\.xxxx$", ".9999")
    numbers = F.transform(F.split(last, r"\."), lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r"^(\d+)", 1), F.lit("")).try_cast("decimal(38,0)"), F.lit(0)))
    used = F.array_max(F.transform(numbers, lambda n, i: F.when(n != 0, i + 1)))
    return F.slice(numbers, 1, F.coalesce(used, F.lit(0)))


def compare_releases(a: Column, b: Column) -> Column:
    x, y = release_key(a), release_key(b)
    return F.when(x > y, 1).when(x < y, -1).otherwise(0)


def route(release: Column, guide: Column, target: Column, root: Column, family: str) -> Column:
    """struct(kind, url, error): the document that a folder target stands for
    in a release. Targets that are not plain folders are errors, never guesses."""
    key = release_key(release)
    at = lambda text: F.array(*(F.lit(int(x)).cast("decimal(38,0)") for x in text.split(".")))
    folder = F.replace(target, F.lit(" "), F.lit("%20"))
    error = F.when(~target.rlike(FOLDER) | F.contains(target, F.lit("..")), "unsupported target").when(~release.rlike(RELEASE), "unsupported release").when(root == "", "no documentation root")
    made = (
        F.when(key >= at("10.17"), F.struct(F.lit("static").alias("kind"), F.concat(root, F.lit(f"{family}/"), release, F.lit(".xxxx/HTML/"), folder, F.lit("/index.html")).alias("url")))
        .when((key > at("10.12")) & (guide == "cli"), F.struct(F.lit("pdf").alias("kind"), F.concat(root, F.lit(f"{family}/"), release, F.lit("/PDF/"), folder, F.lit(".pdf")).alias("url")))
        .when(key > at("10.12"), F.struct(F.lit("flare").alias("kind"), F.concat(root, F.lit(f"{family}/"), release, F.lit("/HTML/"), folder, F.lit("/Content/home.htm")).alias("url")))
        .otherwise(F.struct(F.lit("pdf").alias("kind"), F.concat(root, F.lit(f"Archived/{family}/"), release, F.lit("/PDF/"), folder, F.lit(".pdf")).alias("url")))
    )
    return F.struct(F.when(error.isNull(), made["kind"]).alias("kind"), F.when(error.isNull(), made["url"]).alias("url"), error.alias("error"))


def application_version(label: Column) -> Column:
    """struct(major, minor, patch), or null where the label is no version."""
    part = lambda i: F.regexp_extract(label, r"^v?(\d+)\.(\d+)(?:\.(\d+))?$", i)
    number = lambda i: F.coalesce(F.nullif(part(i), F.lit("")).cast("int"), F.lit(0))
    return F.when(label.rlike(r"^v?\d+\.\d+(\.\d+)?$"), F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch")))


def availability(status: Column) -> Column:
    """available, unavailable (404 and 410 only) or unknown (all else)."""
    return F.when(status.between(200, 299), "available").when(status.isin(404, 410), "unavailable").otherwise("unknown")


def retryable(status: Column) -> Column:
    return status.isin(408, 425, 429, 500, 502, 503, 504)


def raster_failure(status: Column, error: Column) -> Column:
    """The class of a failed image, null where it may not be replaced."""
    return F.when(status == 404, "http-404").when(status == 410, "http-410").when(error == "timeout", "timeout").when(error == "unexpected EOF", "incomplete-body").when(retryable(status), "retry-exhausted")


def retry_delay(attempt: Column, retry_after: Column) -> Column:
    """Seconds to wait: 1 doubled by attempt, or what the server asks for if
    longer; null (give up) where it asks for more than 300."""
    own = F.pow(F.lit(2), attempt).cast("long")
    asked = retry_after.cast("long")
    return F.when(asked > 300, F.lit(None).cast("long")).otherwise(F.greatest(own, F.coalesce(asked, F.lit(0).cast("long"))))


def stall_delay(stalls: Column, deadline: Column) -> Column:
    """Two thirds of the deadline, doubled by stall, 120 s at most."""
    return F.least(deadline * 2 / 3 * F.pow(F.lit(2), stalls), F.lit(120.0))


def asset_kind(hint: Column, mime: Column, url_path: Column) -> Column:
    """style, font, image or other: from the hint, the MIME type, then the
    extension."""
    ext = F.lower(F.regexp_extract(url_path, r"\.([^./]*)$", 1))
    plain = F.lower(F.trim(F.regexp_extract(mime, "^([^;]*)", 1)))
    return (
        F.when(hint != "", hint)
        .when(plain == "text/css", "style")
        .when(plain.startswith("font/") | plain.rlike("^application/(font|x-font|vnd.ms-fontobject)"), "font")
        .when(plain.startswith("image/"), "image")
        .when(ext == "css", "style")
        .when(ext.isin("woff", "woff2", "ttf", "otf", "eot"), "font")
        .when(ext.isin("png", "jpg", "jpeg", "gif", "webp", "bmp", "svg"), "image")
        .otherwise("other")
    )


def library_status(statuses: Column) -> Column:
    """The worst of a library's states: incomplete, degraded, complete."""
    return F.when(F.array_contains(statuses, "incomplete"), "incomplete").when(F.array_contains(statuses, "degraded"), "degraded").otherwise("complete")
