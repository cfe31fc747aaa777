"""K1, K4-K6: URL keys and URI parts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Schemes fetched remotely, and the URI grammar pieces used to read them.
REMOTE_SCHEMES = ("http", "https", "s3")
SCHEME_PATTERN = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
NETLOC_PATTERN = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
PATH_PATTERN = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"
EXTENSION_PATTERN = r"^\.*[^.].*(\.[^.]*)$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def url_key(url, etag=None) -> Column:
    """K1: ``sha256(url)`` in hex, plus ``.`` and ``sha256(etag)`` when the etag is not empty."""
    key = F.sha2(_col(url), 256)
    if etag is None:
        return key
    e = _col(etag)
    return F.when(e.isNull() | (e == ""), key).otherwise(F.concat(key, F.lit("."), F.sha2(e, 256)))


def uri_scheme(uri) -> Column:
    """The scheme, lower case, or '' when there is none."""
    return F.lower(F.regexp_extract(_col(uri), SCHEME_PATTERN, 1))


def route_uri(uri) -> Column:
    """K4: ``remote`` for http / https / s3, ``local`` without a scheme, else ``error``."""
    s = uri_scheme(uri)
    return F.when(s.isin(*REMOTE_SCHEMES), F.lit("remote")).when(s == "", F.lit("local")).otherwise(F.lit("error"))


def object_bucket(uri) -> Column:
    """K5: the host part (network location)."""
    return F.regexp_extract(_col(uri), NETLOC_PATTERN, 1)


def object_key(uri) -> Column:
    """K5: the path without one leading ``/`` (query and fragment excluded)."""
    return F.regexp_replace(F.regexp_extract(_col(uri), PATH_PATTERN, 1), "^/", "")


def object_path_valid(uri) -> Column:
    """K5: a split is an error when the bucket or the path is empty."""
    return (object_bucket(uri) != "") & (F.regexp_extract(_col(uri), PATH_PATTERN, 1) != "")


def file_extension(path, dot: bool = True, lower: bool = True) -> Column:
    """K6: the last extension of the last path segment; names that only start with a dot have none."""
    base = F.regexp_extract(_col(path), r"[^/]*$", 0)
    ext = F.regexp_extract(base, EXTENSION_PATTERN, 1)
    if not dot:
        ext = F.regexp_replace(ext, r"^\.", "")
    return F.lower(ext) if lower else ext
