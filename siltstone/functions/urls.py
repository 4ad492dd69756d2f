"""Canonical addresses."""

from __future__ import annotations

import posixpath
import re
from urllib.parse import parse_qsl, quote_plus, unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ESCAPE = re.compile(r"%([0-9a-fA-F]{2})")
_PLAIN = re.compile(r"[A-Za-z0-9._~-]")
_PORTS = {"http": "80", "https": "443"}


def _escape(m: re.Match) -> str:
    ch = chr(int(m.group(1), 16))
    return ch if _PLAIN.match(ch) else m.group().upper()


def _clean(path: str) -> str:
    """Dot segments resolved and slashes united; an ending slash stays."""
    if not path:
        return path
    out = re.sub(r"^/{2,}", "/", posixpath.normpath(path))
    return out + "/" if len(path) > 1 and path.endswith("/") and not out.endswith("/") else out


def canonical(url: str | None) -> str | None:
    """The canonical form; null for null and for what isn't an address.

    Scheme and host in lower case, no default port and no fragment; escapes of
    unreserved characters decoded, others in upper case; dot segments resolved;
    parameters sorted by name.  IPv6 hosts keep their brackets.
    """
    if url is None or re.search(r"%(?![0-9a-fA-F]{2})", url.partition("?")[0]):
        return None
    try:
        u = urlsplit(url)
        port = str(u.port) if u.port is not None else ""
    except ValueError:
        return None
    scheme, host = u.scheme.lower(), (u.hostname or "").lower()
    host = f"[{host}]" if ":" in host else host
    host += f":{port}" if port and _PORTS.get(scheme) != port else ""
    user = u.netloc.rpartition("@")[0]
    path = _clean(_ESCAPE.sub(_escape, u.path))
    pairs = sorted(parse_qsl(u.query, keep_blank_values=True), key=lambda kv: kv[0])
    query = "&".join(f"{quote_plus(k, safe='-_.~')}={quote_plus(v, safe='-_.~')}" for k, v in pairs)
    return (f"{scheme}:" if scheme else "") + (f"//{user + '@' if user else ''}{host}" if u.netloc else "") + path + (f"?{query}" if query else "")


@F.pandas_udf(T.StringType())
def canonical_url(url: pd.Series) -> pd.Series:
    return url.map(canonical)


@F.pandas_udf(T.StringType())
def resolved(base: pd.Series, link: pd.Series) -> pd.Series:
    """A link as seen from a page, such as a redirect's target."""
    return pd.Series([None if a is None or b is None else urljoin(a, b) for a, b in zip(base, link)])


def canonical_simple(url: Column) -> Column:
    """The canonical form of addresses without escapes or dot segments, JVM-side."""
    scheme, host = F.lower(F.parse_url(url, F.lit("PROTOCOL"))), F.lower(F.parse_url(url, F.lit("HOST")))
    port = F.regexp_extract(F.parse_url(url, F.lit("AUTHORITY")), r":([0-9]+)$", 1)
    default = F.when(scheme == "http", F.lit("80")).when(scheme == "https", F.lit("443"))
    query = F.parse_url(url, F.lit("QUERY"))
    sorted_query = F.array_join(F.transform(F.array_sort(F.transform(F.split(query, "&"), lambda p: F.struct(F.regexp_extract(p, "^([^=]*)", 1).alias("k"), p.alias("p")))), lambda s: s["p"]), "&")
    return F.concat(
        scheme,
        F.lit("://"),
        host,
        F.when((port != "") & (port != default), F.concat(F.lit(":"), port)).otherwise(""),
        F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")),
        F.when(query.isNotNull() & (query != ""), F.concat(F.lit("?"), sorted_query)).otherwise(""),
    )


def decoded_path(path: str) -> str:
    return unquote(path)
