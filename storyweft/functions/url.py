"""URL canonical form, and labels made from hosts."""

from __future__ import annotations

from urllib.parse import parse_qsl, quote, quote_plus, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tracking parameters that are dropped, besides those that start with utm_.
TRACKING = ["fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src"]
PATTERN = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(x: Column, group: int) -> Column:
    return F.regexp_extract(F.trim(x), PATTERN, group)


def url_host(x: Column) -> Column:
    """Host in lower case, without port and user; empty if the URL has no scheme or host."""
    return F.lower(F.regexp_replace(F.regexp_replace(_part(x, 2), r"^.*@", ""), r":\d*$", ""))


def canonical_url(x: Column) -> Column:
    """For http(s) URLs whose path and query need no escapes: lower-case host without default port, no fragment, `//`
    once in the path made one, no final slash, tracking parameters dropped, the rest in order. Else empty."""
    scheme, path, query = F.lower(_part(x, 1)), _part(x, 3), _part(x, 4)
    authority = _part(x, 2)
    user = F.regexp_extract(authority, r"^(.*@)", 1)
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    host = F.concat(user, url_host(x), F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), port)))
    path = F.regexp_replace(path, "//", "/")
    path = F.when(path == "", F.lit("")).when(path == "/", path).otherwise(F.regexp_replace(path, "/$", ""))
    key = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~key(p).startswith("utm_") & ~key(p).isin(TRACKING))
    kept = F.transform(kept, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))
    # Key and value apart, so that order is by key, then by value.
    pairs = F.array_sort(F.transform(kept, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), p.alias("p"))))
    joined = F.array_join(F.transform(pairs, lambda s: s["p"]), "&")
    url = F.concat(scheme, F.lit("://"), host, path, F.when(joined == "", F.lit("")).otherwise(F.concat(F.lit("?"), joined)))
    return F.when(url_host(x) == "", F.lit("")).otherwise(url)


def canonical_of(raw: str | None) -> tuple[str, str]:
    """(canonical form, host) with escapes: what the column form does not cover."""
    try:
        parts = urlsplit((raw or "").strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return "", ""
    if not parts.scheme or not host:
        return "", ""
    scheme = parts.scheme.lower()
    user = parts.netloc.rpartition("@")[0]
    at = f"{user}@{host}" if user else host
    if port and (scheme, port) not in (("http", 80), ("https", 443)):
        at += f":{port}"
    path = parts.path.replace("//", "/")
    if len(path) > 1 and path.endswith("/"):
        path = path[:-1]
    path = quote(path, safe="/:@!$&'()*+,;=~-._")  # an escape in the path is escaped once more
    kept: dict[str, list[str]] = {}
    for k, v in parse_qsl(parts.query, keep_blank_values=True):
        if not k.lower().startswith("utm_") and k.lower() not in TRACKING:
            kept.setdefault(k, []).append(v)
    query = "&".join(f"{quote_plus(k)}={quote_plus(v)}" for k in sorted(kept) for v in sorted(kept[k]))
    return f"{scheme}://{at}{path}{'?' + query if query else ''}", host


@F.pandas_udf(T.StructType([T.StructField("canonical", T.StringType()), T.StructField("host", T.StringType())]))
def canonical_url_any(urls: pd.Series) -> pd.DataFrame:
    """Full form for any URL, escapes included."""
    return pd.DataFrame([canonical_of(u) for u in urls], columns=["canonical", "host"])


def source_label(url: Column, others: Column) -> Column:
    """`example.com`, `example.com and 1 other`, `example.com and 3 others`."""
    host = F.regexp_replace(url_host(url), r"^www\.", "")
    more = F.when(others <= 0, F.lit("")).when(others == 1, F.lit(" and 1 other")).otherwise(F.concat(F.lit(" and "), others.cast("string"), F.lit(" others")))
    return F.when(host == "", F.lit("unknown")).otherwise(F.concat(host, more))


__all__ = ["canonical_of", "canonical_url", "canonical_url_any", "source_label", "url_host"]
