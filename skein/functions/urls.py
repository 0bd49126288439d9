"""URL keys.  Four of them exist on purpose; they differ in case, slash and www."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes under which a registrable domain has three labels.
THREE_LABEL_SUFFIXES = [
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "net.uk", "sch.uk",
    "com.au", "net.au", "org.au", "edu.au", "gov.au",
    "co.in", "net.in", "org.in", "gen.in", "firm.in", "ind.in",
    "co.jp", "or.jp", "ne.jp", "ac.jp", "go.jp",
    "co.nz", "net.nz", "org.nz", "govt.nz", "co.za", "org.za",
    "com.br", "net.br", "org.br",
    "com.cn", "com.tw", "com.sg", "com.hk", "com.my", "com.tr", "co.kr", "or.kr",
]


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, host without www., path at least /, no fragment."""
    u = F.trim(url)
    head = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*://)", 1))
    rest = F.regexp_replace(F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"(?s)#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^www\.", "")
    tail = F.regexp_replace(rest, r"^[^/?]*", "")
    tail = F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail))
    return F.when(u == "", u).otherwise(F.concat(head, host, tail))


def host_of(url: Column) -> Column:
    """Host in lower case, without user, port and www.; bare hosts are accepted."""
    u = F.regexp_replace(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.-]*:)?//", "")
    host = F.lower(F.regexp_extract(u, r"^([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":.*$", "")
    return F.regexp_replace(host, r"^www\.", "")


def registered_domain(url: Column) -> Column:
    """The last two labels of the host, or three under a known double suffix."""
    labels = F.filter(F.split(host_of(url), r"\."), lambda x: x != "")
    n = F.size(labels)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), ".")
    return F.coalesce(F.when((n > 2) & last(2).isin(THREE_LABEL_SUFFIXES), last(3)).otherwise(last(2)), F.lit(""))


def claim_url_key(url: Column) -> Column:
    """normalize_url without trailing slashes: the key between claims and sources."""
    return F.regexp_replace(normalize_url(url), r"/+$", "")


def gate_url_key(url: Column) -> Column:
    """Trimmed, without trailing slashes, all in lower case."""
    return F.lower(F.regexp_replace(F.trim(url), r"/+$", ""))


def verifier_url_key(url: Column) -> Column:
    """Without scheme, www., fragment and trailing slashes, in lower case."""
    u = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://", "")
    u = F.regexp_replace(F.regexp_replace(u, r"^www\.", ""), r"(?s)#.*$", "")
    return F.regexp_replace(u, r"/+$", "")


def allowed_url(url: Column, hosts: list[str]) -> Column:
    """https and a host of the list."""
    return F.coalesce(F.lower(F.trim(url)).startswith("https://") & F.parse_url(url, F.lit("HOST")).isin(hosts), F.lit(False))


def url_date(url: Column, now: Column) -> Column:
    """The date of a /YYYY/MM/DD/ path, unless invalid or after now."""
    found = F.regexp_extract(url, r"^[^?#]*?/((?:19|20)\d{2}/\d{1,2}/\d{1,2})(?:/|$)", 1)
    day = F.try_to_date(found, "yyyy/M/d") if hasattr(F, "try_to_date") else F.expr("NULL")
    return F.when((found != "") & (day <= F.to_date(now)), day)
