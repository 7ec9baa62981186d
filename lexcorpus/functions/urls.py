"""Addresses and hosts in built-in expressions; what can't be read gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IPv4 ranges that are not public (fixed value).
PRIVATE_IPV4 = r"^(0\.|10\.|127\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.168\.|100\.(6[4-9]|[7-9][0-9]|1[0-2][0-9])\.|198\.1[89]\.)"
#: IPv6 ranges that are not public (fixed value).
PRIVATE_IPV6 = r"^(::1?$|fc|fd|fe80|ff)"
REDIRECTS = [301, 302, 303, 307, 308]


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def host(url: Column) -> Column:
    return F.lower(_some(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)))


def origin(url: Column) -> Column:
    """scheme://authority in lower case, or the address itself where it has none."""
    return F.coalesce(F.lower(_some(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1))), url)


def law_id(url: Column) -> Column:
    """The number of an act in an address: the query's lawId, else the path behind /detail/ or /details/."""
    return F.coalesce(_some(F.regexp_extract(url, r"(?i)[?&]lawid=([^&#]+)", 1)), _some(F.regexp_extract(url, r"/details?/([0-9]+)", 1)))


def canonical(url: Column, base: str) -> Column:
    """The address of an act under ``base`` where its number is known, else the address without query and fragment."""
    return F.coalesce(F.concat(F.lit(f"{base}/mn/detail?lawId="), law_id(url)), F.regexp_replace(url, r"[?#].*$", ""))


def allowed(url: Column, hosts: list[str], suffixes: list[str] = ()) -> Column:
    """https, no credentials, and a host of the list or under one of the suffixes."""
    h = host(url)
    inside = h.isin(list(hosts))
    for s in suffixes:
        inside = inside | h.endswith(s)
    return F.coalesce(F.rlike(url, F.lit(r"(?i)^https://[^/?#@]+(?:[/?#]|$)")) & inside, F.lit(False))


def private_ip(address: Column) -> Column:
    """Whether an IP address is private or reserved; mapped IPv4 counts as IPv4."""
    ip = F.lower(F.trim(address))
    four = F.regexp_replace(ip, r"^::ffff:([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$", "$1")
    return F.when(F.contains(four, F.lit(":")), F.rlike(four, F.lit(PRIVATE_IPV6))).otherwise(F.rlike(four, F.lit(PRIVATE_IPV4)))


def redirect_allowed(status: Column, source: Column, target: Column, hops: Column, most: int = 5) -> Column:
    """A redirect status, few hops, and the same host or a host under it."""
    a, b = host(source), host(target)
    return F.coalesce(status.isin(REDIRECTS) & (hops <= most) & ((a == b) | b.endswith(F.concat(F.lit("."), a))), F.lit(False))


def backoff_ms(attempt: Column) -> Column:
    """Waiting time before try ``attempt`` (from 1): doubling from half a second, 16 seconds at most."""
    return F.least(F.lit(16000).cast("bigint"), (F.lit(500) * F.pow(F.lit(2.0), F.least(attempt, F.lit(20)) - 1)).cast("bigint"))
