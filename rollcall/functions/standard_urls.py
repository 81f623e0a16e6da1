"""URLs as browsers read them: the URL standard's parsing for http and https, relative links, and the form in which equal
pages are equal. A small parser for each row of an Arrow batch; urls.canonical() does plain ASCII forms without Python.
"""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple
from urllib.parse import parse_qsl, quote, quote_plus, unquote_to_bytes

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .urls import TRACKING

# What the standard leaves as it is in paths and in user info, host characters it forbids, default ports.
PATH_SAFE = "!$%&'()*+,-./:;=@[\\]_|~"
FORBIDDEN = re.compile(r"[\x00-\x20\x22#%/:<>?@\[\\\]^`{|}\x7f]")
PORTS = {"http": 80, "https": 443}
UNUSUAL = re.compile(r"^[\x00-\x20]+|[\x00-\x20]+$")


class Url(NamedTuple):
    scheme: str
    host: str
    port: int | None
    path: tuple[str, ...]
    query: str | None

    def text(self) -> str:
        at = "" if self.port is None else f":{self.port}"
        return f"{self.scheme}://{self.host}{at}/{'/'.join(self.path)}" + ("" if self.query is None else f"?{self.query}")


def _ipv4_part(part: str) -> int | None:
    base, digits = (16, part[2:]) if part[:2].lower() == "0x" else (8, part[1:]) if len(part) > 1 and part[0] == "0" else (10, part)
    if digits == "":
        return 0
    allowed = {8: "[0-7]+", 10: "[0-9]+", 16: "[0-9a-fA-F]+"}[base]
    return int(digits, base) if re.fullmatch(allowed, digits) else None


def _ipv4(host: str) -> str | None:
    """A host whose last label is a number, as four numbers; None if it is no such address."""
    parts = host.removesuffix(".").split(".")
    numbers = [_ipv4_part(p) if p else None for p in parts]
    if len(parts) > 4 or None in numbers or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(parts)):
        return None
    value = numbers[-1] + sum(n << 8 * (3 - k) for k, n in enumerate(numbers[:-1]))
    return str(ipaddress.IPv4Address(value))


def _label(label: str) -> str:
    return label if label.isascii() else "xn--" + label.encode("punycode").decode()


@lru_cache(10_000)
def host_of(raw: str) -> str | None:
    """A host in ASCII: decoded, mapped to lower case and compatible letters, labels in Punycode; None if it isn't one."""
    if raw.startswith("["):
        try:
            return f"[{ipaddress.IPv6Address(raw[1:-1]).compressed}]" if raw.endswith("]") and "%" not in raw else None
        except ValueError:
            return None
    try:
        own = unquote_to_bytes(raw).decode("utf-8")
    except UnicodeDecodeError:
        return None
    own = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", own).lower()).replace("\xad", "").replace("​", "").replace("。", ".")
    try:
        host = ".".join(map(_label, own.split(".")))
    except UnicodeError:
        return None
    if not host or FORBIDDEN.search(host) or any(len(x) > 63 and x.startswith("xn--") for x in host.split(".")):
        return None
    last = host.removesuffix(".").split(".")[-1]
    if last.isdigit() or re.fullmatch("0[xX][0-9a-fA-F]*", last):
        return _ipv4(host)
    return host


def _walked(parts: list[str], before: tuple[str, ...] = ()) -> tuple[str, ...]:
    """Path segments behind others, with . and .. (also as %2e) followed."""
    out = list(before)
    for k, part in enumerate(parts):
        dots = re.sub("(?i)%2e", ".", part)
        if dots == "..":
            out = out[:-1]
        if dots in (".", ".."):
            if k == len(parts) - 1:
                out.append("")
            continue
        out.append(quote(part, safe=PATH_SAFE))
    return tuple(out) or ("",)


def parsed(raw: str, base: Url | None = None) -> Url | None:
    """A URL of http or https, on its own or relative to a base; None for others and for what can't be read."""
    own = re.sub(r"[\t\n\r]", "", UNUSUAL.sub("", raw)).split("#", 1)[0]
    has = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", own)
    scheme = has[1].lower() if has else None
    if scheme is not None and scheme not in PORTS:
        return None
    rest = own[has.end() :] if has else own
    relative = scheme is None or (base is not None and scheme == base.scheme and not re.match(r"[/\\]{2}", rest))
    if relative and base is None:
        if scheme is None:
            return None
        relative = False
    before, mark, asked = rest.partition("?")
    query = quote(asked, safe="!$%&()*+,-./:;=?@[\\]^_`{|}~") if mark else None
    before = before.replace("\\", "/")
    if relative and not before.startswith("//"):
        if before == "":
            return base._replace(query=query if mark else base.query)
        if before.startswith("/"):
            return base._replace(path=_walked(before[1:].split("/")), query=query)
        return base._replace(path=_walked(before.split("/"), base.path[:-1]), query=query)
    scheme = scheme or base.scheme
    authority, _, path = before.lstrip("/").partition("/")
    place = authority.rsplit("@", 1)[-1]
    port_at = re.search(r":([0-9]*)$", place)
    if not port_at and re.search(r":[^\]]*$", place) and not place.startswith("["):
        return None
    host = host_of(place[: port_at.start()] if port_at else place)
    port = int(port_at[1]) if port_at and port_at[1] else None
    if host is None or (port is not None and port > 65535):
        return None
    return Url(scheme, host, None if port == PORTS[scheme] else port, _walked(path.split("/")), query)


def canonical(raw: str | None, base: str | None = None) -> str | None:
    """The form for comparison: no user info, fragment, default port, trailing dot or tracking parameters, parameters in
    stable order by name as forms write them, single slashes and none at the end of a path."""
    if raw is None:
        return None
    own = parsed(raw, parsed(base) if base else None)
    if own is None:
        return None
    asked = parse_qsl(own.query or "", keep_blank_values=True, encoding="utf-8", errors="replace")
    left = sorted((p for p in asked if p[0].lower() not in TRACKING), key=lambda p: p[0].encode("utf-16-be"))
    form = lambda x: quote_plus(x, safe="*").replace("~", "%7E")
    path = "/" + "/".join(own.path)
    path = re.sub("/{2,}", "/", path.rstrip("/") if len(path) > 1 else path) or "/"
    at = "" if own.port is None else f":{own.port}"
    return f"{own.scheme}://{own.host.removesuffix('.')}{at}{path}" + ("?" + "&".join(f"{form(k)}={form(v)}" for k, v in left) if left else "")


def canonical_of(spark: SparkSession, url: Column, base: Column | None = None) -> Column:
    """canonical() of a column, relative to another one where that is given."""
    ship(spark)

    @F.pandas_udf("string")
    def run(urls: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([canonical(u, b or None) for u, b in zip(urls, bases, strict=True)], dtype=object)

    return run(url, F.lit("") if base is None else F.coalesce(base, F.lit("")))


def resolved_of(spark: SparkSession, href: Column, base: Column) -> Column:
    """The canonical target of a link on a page; null for empty, mail, phone, script and fragment links."""
    own = F.trim(href)
    return canonical_of(spark, F.when((own != "") & ~own.rlike("(?i)^(?:mailto:|tel:|javascript:|#)"), own), base)
