"""Addresses of network shares: checking, canonical form, mount tables."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


class AddressError(ValueError):
    """reason: invalid, scheme or credentials. The message never repeats the input."""

    def __init__(self, reason: str):
        super().__init__(f"share address: {reason}")
        self.reason = reason


def _host(host: str) -> bool:
    if ":" in host:
        address, percent, zone = host.partition("%")
        if percent and not re.fullmatch(r"[\w.-]+", zone):
            return False
        try:
            ipaddress.IPv6Address(address)
        except ValueError:
            return False
        return True
    if len(host.encode()) > 253 or not re.fullmatch(r"[\w.-]+", host):
        return False
    if re.fullmatch(r"[\d.]+", host):
        try:
            ipaddress.IPv4Address(host)
        except ValueError:
            return False
        return True
    labels = host.removesuffix(".").split(".")
    return all(x and len(x.encode()) <= 63 and x[0] != "-" and x[-1] != "-" for x in labels)


def canonical(text: str) -> str:
    """smb://host/path with a lower-case host; plain host/path is taken as such a share."""
    text = text.strip()
    if not text or "\\" in text or re.search(r"[\x00-\x1f\x7f-\x9f]", text) or re.search(r"%(?![0-9A-Fa-f]{2})", text):
        raise AddressError("invalid")
    scheme, mark, rest = text.partition("://")
    if mark:
        if scheme.lower() != "smb":
            raise AddressError("scheme")
    elif text.startswith("/") or text.lower().startswith("smb:"):
        raise AddressError("invalid")
    else:
        rest = text
        authority, slash, path = rest.partition("/")
        if authority.count(":") >= 2 and not authority.startswith("["):
            rest = f"[{authority}]{slash}{path}"
    authority, slash, path = rest.partition("/")
    if "@" in authority:
        raise AddressError("credentials")
    if "?" in rest or "#" in rest:
        raise AddressError("invalid")
    m = re.fullmatch(r"(\[[^\]]+\]|[^:\[\]]+)(?::(\d*))?", authority)
    if not m or m[2] and not 1 <= int(m[2]) <= 65535:
        raise AddressError("invalid")
    host = unquote(m[1].strip("[]"))
    if not _host(host) or any(p in (".", "..") for p in unquote(path).split("/")) or "\\" in unquote(path) or re.search(r"[\x00-\x1f]", unquote(path)):
        raise AddressError("invalid")
    shown = f"[{host}]" if ":" in host else host.lower()
    return f"smb://{shown}{':' + m[2] if m[2] else ''}{slash}{quote(unquote(path), safe='/!$&()*+,;=:@~-._')}"


@F.pandas_udf(T.StringType())
def canonical_share(text: pd.Series) -> pd.Series:
    """canonical(), null for addresses that it refuses."""

    def one(x):
        try:
            return None if x is None else canonical(x)
        except AddressError:
            return None

    return text.map(one)


def mounted_shares(mounts):
    """Distinct SMB shares of a mount table (fs, source, path), without credentials, in natural order of names.

    The source of a mount is //user@host/share.
    """
    host = F.regexp_extract("source", r"^//(?:[^@/]*@)?([^/]+)/", 1)
    share = F.regexp_extract("source", r"^//[^/]+/(.+)$", 1)
    found = mounts.filter((F.lower("fs") == "smbfs") & (host != "") & (share != "")).select(F.concat(F.lit("smb://"), F.lower(host), F.lit("/"), share).alias("url"), "path", F.element_at(F.split("path", "/"), -1).alias("name"))
    natural = F.regexp_replace(F.lower("name"), r"(\d+)", "0000000000$1")
    natural = F.regexp_replace(natural, r"0*(\d{10})(?!\d)", "$1")
    return found.dropDuplicates(["path"]).orderBy(natural, "path")
