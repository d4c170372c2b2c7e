"""Checks of addresses: which hosts may be fetched, which e-mail addresses can be right."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType


def blocked_ip(ip: ipaddress.IPv4Address | ipaddress.IPv6Address) -> bool:
    return ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified


def blocked_host(host: str | None) -> bool:
    """Literal addresses of private, local and reserved networks, also as one number or in octal or hex parts; names of the local host; no host."""
    host = (host or "").strip("[]").rstrip(".").lower()
    if not host or host == "localhost" or host.endswith(".localhost"):
        return True
    try:
        return blocked_ip(ipaddress.ip_address(host.split("%")[0]))
    except ValueError:
        pass
    parts = host.split(".")
    if len(parts) > 4 or not all(re.fullmatch(r"0x[0-9a-f]*|\d+", p) for p in parts):
        return False
    try:
        numbers = [int(p, 16) if p.startswith("0x") else int(p, 8) if p.startswith("0") and len(p) > 1 else int(p) for p in parts]
        value = sum(n << 8 * (3 - k) for k, n in enumerate(numbers[:-1])) + numbers[-1]
        return blocked_ip(ipaddress.IPv4Address(value))
    except ValueError:
        return True


def may_fetch(url: str | None) -> bool:
    try:
        parts = urlsplit(url or "")
        return parts.scheme in ("http", "https") and not blocked_host(parts.hostname)
    except ValueError:
        return False


#: A dot-atom local part, and a domain of two labels or more, letters of any script; no quoted parts, no literals.
_LOCAL = re.compile(r"[\w!#$%&'*+/=?^`{|}~-]+(\.[\w!#$%&'*+/=?^`{|}~-]+)*", re.U)
_LABEL = re.compile(r"(?!-)[\w-]{1,63}(?<!-)", re.U)


def is_email(address: str | None) -> bool:
    """Whether an address is right in form; blanks at its ends don't count."""
    local, at, domain = (address or "").strip().rpartition("@")
    labels = domain.split(".")
    good = bool(at) and len(local) <= 64 and len(domain) <= 253 and len(labels) >= 2 and bool(_LOCAL.fullmatch(local))
    return good and all(_LABEL.fullmatch(x) and "_" not in x for x in labels) and not labels[-1].isdigit()


@F.pandas_udf(BooleanType())
def may_fetch_udf(url: pd.Series) -> pd.Series:
    return url.map(may_fetch)


@F.pandas_udf(BooleanType())
def is_email_udf(address: pd.Series) -> pd.Series:
    return address.map(is_email)
