"""URL builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette import fixed
from gazette.functions.text import trimmed


def host(url: Column) -> Column:
    """Lower-case authority (port and user kept), without one leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def handle(url: Column) -> Column:
    """First path segment in lower case, without leading @; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/+@*([^/?#]+)", 1))


def source_keys(url: Column) -> tuple[Column, Column]:
    """The keys under which a link's source is looked up: the publication handle, if its host has such, and the host."""
    return F.when(host(url) == fixed.HANDLE_HOST, F.nullif(handle(url), F.lit(""))), host(url)


def is_safe_url(url: Column) -> Column:
    """Whether the scheme is one that may be linked; relative and odd URLs are not."""
    scheme = F.lower(F.regexp_extract(trimmed(url), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.coalesce(scheme.isin(*fixed.SAFE_SCHEMES), F.lit(False))
