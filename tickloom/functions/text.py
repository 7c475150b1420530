"""Text functions of captions, markup and identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.exact import floor_div


def xml_escape(c: Column) -> Column:
    """The five characters that markup reserves."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def cue_time(ms: Column) -> Column:
    """HH:MM:SS.mmm"""
    s = floor_div(ms, 1000)
    return F.format_string("%02d:%02d:%02d.%03d", floor_div(s, 3600), floor_div(s, 60) % 60, s % 60, (ms % 1000).cast("bigint"))


def url_identity(c: Column) -> Column:
    """Scheme, lower-case host and path: two URLs that differ in query or fragment name one object."""
    return F.concat(F.lower(F.regexp_extract(c, "^([^:]+)://", 1)), F.lit("://"), F.lower(F.regexp_extract(c, "^[^:]+://([^/?#]*)", 1)), F.regexp_extract(c, "^[^:]+://[^/?#]*([^?#]*)", 1))
