"""String column functions. [X1-X16]"""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EDGE = r"^[\s\u00a0\u1680\u2000-\u200b\u202f\u205f\u3000\ufeff]+|[\s\u00a0\u1680\u2000-\u200b\u202f\u205f\u3000\ufeff]+$"


def clean(c: Column) -> Column:
    """Trim all white space; empty becomes null. [X1]"""
    t = F.regexp_replace(c, _EDGE, "")
    return F.when(t != "", t)


def collapse(c: Column) -> Column:
    """Runs of white space become one space, edges are trimmed; empty becomes null."""
    return clean(F.regexp_replace(c, r"[\s\u00a0]+", " "))


@F.arrow_udf(T.StringType())
def unescape(c: pa.Array) -> pa.Array:
    """Entities of HTML decoded, twice-encoded ones fully. [X3]"""
    out = []
    for x in c:
        t = x.as_py()
        while t is not None and "&" in t and (u := html.unescape(t)) != t:
            t = u
        out.append(t)
    return pa.array(out, pa.string())


def strip_tags(c: Column) -> Column:
    """Tags become spaces, entities are decoded, white space collapses. [X2]

    The entity decoder gets null for texts without an ampersand, so it works on few.
    """
    t = F.regexp_replace(c, r"<[^>]*>", " ")
    return collapse(F.coalesce(unescape(F.when(F.contains(t, F.lit("&")), t)), t))


def shorten(c: Column, n: int = 400) -> Column:
    """At most n characters, cut at the right edge and marked with three dots. [X4]"""
    t = collapse(c)
    return F.when(F.length(t) > n, F.concat(F.rtrim(F.substring(t, 1, n)), F.lit("..."))).otherwise(t)


def url_segment(c: Column) -> Column:
    """Last non-empty path segment, percent-decoded; a plus stays a plus. [X5]"""
    path = F.rtrim(F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), r"^[a-zA-Z][\w+.\-]*://[^/]*", ""), F.lit("/"))
    seg = F.element_at(F.split(path, "/"), -1)
    return F.when(seg != "", F.try_url_decode(F.replace(seg, F.lit("+"), F.lit("%2B"))))


def breadcrumb(*parts: Column, sep: str = " > ") -> Column:
    """Non-empty parts joined; null when there is none. [X6]"""
    t = F.concat_ws(sep, *[clean(p) for p in parts])
    return F.when(t != "", t)


def last_part(c: Column, sep: str = ">") -> Column:
    """Last part of a breadcrumb, lower case. [X7]"""
    return F.lower(clean(F.element_at(F.split(c, sep), -1)))


def after_dash(c: Column) -> Column:
    """What follows the first ' - '; null without one. [X8]"""
    t = F.regexp_extract(c, r"^.*? - (.*)$", 1)
    return F.when(t != "", t)


def zfill(c: Column, n: int) -> Column:
    """Zeros to the left up to n; longer texts stay whole. [X9]"""
    return F.when(F.length(c) < n, F.lpad(c, n, "0")).otherwise(c)


def first_of(c: Column, sep: str = "_") -> Column:
    """Text before the first separator. [X10]"""
    return F.substring_index(c, sep, 1)


def parts_of(c: Column, sep: str = "-") -> Column:
    """Non-empty trimmed parts as an array. [X10]"""
    return F.filter(F.transform(F.split(c, sep), lambda x: F.trim(x)), lambda x: x != "")


def search_terms(*parts: Column) -> Column:
    """Non-empty parts joined by spaces, leading hash signs dropped. [X11]"""
    return F.concat_ws(" ", *[clean(F.regexp_replace(p, r"^#+", "")) for p in parts])


def content_id(c: Column, n: int = 16) -> Column:
    """First n hex digits of SHA-256. [X12]"""
    return F.substring(F.sha2(c, 256), 1, n)


def prefixed(prefix: str, c: Column) -> Column:
    """source:id; null ids stay null. [X13]"""
    return F.concat(F.lit(f"{prefix}:"), c)


def is_blank(c: Column) -> Column:
    """Null or nothing but white space. [X14]"""
    return F.coalesce(~c.rlike(r"[^\s\u00a0]"), F.lit(True))


def is_true(c: Column) -> Column:
    """'true' in any case. [X15]"""
    return F.lower(F.trim(c)) == "true"


def bucket_and_key(c: Column) -> Column:
    """scheme://bucket/key -> struct(bucket, key). [X16]"""
    return F.struct(F.regexp_extract(c, r"^\w+://([^/]+)", 1).alias("bucket"), F.regexp_extract(c, r"^\w+://[^/]+/?(.*)$", 1).alias("key"))
