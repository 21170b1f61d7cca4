"""Dotted versions and ages of releases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def version_key(version: Column) -> Column:
    """Struct (major, minor, patch) by which versions sort: the first three parts of ``1.2.3`` or ``v1.2.3.post4``'s dots.

    A version with fewer parts, or one of the three that is no whole number, counts as 0.0.0; so does null.
    """
    parts = F.split(F.regexp_replace(F.trim(F.coalesce(version, F.lit(""))), "^v+", ""), r"\.")
    number = lambda i: F.regexp_extract(F.trim(F.coalesce(F.get(parts, F.lit(i)), F.lit(""))), r"^[+-]?[0-9]{1,18}$", 0)
    readable = (number(0) != "") & (number(1) != "") & (number(2) != "")
    return F.struct(*[F.when(readable, number(i).try_cast("bigint")).otherwise(F.lit(0).cast("bigint")).alias(n) for i, n in enumerate(("major", "minor", "patch"))])


def newer(latest: Column, local: Column) -> Column:
    """Whether ``latest`` is a later version than ``local``."""
    return version_key(latest) > version_key(local)


def days_since(released: Column, now: Column) -> Column:
    """Whole days from an ISO date or time to ``now`` (a timestamp), rounded down; a time without a zone is UTC, text that is no time gives null."""
    text = F.regexp_replace(F.trim(released), r"([T ][0-9]{2}:[0-9]{2})(?=Z|[+-]|$)", "$1:00")
    zoned = F.rlike(text, F.lit(r"[0-9](?:Z|[+-][0-9]{2}:?[0-9]{2})$")) & F.rlike(text, F.lit("[T ]"))
    whole = F.when(F.rlike(text, F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")), F.concat(text, F.lit("T00:00:00Z"))).when(zoned, text).otherwise(F.concat(text, F.lit("Z")))
    readable = F.rlike(text, F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,6})?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?$"))
    return F.when(readable, F.floor((F.unix_micros(now) - F.unix_micros(whole.try_cast("timestamp"))) / F.lit(86_400_000_000)))
