"""Deterministic checks: hosts, paths and address ranges."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://([^/:]+)", 1))


def denied_hosts(urls: DataFrame, url: str, allowed: list[str]) -> DataFrame:
    """Hosts outside the allow-list and how often they occur; an empty list is off."""
    hosts = urls.select(host_of(F.col(url)).alias("host")).where("host <> ''")
    if not allowed:
        return hosts.where("false").groupBy("host").agg(F.count("*").alias("n"))
    return hosts.where(~F.col("host").isin(allowed)).groupBy("host").agg(F.count("*").alias("n"))


def under_path(path: Column, blocked: list[str]) -> Column:
    """Whether a path equals a blocked one or lies below it (whole components)."""
    return reduce(or_, [(path == b) | F.startswith(path, F.lit(b.rstrip("/") + "/")) for b in blocked], F.lit(False))


def ipv4_number(ip: Column) -> Column:
    """Dotted address as a number."""
    parts = F.split(ip, r"\.")
    return reduce(lambda a, i: a * 256 + F.try_element_at(parts, F.lit(i)).cast("long"), range(1, 5), F.lit(0).cast("long"))


def aligned_blocks(lo: Column, hi: Column, bits: int = 32) -> Column:
    """The numbers from ``lo`` to ``hi`` as an array of (size, block): all numbers that are ``block`` once shifted right by
    ``size`` bits. At most two blocks of each size are needed; an empty range has none.
    """
    def both(k: Column) -> Column:
        first, stop = F.call_function("shiftright", lo + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k), F.call_function("shiftright", hi + 1, k)
        block = lambda n: F.struct(k.cast("int").alias("size"), n.alias("block"))
        return F.array_compact(F.array(F.when((first < stop) & (first % 2 == 1), block(first)), F.when((first < stop) & (stop % 2 == 1), block(stop - 1))))

    # a block that is both the first and the last of its size counts once
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(bits)), both)))


def in_ranges(numbers: DataFrame, ranges: DataFrame, bits: int = 32) -> DataFrame:
    """Distinct (vendor, number) of ``numbers`` that lie in a range (vendor, lo, hi) of their vendor, ends included.

    Ranges are cut into aligned blocks, and a number has one block of each size in use (``bits`` + 1 at most), so an
    equi-join finds them: overlapping and nested ranges cost no more than others, and a vendor's numbers are spread by their blocks.
    """
    blocks = ranges.select("vendor", F.explode(aligned_blocks(F.col("lo"), F.col("hi"), bits)).alias("b")).select("vendor", "b.*").distinct()
    sizes = sorted(r["size"] for r in blocks.select("size").distinct().collect())
    keys = [F.struct(F.lit(k).alias("size"), F.shiftright("number", k).alias("block")) for k in sizes]
    keyed = numbers.select("vendor", "number", F.explode(F.array(*keys)).alias("b")) if keys else numbers.select("vendor", "number", F.struct(F.lit(0).alias("size"), F.col("number").alias("block")).alias("b"))
    return keyed.select("vendor", "number", "b.*").join(blocks, ["vendor", "size", "block"], "left_semi").select("vendor", "number").distinct()


def verify_ranges(claims: DataFrame, ranges: DataFrame) -> DataFrame:
    """Per vendor: claims whose address lies in one of its ranges, and those outside.

    ``claims`` (vendor, ip), ``ranges`` (vendor, lo, hi) as numbers; equal claims are counted before they meet ranges.
    """
    numbered = claims.select("vendor", ipv4_number(F.col("ip")).alias("number")).groupBy("vendor", "number").agg(F.count("*").alias("n"))
    inside = in_ranges(numbered.where("number is not null"), ranges.select("vendor", "lo", "hi")).withColumn("ok", F.lit(True))
    joined = numbered.join(inside, ["vendor", "number"], "left")
    return joined.groupBy("vendor").agg(F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("verified"), F.sum(F.when(F.col("ok"), 0).otherwise(F.col("n"))).alias("fake"))


class PolicyError(ValueError):
    """A policy or pins file that cannot be taken at its word."""


#: Lists that a policy may hold.
POLICY_KEYS = ("allowed_hosts", "blocked_paths")
_ITEM, _KEY = re.compile(r"\s*- (.*)"), re.compile(r"(\S[^:]*):(.*)")


def parse_policy(text: str | None) -> dict[str, list[str]]:
    """Lists of a policy: lines ``key:``, each followed by lines ``  - value``; ``#`` begins a comment.

    Anything else is an error, as an ignored line would look like protection: unknown keys, values
    behind a key, items before the first key, indented lines and lines without a colon.
    """
    lists: dict[str, list[str]] = {}
    key = None

    def error(what: str) -> PolicyError:
        return PolicyError(f"line {number}: {what}")

    for number, line in enumerate((text or "").splitlines(), 1):
        line = line.partition("#")[0].rstrip()
        if not line:
            continue
        if item := _ITEM.fullmatch(line):
            if key is None:
                raise error("a list item outside any key")
            lists[key].append(item.group(1).strip())
        elif line[0].isspace():
            raise error("unexpected indentation")
        elif not (found := _KEY.fullmatch(line)):
            raise error("neither a key with a colon nor a list item")
        elif (name := found.group(1).strip()) not in POLICY_KEYS:
            raise error(f"unknown key {name!r}; there are {', '.join(POLICY_KEYS)}")
        elif found.group(2).strip():
            raise error(f"{name!r} takes a list, one item a line")
        else:
            key, lists[name] = name, []
    return lists


#: Paths that a starter policy blocks. Private keys stand one by one, so that public keys beside them stay usable.
STARTER_PATHS = [
    "~/.ssh/id_rsa", "~/.ssh/id_ed25519", "~/.ssh/id_ecdsa", "~/.ssh/id_dsa", "~/.aws", "~/.config/gcloud",
    "~/.kube/config", "~/.docker/config.json", "~/.netrc", "~/.npmrc", "~/.pypirc",
]


def starter_policy(enabled: bool = True) -> str:
    """Text of a policy for a start, as parse_policy reads it: the starter paths blocked or, unless ``enabled``, as comments that block nothing."""
    rules = ["blocked_paths:", *(f"  - {path}" for path in STARTER_PATHS)]
    return "\n".join([
        "# Calls that touch one of the blocked paths are denied; a path covers what lies below it, not names that only begin like it.",
        *([] if enabled else ["# Nothing is blocked yet: take the signs away from the lines below."]), *(r if enabled else f"# {r}" for r in rules), "",
        "# With a list of allowed hosts, calls to all others are denied.", "# allowed_hosts:", "#   - pypi.org", "",
    ])


def write_starter_policy(path: str, enabled: bool = True) -> bool:
    """Write the starter policy to a file (a local path or one that Arrow reaches) unless a user's policy is there; whether it was written.

    The one file that is replaced is an untouched starter that blocks nothing.
    """
    system, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    if system.get_file_info(place).type != fs.FileType.NotFound:
        with system.open_input_stream(place) as old:
            if not enabled or old.read().decode("utf-8", "replace") != starter_policy(False):
                return False
    with system.open_output_stream(place) as out:
        out.write(starter_policy(enabled).encode())
    return True


def default_policy() -> dict[str, list[str]]:
    """The lists of a policy, all empty: nothing is blocked until a user writes it."""
    return {key: [] for key in POLICY_KEYS}
