"""SimHash near-duplicates with pigeonhole blocks.

A fingerprint has a bit set where more than half of a document's shingle hashes have it. Equal
fingerprints are collapsed first. To find fingerprints that differ in at most ``distance`` bits,
the 64 bits are cut into blocks; close ones agree on all but ``distance`` blocks, so each choice
of agreeing blocks is a table whose key joins them, and Hamming distance then verifies.

The number of blocks follows the number of distinct fingerprints, so that the expected chance
partners of one stay few at any size. Inside a key group only a spanning forest of the verified
links is written, never all pairs. A key that very many fingerprints share is split by blocks of its
other bits: close fingerprints agree on two of ``distance`` + 2 such blocks, so each choice of two is a
key again. Groups that are still above ``group_rows`` are cut into pieces that are
compared piece against piece, so no task holds an unbounded group.

Defined results: null, empty and blank texts have fingerprint zero and link like any other;
ties do not arise (a bit needs more than half); repeated rows share a component; ids that are
null take part, and a component of null ids only has component_id null; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII, checkpointed, fresh_name
from .graph import connected_components

BITS = 64
#: Rows of all tables that one Python group compares, about.
DEAL_ROWS = 150_000
#: Pieces of a key above which it is split by further blocks: those cost fewer rows than comparing all pairs of pieces.
MOST_PIECES = 16


def fingerprint(raw: bytes | None, shingle: int) -> int:
    """SimHash of UTF-8 text as a signed 64-bit integer."""
    words = raw.translate(LOWER_ASCII).split() if raw else []
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = np.array([digest(joined, 42)], ">u8")
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *(ends[: len(words) - shingle]).tolist()]
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], ">u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def simhash(text: Column, shingle: int = 4) -> Column:
    """Fingerprint column (long) of a text column."""

    @F.pandas_udf("long")
    def prints(raws: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(raw, shingle) for raw in raws], dtype="int64")

    return prints(text.cast("binary"))


def hex_of(fingerprint: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def block_masks(blocks: int, distance: int) -> list[int]:
    """For each choice of ``blocks - distance`` agreeing blocks, the mask of their bits."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(parts, blocks - distance)]


def inner_masks(mask: int, distance: int, agreeing: int = 2) -> list[int]:
    """``mask`` with each choice of ``agreeing`` of ``distance + agreeing`` blocks of the bits outside it."""
    free = [1 << i for i in range(BITS) if not mask >> i & 1]
    cuts = [len(free) * i // (distance + agreeing) for i in range(distance + agreeing + 1)]
    parts = [sum(free[a:b]) for a, b in zip(cuts, cuts[1:])]
    return [mask | sum(chosen) for chosen in combinations(parts, agreeing)]


def choose_blocks(fingerprints: int, distance: int, partners: float = 8.0) -> int:
    """Fewest blocks for which random fingerprints meet at most ``partners`` others over all tables."""
    for extra in range(1, 8):
        masks = block_masks(distance + extra, distance)
        if sum(fingerprints / 2.0 ** bin(m).count("1") for m in masks) <= partners:
            break
    return distance + extra


def forest(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Positions (root, member) of edges that span the components of the links among fingerprints."""
    n, seen, edges = len(prints), np.zeros(len(prints), bool), []
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        todo = [root]
        left = np.flatnonzero(~seen)
        while todo and len(left):
            at = todo.pop()
            close = np.bitwise_count(prints[left] ^ prints[at]) <= distance
            if close.any():
                found = left[close]
                seen[found] = True
                edges += [(root, x) for x in found.tolist()]
                todo += found.tolist()
                left = left[~close]
    return edges


def links(prints: DataFrame, distance: int = 4, group_rows: int = 4096, blocks: int | None = None, most_pieces: int = MOST_PIECES) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``fp`` of ``prints`` that connect all that are near.

    Where a key group is larger than ``group_rows`` it is cut into pieces, and each pair of pieces is
    compared in a group of its own; with more than ``most_pieces`` pieces it is split by further blocks first.
    """
    n = prints.count()
    masks = block_masks(blocks or choose_blocks(n, distance), distance)
    inner = [inner_masks(m, distance) for m in masks]
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m)
    by = lambda tables: F.explode(F.array(*[F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(mask).alias("key")) for i, mask in tables])).alias("t")
    key = ["table", "key"]

    def crowds(keyed: DataFrame) -> DataFrame:
        counted = keyed.groupBy(*key).agg(F.count("*").alias("rows")).where(F.col("rows") > group_rows)
        return checkpointed(counted.withColumn("pieces", F.ceil(F.col("rows") * 2 / group_rows).cast("int")))

    def whole(keyed: DataFrame, crowded: DataFrame) -> DataFrame:
        return keyed.join(crowded, key, "left_anti").withColumn("i", F.lit(0)).withColumn("j", F.lit(0))

    def cut(keyed: DataFrame, crowded: DataFrame) -> DataFrame:
        pieces = keyed.join(crowded, key).withColumn("p", F.pmod(F.xxhash64("fp"), F.col("pieces"))).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        return pieces.select(*key, "fp", F.least("p", "q").cast("int").alias("i"), F.greatest("p", "q").cast("int").alias("j"))

    def copies(crowded: DataFrame) -> int:
        return crowded.agg(F.coalesce(F.sum(F.col("rows") * F.col("pieces")), F.lit(0))).first()[0]

    keyed = prints.select("fp", by((i, signed(m)) for i, m in enumerate(masks))).select("t.table", "t.key", "fp")
    crowded = crowds(keyed)
    some, many = crowded.where(F.col("pieces") <= most_pieces), crowded.where(F.col("pieces") > most_pieces)
    plain, rows = whole(keyed, crowded), n * len(masks)
    if crowded.limit(1).count():
        plain, rows = plain.unionByName(cut(keyed, some)), rows + copies(some)
    if many.limit(1).count():
        table = F.array(*[F.array(*map(signed, each)) for each in inner])
        split = keyed.join(many.select(*key), key).select("table", "fp", F.posexplode(F.element_at(table, F.col("table") + 1)).alias("choice", "mask"))
        # numbers of inner tables begin behind those of the outer ones
        split = split.select((F.lit(len(masks)) + F.col("table") * len(inner[0]) + F.col("choice")).alias("table"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        still = crowds(split)
        plain = plain.unionByName(whole(split, still)).unionByName(cut(split, still))
        rows += len(inner[0]) * many.agg(F.sum("rows")).first()[0] + copies(still)
    groups = max(1, -(-rows // DEAL_ROWS))
    dealt = plain.select(F.pmod(F.xxhash64("table", "key", "i", "j"), F.lit(groups)).alias("deal"), F.xxhash64("table", "key", "i", "j").alias("key"), "fp")

    def compare(table: pa.Table) -> pa.Table:
        key, fp = (table.column(c).to_numpy() for c in ("key", "fp"))
        order = np.lexsort((fp, key))
        key, fp = key[order], fp[order]
        again = np.concatenate((key[1:] == key[:-1], [False]))
        start = again & ~np.concatenate(([False], again[:-1]))
        end = ~again & np.concatenate(([False], again[:-1]))
        unsigned = fp.view(np.uint64)
        starts, ends = np.flatnonzero(start), np.flatnonzero(end)
        two = starts[ends - starts == 1]
        close = two[np.bitwise_count(unsigned[two] ^ unsigned[two + 1]) <= distance]
        pairs = [np.stack([fp[close], fp[close + 1]], 1)]
        for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            near = forest(unsigned[a : b + 1], distance)
            pairs.append(fp[a + np.array(near, np.int64).reshape(-1, 2)])
        pairs = np.unique(np.concatenate(pairs), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return dealt.groupBy("deal").applyInArrow(compare, "a long, b long")


def components(made: DataFrame, distance: int = 4, group_rows: int = 4096) -> DataFrame:
    """(fp, component, component_id) for every fingerprint ``fp`` of ``made`` (doc_id, fp): the component's
    smallest fingerprint and smallest id.

    What is joined is materialised first, so that both sides of a join are plain shuffles and Spark
    can split a hot key among tasks.
    """
    first = checkpointed(made.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = connected_components(links(first.select("fp"), distance, group_rows))
    joined = checkpointed(first.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    named = checkpointed(joined.groupBy("component").agg(F.min("first_id").alias("component_id")))
    return checkpointed(joined.join(named, "component").select("fp", "component", "component_id"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 4, distance: int = 4, group_rows: int = 4096) -> DataFrame:
    """Per document: doc_id, fingerprint (long), component_id (smallest id of its component)."""
    made = checkpointed(docs.select(F.col(doc_id).alias("doc_id"), simhash(F.col(text), shingle).alias("fp")))
    named = components(made, distance, group_rows)
    return made.join(named, "fp").select("doc_id", F.col("fp").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 4, distance: int = 4, group_rows: int = 4096) -> DataFrame:
    """``docs`` with one row of each component: the smallest id (a null one last), of equal ids the
    smallest hash of the text, then of the whole row; of rows that are equal throughout any.

    Rows are found again by two hashes of all their values, nulls told apart; columns stay.
    """
    k1, k2 = fresh_name(docs, "key1"), fresh_name(docs, "key2")
    # maps cannot be hashed, so they are written out first
    plain = lambda f: F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
    values = [x for f in docs.schema for x in (plain(f), F.col(f"`{f.name}`").isNull())]
    keyed = docs.withColumns({k1: F.xxhash64(*values), k2: F.xxhash64(F.lit(1), *values)})
    made = checkpointed(keyed.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(k1).alias("k1"), F.col(k2).alias("k2"), simhash(F.col(text), shingle).alias("fp")))
    named = components(made.select("doc_id", "fp"), distance, group_rows)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "k1", "k2")
    first = made.groupBy("fp").agg(F.min(order).alias("best"))
    kept = first.join(named, "fp").groupBy("component").agg(F.min("best").alias("best"))
    keys = checkpointed(kept.select(F.col("best.k1").alias(k1), F.col("best.k2").alias(k2)).distinct())
    return keyed.join(keys, [k1, k2], "left_semi").dropDuplicates([k1, k2]).select(*[F.col(f"`{c}`") for c in docs.columns])
