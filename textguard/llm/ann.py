"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

Unit vectors go to the nearest of some coarse centroids. What is left, divided by the usual size
of residuals in that list, is product-quantised: each block of components becomes the number of
its nearest codeword. A query visits its nearest lists, sums asymmetric distances from tables of
its own residual against the codewords, and the best candidates are reranked by exact cosine on
the original vectors.

The centroids, the codebooks, the number of lists to visit and the number of candidates are fitted
on a sample of at most ``sample_rows`` vectors; all vectors are indexed and searched.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no
part, nor do rows with a null id or a length other than the commonest (of equally common the
longest); ties go to the smaller id; an id that comes twice counts once, with its best score; a
query without any candidate gives no row; an empty table gives no rows.

Equal vectors (by two 64-bit hashes of their components) are indexed once, under the smallest of
their ids. A group keeps its ``k`` + 1 smallest ids, which take its place after the reranking, so
copies neither crowd out other candidates nor each other.

Scale: no group of copies is gathered, as each partition passes on its ``k`` + 1 smallest ids only.
The index is dealt into shards of about ``shard_rows`` rows: small lists share one, a hot
list is spread over many. Queries go to the shards of their lists and are cut into blocks there, so
no task holds an unbounded group, and a shard is copied only for the blocks of queries that visit
it. Only each shard's best candidates of a query leave it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Queries of a shard that one task compares at most, and at least where cores would idle otherwise.
QUERY_BLOCK, SMALL_BLOCK = 4096, 256
#: Most tasks of one search.
MOST_TASKS = 20_000
#: Candidates of a query above which finer codes are fitted.
FINER_ABOVE = 4096


def usable(vector: Column) -> Column:
    """Whether a vector can have a cosine."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, number) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * (x @ centres.T), axis=1)


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids from Lloyd's rounds; an empty one moves to a random point."""
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sizes = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        filled = np.flatnonzero(sizes)
        centres[filled] = np.add.reduceat(x[order], np.concatenate(([0], np.cumsum(sizes)[:-1]))[filled]) / sizes[filled, None]
        empty = np.flatnonzero(sizes == 0)
        centres[empty] = x[rng.integers(0, len(x), len(empty))]
    return centres


@dataclass(frozen=True)
class Quantiser:
    """centres (lists x dims), scale of residuals for each list, codebooks (blocks x codewords x width)."""

    centres: np.ndarray
    scale: np.ndarray
    codebooks: np.ndarray
    visits: int
    depth: int

    def padded(self, x: np.ndarray) -> np.ndarray:
        """Residuals as (rows, blocks, width), filled up with zeros."""
        blocks, _, width = self.codebooks.shape
        return np.pad(x, ((0, 0), (0, blocks * width - x.shape[1]))).reshape(-1, blocks, width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = _nearest(x, self.centres)
        parts = self.padded((x - self.centres[near]) / self.scale[near, None])
        return near, np.stack([_nearest(parts[:, j], book) for j, book in enumerate(self.codebooks)], 1).astype(np.uint8)

    def lists(self, x: np.ndarray) -> np.ndarray:
        """The ``visits`` nearest lists of each query."""
        far = (self.centres**2).sum(1) - 2 * (x @ self.centres.T)
        return np.argsort(far, axis=1, kind="stable")[:, : self.visits]

    def distances(self, x: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances (queries x codes) inside one list."""
        parts = self.padded((x - self.centres[which]) / self.scale[which])
        out = np.zeros((len(x), len(codes)), np.float32)
        for j, book in enumerate(self.codebooks):
            table = ((parts[:, j, None, :] - book) ** 2).sum(-1).astype(np.float32)
            out += table[:, codes[:, j]]
        return out * np.float32(self.scale[which] ** 2)


def fit_quantiser(sample: np.ndarray, total: int, neighbours: int, recall: float = 0.99, block_width: int = 2, seed: int = 7) -> Quantiser:
    """Fit on unit vectors ``sample``; visits and depth together reach ``recall`` for the sample's own neighbours, the depth scaled up to ``total`` rows.

    The depth has no upper bound: above ``FINER_ABOVE`` candidates narrower blocks are tried, which lower it.
    """
    rng = np.random.default_rng(seed)
    lists = int(np.clip(np.sqrt(total), 1, max(1, len(sample) // 16)))
    centres = kmeans(sample, lists, 12, rng)
    near = _nearest(sample, centres)
    left = sample - centres[near]
    sizes = np.bincount(near, minlength=lists)
    scale = np.sqrt(np.bincount(near, (left**2).sum(1), lists) / np.maximum(sizes, 1))
    scale[scale < 1e-9] = 1.0
    asked = rng.choice(len(sample), min(300, len(sample)), replace=False)
    exact = sample[asked] @ sample.T
    exact[np.arange(len(asked)), asked] = -2
    best = np.argsort(-exact, axis=1)[:, : min(neighbours, max(1, len(sample) - 1))]
    far = (centres**2).sum(1) - 2 * (sample[asked] @ centres.T)
    place = np.argsort(np.argsort(far, axis=1, kind="stable"), axis=1)
    # half of what may be missed goes to the visits, so that the depth can reach the target over all neighbours
    visits = int(np.quantile(np.take_along_axis(place, near[best], 1), (1 + recall) / 2, method="higher")) + 1

    def coded(width: int) -> Quantiser:
        blocks = -(-sample.shape[1] // width)
        draft = Quantiser(centres, scale, np.zeros((blocks, 1, width)), lists, len(sample))
        parts = draft.padded(left / scale[near, None])
        books = np.stack([kmeans(parts[:, j], min(256, max(1, len(sample) // 4)), 8, rng) for j in range(blocks)])
        full = Quantiser(centres, scale, books, lists, len(sample))
        codes = full.encode(sample)[1]
        rough = np.full(exact.shape, np.inf, np.float32)
        for which in range(lists):
            members = np.flatnonzero(near == which)
            who = np.flatnonzero(place[:, which] < visits)
            if len(members) and len(who):
                rough[np.ix_(who, members)] = full.distances(sample[asked[who]], which, codes[members])
        rank = np.argsort(np.argsort(rough, axis=1), axis=1)
        depth = int(np.quantile(np.take_along_axis(rank, best, 1), recall, method="higher")) + 1
        depth = max(int(np.ceil(depth * max(1.0, total / len(sample)) * 1.2)), 16 * neighbours)
        return Quantiser(centres, scale, books, min(lists, max(visits, 2)), depth)

    quantiser = coded(block_width)
    while quantiser.depth > FINER_ABOVE and block_width > 1:
        block_width -= 1
        quantiser = min(quantiser, coded(block_width), key=lambda q: q.depth)
    return quantiser


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", sample_rows: int = 20_000, sample_values: int = 4_000_000, shard_rows: int = 16_384, seed: int = 7) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest by cosine of every row where ``is_query`` holds."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), is_query.alias("asks")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    id_type = rows.schema["vec_id"].dataType.simpleString()
    result = f"query_id {id_type}, rank int, vec_id {id_type}, score double"
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], result)
    dims = lengths["d"]
    rows = rows.where(F.size("v") == dims).select("*", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(seed), F.col("v")).alias("h2"))
    key = ["vec_id", "h1", "h2"]
    copies = Window.partitionBy("h1", "h2").orderBy("vec_id")
    least = rows.select(*key).distinct().withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1)
    groups = checkpointed(least.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("vec_id"), "h1", "h2", "ids"))
    total = groups.count()
    wanted = min(sample_rows, max(256, sample_values // dims))
    drawn = F.pmod("h2", F.lit(1 << 30)) / F.lit(float(1 << 30))
    for chosen in (groups.where(drawn < min(1.0, wanted / total)).orderBy("h2", "h1").limit(2 * wanted), groups.limit(wanted)):
        sample = rows.join(F.broadcast(chosen.select(*key)), key).groupBy(*key).agg(F.any_value("v").alias("v")).orderBy(*key).collect()
        if sample:
            break
    quantiser = fit_quantiser(_unit(np.array([r["v"] for r in sample])), total, k, seed=seed)

    def matrix(column: pa.Array) -> np.ndarray:
        return _unit(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))

    def encode(batches):
        for batch in batches:
            if batch.num_rows:
                near, codes = quantiser.encode(matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays([*map(batch.column, key), pa.array(near.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=[*key, "list", "code"])

    coded = rows.select(*key, "v").mapInArrow(encode, f"vec_id {id_type}, h1 long, h2 long, list int, code binary")
    coded = coded.groupBy(*key).agg(F.min(F.struct("list", "code")).alias("c"))
    index = checkpointed(coded.join(groups, key).select(*key, "c.list", "c.code", (F.size("ids") == 1).alias("single")))
    sizes = {r["list"]: r["n"] for r in index.groupBy("list").agg(F.count("*").alias("n")).collect()}
    first, spread, shard, filled = np.zeros(len(quantiser.centres), np.int64), np.ones(len(quantiser.centres), np.int64), 0, 0
    for which in range(len(first)):
        n = sizes.get(which, 0)
        if filled and filled + n > shard_rows:
            shard, filled = shard + 1, 0
        first[which], spread[which] = shard, max(1, -(-n // shard_rows))
        filled += n
        if spread[which] > 1:
            shard, filled = shard + int(spread[which]), 0
    placed = vectors.sparkSession.createDataFrame(pd.DataFrame({"list": np.arange(len(first), dtype=np.int32), "first": first, "spread": spread}))
    asked = rows.where("asks").groupBy(*key).agg(F.any_value("v").alias("v")).select(F.col("vec_id").alias("query_id"), F.col("h1").alias("q1"), F.col("h2").alias("q2"), "v")
    carried = asked.columns

    def deal(batches):
        for batch in batches:
            if batch.num_rows:
                shards = [sorted({int(first[w]) + i for w in near for i in range(int(spread[w]))}) for near in quantiser.lists(matrix(batch.column("v")))]
                take = pa.array(np.repeat(np.arange(len(shards)), [len(s) for s in shards]))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c in carried], pa.array([s for each in shards for s in each], pa.int64())], names=[*carried, "shard"])

    visiting = checkpointed(asked.mapInArrow(deal, f"query_id {id_type}, q1 long, q2 long, v array<double>, shard long"))
    # a row for each shard: its number of query blocks, so that a few shards still make work for all cores
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    enough = -(-4 * cores // (shard + 1))
    per_shard = F.greatest(F.ceil(F.col("n") / QUERY_BLOCK), F.least(F.ceil(F.col("n") / SMALL_BLOCK), F.lit(enough)))
    blocks = checkpointed(visiting.groupBy("shard").agg(F.count("*").alias("n")).select("shard", per_shard.cast("long").alias("blocks")))
    groups_dealt = int(blocks.agg(F.sum("blocks")).first()[0] or 1)
    visiting = visiting.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("query_id", "q1"), F.col("blocks"))).drop("blocks")
    # the list table is bounded by the sample: one row for each centroid
    stored = index.join(F.broadcast(placed), "list").select((F.col("first") + F.pmod(F.xxhash64("vec_id", "code"), F.col("spread"))).alias("shard"), *key, "single", "list", "code")
    stored = stored.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    visiting, stored = (side.repartition(min(groups_dealt, MOST_TASKS), "shard", "block") for side in (visiting, stored))

    def search(asking: pa.Table, held: pa.Table) -> pa.Table:
        asks, holds = ["query_id", "q1", "q2"], ["vec_id", "h1", "h2", "single"]
        empty = pa.table({c: asking.column(c)[:0] for c in asks} | {c: held.column(c)[:0] for c in holds} | {"far": pa.array([], pa.float32())})
        if not asking.num_rows or not held.num_rows:
            return empty
        held = held.sort_by("vec_id")
        which = held.column("list").to_numpy()
        codes = np.frombuffer(b"".join(held.column("code").to_pylist()), np.uint8).reshape(len(which), -1)
        order = np.argsort(which, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], np.diff(which[order]) != 0)))
        queries, parts = matrix(asking.column("v").combine_chunks()), []
        for at in range(0, len(queries), 256):
            block = queries[at : at + 256]
            visited = quantiser.lists(block)
            who_all, item_all, far_all = [], [], []
            for a, b in zip(starts, [*starts[1:], len(order)]):
                who = np.flatnonzero((visited == which[order[a]]).any(1))
                if not len(who):
                    continue
                far = quantiser.distances(block[who], int(which[order[a]]), codes[order[a:b]])
                keep = min(quantiser.depth, b - a)
                # distances are not negative, so their bits sort as they do; equal ones go by id
                keyed = far.view(np.uint32).astype(np.uint64) << np.uint64(32) | np.arange(b - a, dtype=np.uint64)
                keyed = np.partition(keyed, keep - 1, axis=1)[:, :keep].ravel()
                who_all.append(np.repeat(who, keep))
                item_all.append(order[a:b][(keyed & np.uint64(0xFFFFFFFF)).astype(np.int64)])
                far_all.append((keyed >> np.uint64(32)).astype(np.uint32).view(np.float32))
            if not who_all:
                continue
            who, item, far = np.concatenate(who_all), np.concatenate(item_all), np.concatenate(far_all)
            sort = np.lexsort((item, far, who))
            who, item, far = who[sort], item[sort], far[sort]
            begin = np.searchsorted(who, who)
            top = np.arange(len(who)) - begin < quantiser.depth
            asker, holder = pa.array(who[top] + at), pa.array(item[top])
            parts.append(pa.table({c: asking.column(c).take(asker) for c in asks} | {c: held.column(c).take(holder) for c in holds} | {"far": pa.array(far[top], pa.float32())}))
        return pa.concat_tables(parts) if parts else empty

    found = visiting.groupBy("shard", "block").cogroup(stored.groupBy("shard", "block")).applyInArrow(search, f"query_id {id_type}, q1 long, q2 long, vec_id {id_type}, h1 long, h2 long, single boolean, far float")
    nearest = Window.partitionBy("query_id", "q1", "q2").orderBy("far", "vec_id", "h1", "h2")
    others = found.where("query_id <> vec_id or not single")  # the own group counts for its other ids
    near = others.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= quantiser.depth).drop("place", "far", "single")
    # a power of two brings the largest component near 1: exact, and neither tiny nor huge vectors leave the range of doubles
    power = lambda v: F.pow(F.lit(2.0), -F.greatest(F.lit(-1000.0), F.least(F.lit(1000.0), F.floor(F.log2(F.array_max(F.transform(v, F.abs)))).cast("double"))))
    scaled = lambda v: F.transform(F.array(power(v)), lambda p: F.transform(v, lambda x: x * p))[0]
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    exact = near.join(groups, key).join(rows.select(*key, scaled(F.col("v")).alias("b")), key).join(asked.withColumn("a", scaled(F.col("v"))).drop("v"), ["query_id", "q1", "q2"])
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    members = exact.select("query_id", "ids", (dot / (norm(F.col("a")) * norm(F.col("b")))).alias("score")).select("query_id", F.explode("ids").alias("vec_id"), "score")
    scored = members.where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return scored.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
