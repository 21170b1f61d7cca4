"""Exact search for the largest integer inner products, by pivot tables.

Vectors become whole numbers x = floor(scale * component). Inside a group of vectors whose norms are at most M, the
vector (x, sqrt(M^2 - |x|^2)) has the same distance to (q, 0) as any other one of equal inner product, namely
d^2 = |q|^2 + M^2 - 2 q.x: the largest inner products are the nearest neighbours. Pivots are some of the vectors,
as (p, 0); the distances of every vector to every pivot make the pivot table. By the triangle inequality each pivot
bounds d from below by the difference between its distances to the query and to the candidate, and the largest of these
bounds the inner product from above.

Vectors are put in cells: of one range of norms, with one nearest pivot, in one ring around it. A cell is known by the
least and the greatest distance to each pivot. Every query first visits the shard of its best cell, which gives it
a score to beat (that of the ``k`` + 1st id), then all other shards in which some cell's bound reaches that score.
Inside a shard the candidates that the pivots leave are evaluated in the order of their bounds until no bound that is
left reaches the score to beat. Where pivots leave most of a shard, it is evaluated as a whole. Nothing is skipped
that could be among the results, ties included.

Defined results: vectors that are null or empty or hold null or non-finite components take no part, nor do rows with a
null id or a length other than the commonest (of equally common the longest); zero vectors do. Ties go to the
smaller id; an id that comes twice counts once, with its best score; a query without candidates gives no row; an empty table gives
no rows. Numbers and scores beyond a long's range are held at its ends.

Scale: equal vectors are one candidate with their ``k`` + 1 smallest ids, and equal queries are one query; no group of copies is
gathered, as each partition passes on its smallest ids only. Shards have about ``shard_rows`` vectors
(more where there would be over ``most_shards``), large cells are spread over several; queries of a shard are cut into
blocks, one task each, and a shard is copied only for the blocks that visit it. The driver holds a bounded sample, the
pivots and a row for each cell: at most pivots x ``RINGS`` x ranges of norms. A table that no pivot can prune costs all inner products, by matrix
products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, finite, whole_numbers

#: Queries of a shard that one task compares at most, and at least where cores would idle otherwise.
QUERY_BLOCK, SMALL_BLOCK = 4096, 256
#: Most tasks of one search.
MOST_TASKS = 20_000
#: Rings of distance around a pivot; pivots looked at together; candidates evaluated together.
RINGS, TOGETHER, BATCH = 16, 8, 1024
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def spread_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows of ``sample`` by farthest-first traversal, beginning with the one nearest to the mean."""
    chosen = [int(np.argmin(((sample - sample.mean(0)) ** 2).sum(1)))]
    far = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)) and far.max() > 0:
        chosen.append(int(np.argmax(far)))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


@dataclass(frozen=True)
class Pivots:
    """Integer pivots (as floats), and bounds on inner products that follow from distances to them."""

    points: np.ndarray

    def products(self, x: np.ndarray) -> np.ndarray:
        return x @ self.points.T

    def far(self, products: np.ndarray, most: np.ndarray | float) -> np.ndarray:
        """Distances to the pivots of vectors lifted to the norm ``most`` (squared); of queries, where it is their own."""
        return np.sqrt(np.maximum((self.points**2).sum(1) + most - 2 * products, 0.0))

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, inner products with the pivots, and squared norm of each vector."""
        products, norm = self.products(x), (x**2).sum(1)
        band = np.maximum(np.frexp(norm)[1], 0) // 2  # norms of a band differ by a factor of 2 at most
        nearest = np.argmin((self.points**2).sum(1) - 2 * products, axis=1)
        own = self.points[nearest]
        apart = np.sqrt(np.maximum(norm + (own**2).sum(1) - 2 * products[np.arange(len(x)), nearest], 0.0))
        ring = np.minimum(RINGS - 1, apart * RINGS / (2.0 * np.sqrt(norm + 1.0) + np.sqrt((own**2).sum(1)))).astype(np.int64)
        return (band * len(self.points) + nearest) * RINGS + ring, products, norm

    @staticmethod
    def best(apart: np.ndarray, query: np.ndarray | float, most: np.ndarray | float) -> np.ndarray:
        """Upper bound of inner products where the distance is at least ``apart``; ``query`` and ``most`` are squared norms."""
        both = query + most
        # whole numbers below 2^53 are exact; beyond, roots of cancelled differences err by their root
        slack = np.where(both < 2.0**52, 1e-9, 1e-6) * both + 1.0
        return np.minimum((both - apart**2) / 2 + slack, np.sqrt(query) * np.sqrt(most) * (1 + 1e-9) + 1.0)


def exact_products(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of integer rows with integer queries (rows x queries), exact, held inside a long's range."""
    bound = np.sqrt((x.astype(float) ** 2).sum(1).max(initial=0.0)) * np.sqrt((query.astype(float) ** 2).sum(1).max(initial=0.0))
    for most, kind in ((2.0**23, np.float32), (2.0**52, np.float64)):
        if bound < most:  # no partial sum exceeds the product of the norms
            return np.rint(x.astype(kind) @ query.astype(kind).T).astype(np.int64)
    return np.clip(x.astype(object) @ query.astype(object).T, LEAST, MOST).astype(np.int64)


class Best:
    """The best candidates of a query: of equal scores those with the smallest first ids, until ``k`` + 1 ids are ahead."""

    def __init__(self, k: int, ids: list, first: np.ndarray, floor: int | None):
        self.k, self.ids, self.first = k, ids, first
        self.floor = floor  # score to beat: candidates that reach it matter
        self.rows, self.scores = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, rows: np.ndarray, scores: np.ndarray) -> None:
        if self.floor is not None:
            kept = scores >= self.floor
            rows, scores = rows[kept], scores[kept]
        if not len(rows):
            return
        rows, scores = np.concatenate((self.rows, rows)), np.concatenate((self.scores, scores))
        order = np.lexsort((self.first[rows], np.negative(np.maximum(scores, LEAST + 1))))
        seen, heads, stop = set(), set(), 0
        for stop, at in enumerate(order.tolist()):
            if len(heads) > self.k or (len(seen) > self.k and scores[at] < self.floor):
                break
            heads.add(self.ids[rows[at]][0])
            before = len(seen)
            seen.update(self.ids[rows[at]])
            if before <= self.k < len(seen):
                self.floor = int(scores[at])
        else:
            stop = len(order)
        self.rows, self.scores = rows[order[:stop]], scores[order[:stop]]


def search_shard(pivots: Pivots, x: np.ndarray, ids: list, queries: np.ndarray, floors: list, k: int) -> list[Best]:
    """The best candidates among the rows ``x`` (integers, with their ids) for each query."""
    first = np.array([i[0] for i in ids])
    place = np.argsort(np.argsort(first, kind="stable"), kind="stable") if first.dtype == object else first
    real = x.astype(float)
    most = float((real**2).sum(1).max())
    table = pivots.far(pivots.products(real), most)  # the pivot table of this shard, for all queries of the block
    asked = queries.astype(float)
    norms = (asked**2).sum(1)
    own = pivots.far(pivots.products(asked), norms[:, None])
    order = np.argsort(own, axis=1, kind="stable")  # near pivots bound best
    out, dense = [Best(k, ids, place, f) for f in floors], []
    for j, best in enumerate(out):
        left, apart = np.arange(len(x)), np.zeros(len(x))
        for at in range(0, len(pivots.points), TOGETHER):
            some = order[j, at : at + TOGETHER]
            apart = np.maximum(apart, np.abs(table[np.ix_(left, some)] - own[j, some]).max(1))
            if best.floor is not None:
                kept = pivots.best(apart, norms[j], most) >= best.floor
                if kept.sum() > 0.9 * len(left) and at:
                    break  # more pivots would hardly tell these apart
                left, apart = left[kept], apart[kept]
        if best.floor is not None and len(left) > len(x) // 2:
            dense.append(j)
            continue
        nearest = np.argsort(apart, kind="stable")
        for at in range(0, len(left), BATCH):
            batch = left[nearest[at : at + BATCH]]
            if best.floor is not None and pivots.best(apart[nearest[at]], norms[j], most) < best.floor:
                break
            best.add(batch, exact_products(x[batch], queries[j : j + 1])[:, 0])
    for at in range(0, len(dense), 64):
        some = dense[at : at + 64]
        scores = exact_products(x, queries[some])
        for column, j in enumerate(some):
            out[j].add(np.arange(len(x)), scores[:, column])
    return out


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding", pivots: int = 64, sample_rows: int = 4096, sample_values: int = 4_000_000, shard_rows: int = 16_384, most_shards: int = 4096, seed: int = 11) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` largest inner products of every row where ``is_query`` holds."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("v"), is_query.alias("asks")).where(F.col("vec_id").isNotNull() & finite(F.col("v")))
    id_type = rows.schema["vec_id"].dataType.simpleString()
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, vec_id {id_type}, score bigint")
    dims = lengths["d"]
    rows = rows.where(F.size("v") == dims).select("vec_id", whole_numbers(F.col("v"), scale).alias("x"), "asks").select("*", F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(seed), F.col("x")).alias("h2"))
    copies = Window.partitionBy("h1", "h2", "x").orderBy("vec_id")
    least = rows.select("h1", "h2", "x", "vec_id").withColumn("place", F.dense_rank().over(copies)).where(F.col("place") <= k + 1)
    groups = checkpointed(least.groupBy("h1", "h2", "x").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")))
    total = groups.count()
    wanted = min(sample_rows, max(256, sample_values // dims))
    drawn = F.pmod("h2", F.lit(1 << 30)) / F.lit(float(1 << 30))
    for chosen in (groups.where(drawn < min(1.0, wanted / total)).orderBy("h2", "h1").limit(2 * wanted), groups.limit(wanted)):
        sample = chosen.select("x").collect()
        if sample:
            break
    held = Pivots(spread_pivots(np.array([r["x"] for r in sample], float), pivots))

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)

    def celled(batches):
        for batch in batches:
            if batch.num_rows:
                cell = held.cells(matrix(batch.column("x")).astype(float))[0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], names=[*batch.schema.names, "cell"])

    index = checkpointed(groups.mapInArrow(celled, f"h1 long, h2 long, x array<bigint>, ids array<{id_type}>, cell long"))
    limits = "cell long, n long, most double, low array<double>, high array<double>"

    def limit(batches):
        for batch in batches:
            if batch.num_rows:
                cell, products, norm = held.cells(matrix(batch.column("x")).astype(float))
                order = np.argsort(cell, kind="stable")
                cell, products, norm = cell[order], products[order], norm[order]
                at = np.flatnonzero(np.diff(cell, prepend=-1))
                yield pa.RecordBatch.from_arrays([
                    pa.array(cell[at]), pa.array(np.diff(np.append(at, len(cell)))), pa.array(np.maximum.reduceat(norm, at)),
                    pa.array(list(np.minimum.reduceat(products, at))), pa.array(list(np.maximum.reduceat(products, at))),
                ], names=["cell", "n", "most", "low", "high"])

    def joined(table: pa.Table) -> pa.Table:
        low, high = (np.array(table.column(c).to_pylist()) for c in ("low", "high"))
        return pa.table({"cell": table.column("cell")[:1], "n": [sum(table.column("n").to_pylist())], "most": [max(table.column("most").to_pylist())], "low": [low.min(0).tolist()], "high": [high.max(0).tolist()]}, schema=pa.schema([table.schema.field(c) for c in ("cell", "n", "most", "low", "high")]))

    known = index.mapInArrow(limit, limits).groupBy("cell").applyInArrow(joined, limits).orderBy("cell").collect()
    size = max(shard_rows, -(-total // most_shards))
    first, spread, shard, filled = [], [], 0, 0
    for row in known:
        pieces = max(1, -(-row["n"] // size))
        if filled and filled + row["n"] > size:
            shard, filled = shard + 1, 0
        first.append(shard)
        spread.append(pieces)
        filled += row["n"]
        if pieces > 1:
            shard, filled = shard + pieces, 0
    first, spread = np.array(first), np.array(spread)
    most = np.array([row["most"] for row in known])
    # products fall as distances grow
    near, far = (held.far(np.array([row[c] for row in known]), most[:, None]) for c in ("high", "low"))

    # a row for each cell, whose number is bounded by pivots, rings and ranges of norms
    placed = F.broadcast(spark.createDataFrame(pd.DataFrame({"cell": [row["cell"] for row in known], "first": first, "spread": spread})))
    stored = index.join(placed, "cell").select((F.col("first") + F.pmod("h1", "spread")).alias("shard"), "x", "ids")
    asked = checkpointed(rows.where("asks").select(F.col("vec_id").alias("query_id"), F.col("h1").alias("q1"), F.col("h2").alias("q2"), "x").distinct())
    queries = asked.groupBy("q1", "q2", "x").agg(F.lit(None).cast("long").alias("floor"))

    carried = queries.columns

    def bounds(x: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores (queries x cells)."""
        norm = (x**2).sum(1)
        own = held.far(held.products(x), norm[:, None])
        out = np.empty((len(x), len(most)))
        for j in range(len(x)):
            apart = np.maximum(np.maximum(near - own[j], own[j] - far).max(1), 0.0)
            out[j] = held.best(apart, norm[j], most)
        return out

    def deal(home: bool):
        """A row for each query and shard to visit: the shard of the best cell, or all others that can reach the score to beat."""

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                reach, salt = bounds(matrix(batch.column("x")).astype(float)), batch.column("q2").to_numpy()
                shards = []
                for j, floor in enumerate(batch.column("floor").to_pylist()):
                    best = int(np.argmax(reach[j]))
                    own = int(first[best] + salt[j] % spread[best])
                    met = np.ones(len(most), bool) if floor is None else reach[j] >= floor
                    shards.append([own] if home else sorted({s for c in np.flatnonzero(met) for s in range(first[c], first[c] + spread[c])} - {own}))
                take = pa.array(np.repeat(np.arange(len(shards)), [len(s) for s in shards]))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c in carried], pa.array([s for each in shards for s in each], pa.int64())], names=[*carried, "shard"])

        return run

    def search(asking: pa.Table, kept: pa.Table) -> pa.Table:
        parts, names = [], ["q1", "q2", "ids", "score", "floor"]
        if asking.num_rows and kept.num_rows:
            ids = kept.column("ids").to_pylist()
            found = search_shard(held, matrix(kept.column("x").combine_chunks()), ids, matrix(asking.column("x").combine_chunks()), asking.column("floor").to_pylist(), k)
            for j, best in enumerate(found):
                parts += [(asking.column("q1")[j].as_py(), asking.column("q2")[j].as_py(), ids[r], s, best.floor) for r, s in zip(best.rows.tolist(), best.scores.tolist())]
        columns = list(zip(*parts)) if parts else [[]] * 5
        kinds = [pa.int64(), pa.int64(), kept.schema.field("ids").type, pa.int64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    def visit(home: bool, queries: DataFrame) -> DataFrame:
        visiting = checkpointed(queries.mapInArrow(deal(home), "q1 long, q2 long, x array<bigint>, floor long, shard long"))
        cores = spark.sparkContext.defaultParallelism
        enough = -(-4 * cores // (shard + 1))
        per_shard = F.greatest(F.ceil(F.col("n") / QUERY_BLOCK), F.least(F.ceil(F.col("n") / SMALL_BLOCK), F.lit(enough)))
        blocks = checkpointed(visiting.groupBy("shard").agg(F.count("*").alias("n")).select("shard", per_shard.cast("long").alias("blocks")))
        dealt = min(int(blocks.agg(F.sum("blocks")).first()[0] or 1), MOST_TASKS)
        asking = visiting.join(blocks, "shard").withColumn("block", F.pmod("q1", "blocks")).drop("blocks")
        held_rows = stored.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
        asking, held_rows = (side.repartition(dealt, "shard", "block").groupBy("shard", "block") for side in (asking, held_rows))
        return checkpointed(asking.cogroup(held_rows).applyInArrow(search, f"q1 long, q2 long, ids array<{id_type}>, score long, floor long"))

    at_home = visit(True, queries)
    floors = at_home.groupBy("q1", "q2").agg(F.max("floor").alias("beat"))
    others = visit(False, queries.join(floors, ["q1", "q2"], "left").select("q1", "q2", "x", F.col("beat").alias("floor")))
    best = at_home.unionByName(others).select("q1", "q2", F.explode("ids").alias("vec_id"), "score")
    best = best.groupBy("q1", "q2", "vec_id").agg(F.max("score").alias("score"))
    ahead = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), F.asc("vec_id"))
    # one more than wanted, as one of them may be a query's own; materialised, so that the queries of a hot vector can be split
    best = checkpointed(best.withColumn("place", F.row_number().over(ahead)).where(F.col("place") <= k + 1).drop("place"))
    scored = asked.select("query_id", "q1", "q2").join(best, ["q1", "q2"]).where("query_id <> vec_id")
    scored = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return scored.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
