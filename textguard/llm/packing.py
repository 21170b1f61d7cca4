"""Best-fit packing with several permitted sequence lengths.

Documents are cut into pieces of at most the largest capacity; pieces go, longest first, into the
open bin that they fill best. When none fits, a bin is opened at the least-cost permitted size
that holds the piece. How much room a new bin should offer to later pieces is decided jointly for
all sizes: each permitted length is tried as the smallest size to open, and the plan of least
total cost is kept, after every bin has been downsized to the smallest capacity that holds its
contents. A bin costs ``overhead`` plus its capacity plus ``attention`` times its square.

Defined results: null or empty documents have no token and get one row without a bin; pieces of
equal length keep their order; repeated rows are packed each; an empty table gives no rows; other
columns are ignored.

Scale: no shuffle. Each partition is packed in blocks of ``block_rows`` pieces, so memory is
bounded and a block's few half-empty bins do not matter; a bin is named by shard (partition and
block) and number. Bins depend on the order of a partition's rows, so a retried task gives the same
ones where that order is fixed, as for files and for rows sorted within partitions; after a bare
shuffle they may differ, but every piece is still packed once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITIES = (256, 512, 1024, 2048, 4096)


def cost(capacity: np.ndarray, overhead: float, attention: float) -> np.ndarray:
    return overhead + capacity + attention * np.square(capacity, dtype=np.float64)


def best_fit(lengths: list[int], capacities: list[int], least: int) -> tuple[list[int], list[int]]:
    """Bin of each length (all positive, longest first), and tokens in each bin; new bins have the smallest capacity that is at least ``least`` and holds the piece.

    Open bins are kept by their room; bit r of ``rooms`` tells whether any has room r.
    """
    by_room: dict[int, list[int]] = {}
    rooms, chosen, filled = 0, [], []
    for n in lengths:
        above = rooms >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room = next(c for c in capacities if c >= max(n, least))
            at = len(filled)
            filled.append(0)
        chosen.append(at)
        filled[at] += n
        if room > n:
            by_room.setdefault(room - n, []).append(at)
            rooms |= 1 << (room - n)
    return chosen, filled


def pack(lengths: np.ndarray, capacities: tuple[int, ...], overhead: float, attention: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each length: bin, offset in it, final capacity of it."""
    sizes = np.array(sorted(capacities))
    order = np.argsort(-lengths, kind="stable")
    ordered = lengths[order].tolist()
    plans = []
    for least in sizes.tolist():
        chosen, filled = best_fit(ordered, sizes.tolist(), least)
        final = sizes[np.searchsorted(sizes, filled)]
        plans.append((float(cost(final, overhead, attention).sum()), chosen, final))
    _, chosen, final = min(plans, key=lambda p: p[0])
    bins, offsets, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), [0] * len(final)
    for at, which, n in zip(order.tolist(), chosen, ordered):
        bins[at], offsets[at] = which, used[which]
        used[which] += n
    return bins, offsets, final[bins]


def pack_documents(docs: DataFrame, tokens: Column, doc_id: str = "doc_id", capacities: tuple[int, ...] = CAPACITIES, overhead: float = 16.0, attention: float = 1 / 8192, block_rows: int = 50_000) -> DataFrame:
    """One row per piece: doc_id, piece, start and length (tokens of the document), shard, bin, bin_offset, capacity."""
    most = max(capacities)
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(tokens, F.lit(0)).cast("long").alias("n_tokens"))
    pieces = sized.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n_tokens") / most) - 1, F.lit(0)).cast("long"))).alias("piece"))
    cut = pieces.select("doc_id", "piece", (F.col("piece") * most).alias("start"), F.least(F.lit(most).cast("long"), F.col("n_tokens") - F.col("piece") * most).alias("length"))
    id_type = cut.schema["doc_id"].dataType.simpleString()

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, block, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def packed() -> pd.DataFrame:
            out = pd.concat(held, ignore_index=True)
            full = np.flatnonzero(out["length"].to_numpy() > 0)
            columns = {c: pd.array([pd.NA] * len(out), "Int64") for c in ("shard", "bin", "bin_offset", "capacity")}
            if len(full):
                found = pack(out["length"].to_numpy()[full], capacities, overhead, attention)
                for c, values in zip(columns, (np.full(len(full), part << 32 | block), *found)):
                    columns[c][full] = values
            return out.assign(**columns)

        for batch in batches:
            for at in range(0, len(batch), block_rows):
                held.append(batch.iloc[at : at + block_rows])
                rows += len(held[-1])
                if rows >= block_rows:
                    yield packed()
                    block, held, rows = block + 1, [], 0
        if rows:
            yield packed()

    return cut.mapInPandas(fill, f"doc_id {id_type}, piece long, start long, length long, shard long, bin long, bin_offset long, capacity long")
