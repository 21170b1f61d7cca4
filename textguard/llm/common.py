"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of every word-based operator: maximal runs without ASCII white space.
WORD_REGEX = r"[^\x20\x09-\x0D]+"

LOWER_ASCII = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words_of(raw: bytes | None) -> list[bytes]:
    """Words of UTF-8 text; bytes.split() knows exactly the six ASCII white-space characters."""
    return raw.split() if raw else []


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_REGEX)), F.lit(0)).cast("long")


def id_crc(doc_id: Column) -> Column:
    """crc32 of an id written as text, by which the fixed folds are cut."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage there."""
    shared_folder(df)
    return df.checkpoint(eager=True)


def shared_folder(df: DataFrame) -> str:
    """The session's checkpoint folder, set up if need be.

    It is the one that spark.checkpoint.dir names. Only in local mode (tests, a laptop) a temporary
    folder stands in where that is unset; on a cluster a machine's own folder would lose results.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def store(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it again: for wide tables. Returns its folder too."""
    path = f"{shared_folder(df)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def release(df: DataFrame, path: str) -> None:
    """Free the space of a stored table that nobody reads any more: overwrite it by an empty one of its columns."""
    df.sparkSession.createDataFrame([], df.schema).coalesce(1).write.mode("overwrite").parquet(path)


def fresh_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def finite(vector: Column) -> Column:
    """Whether a vector has components and all of them are finite numbers."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * component) of every component, as double, held inside a long's range."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(c * F.lit(float(scale))))


class WordHashes(dict):
    """64-bit hashes of words, kept for the words seen lately so that memory stays bounded."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Odd multiplier of the rolling hash, and its inverse modulo 2**64.
ROLL = 0x9E3779B97F4A7C15
UNROLL = pow(ROLL, -1, 1 << 64)


@lru_cache(64)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive word hashes (none if there are fewer).

    Polynomial modulo 2**64 over prefix sums, then mixed so that all bits depend on all words.
    """
    n = len(hashes)
    if n < width:
        return np.empty(0, np.uint64)
    size = 1 << max(12, (n + 1).bit_length())
    up, down = _powers(ROLL, size), _powers(UNROLL, size)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * down[:n], out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * up[: n - width + 1])


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche (the splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
