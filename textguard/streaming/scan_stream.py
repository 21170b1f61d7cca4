"""The scan, pins and logs of calls on Structured Streaming input."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructType, TimestampType

from ..operators.scan import scan


def decision_counts(stream: DataFrame, ts: str = "ts", text: str = "text", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Decisions per event-time window, with a watermark for late rows."""
    return scan(stream.withWatermark(ts, late), text).groupBy(F.window(ts, window), "decision").agg(F.count("*").alias("n"))


#: The state store that keyed state needs.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstUse(StatefulProcessor):
    """The digest pinned for a tool, with the event time of its first use. ``days``: state that long unused expires (0: never)."""

    PINNED = StructType().add("sha256", StringType()).add("first", TimestampType())

    def __init__(self, days: int = 0):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pinned = handle.getValueState("pinned", self.PINNED, self.days * 86_400_000 or None)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen: dict[str | None, list] = {}  # for each digest its rows and its first event time; rows themselves are not kept
        for part in rows:
            for sha, times in part.groupby("sha256", dropna=False)["ts"]:
                held = seen.setdefault(None if pd.isna(sha) else sha, [0, pd.NaT])
                held[0] += len(times)
                held[1] = pd.Series([held[1], times.min()]).min()
        pinned, fresh = (self.pinned.get() if self.pinned.exists() else None), None
        if pinned is None:
            # the first by event time; rows without a time come last, of equal times the smaller digest
            order = sorted((pd.isna(at), at if not pd.isna(at) else pd.Timestamp(0), sha) for sha, (_, at) in seen.items() if sha is not None)
            if order:
                fresh = order[0][2]
                pinned = fresh, None if pd.isna(seen[fresh][1]) else seen[fresh][1].to_pydatetime()
        if pinned is not None:
            self.pinned.update(tuple(pinned))  # an update keeps the state from expiring
        out = [(key[0], sha, "new" if sha is not None and sha == fresh else "ok" if pinned is not None and sha is not None and sha == pinned[0] else "changed", n) for sha, (n, _) in seen.items()]
        yield pd.DataFrame(out, columns=["tool", "sha256", "status", "n"])

    def close(self) -> None:
        pass


def pin_on_first_use(stream: DataFrame, tool: str = "tool", sha: str = "sha256", ts: str = "ts", days: int = 0) -> DataFrame:
    """(tool, sha256, status, n) of the digests that each batch brings: ``new`` for a tool's first by event time, which is pinned,
    ``ok`` where it comes again, else ``changed``; ``n`` counts rows. Null digests are ``changed``.

    The state is one digest for each tool. A batch's rows of a tool are read part by part and only counted by digest,
    so a tool with very many rows takes no more memory than its digests. It needs the state store ``STATE_STORE``.
    """
    rows = stream.select(F.col(tool).alias("tool"), F.col(sha).alias("sha256"), F.col(ts).alias("ts"))
    schema = StructType().add("tool", StringType()).add("sha256", StringType()).add("status", StringType()).add("n", LongType())
    return rows.groupBy("tool").transformWithStateInPandas(FirstUse(days), schema, "Append", "ProcessingTime" if days else "None")


def calls_once(stream: DataFrame, key: str = "call_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Calls without those that come again within ``late`` of event time; rows later than the watermark are dropped."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def daily_log(stream: DataFrame, path: str, checkpoint: str, ts: str = "ts"):
    """A writer (not started) that appends each batch to the JSON log below ``path``, in folders batch=<number>/day=<day>.

    A batch that was written whole is passed over when it is replayed, and one that was cut short is written anew, so every call
    stands in the log once: together with the stream's checkpoint that is exactly once.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = f"{path}/batch={number:012d}"
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            batch.write.format("noop").mode("overwrite").save()  # read all the same, as that is what commits the stream's state
            return
        batch.withColumn("day", F.to_date(ts)).write.mode("overwrite").partitionBy("day").json(folder)

    return stream.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint)


def read_daily_log(spark, path: str, schema: str) -> DataFrame:
    """Rows of daily_log with their day; the number of the batch is left out."""
    return spark.read.schema(schema + ", batch string, day date").json(path).drop("batch")
