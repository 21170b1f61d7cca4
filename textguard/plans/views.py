"""The scan in SQL: temporary views and a table function over scanned documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.engine import Engine
from ..operators.scan import scan
from ..operators.toolcalls import decide, receipts


def register_views(docs: DataFrame, key: str = "doc_id", text: str = "text") -> None:
    """Register the views ``scanned`` (key, decision, findings), ``findings`` (a row for each) and the table function
    ``findings_of(key)``; SQL reads them lazily, with the plans of the scan.
    """
    scanned = scan(docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))).select("key", "decision", "findings")
    scanned.createOrReplaceTempView("scanned")
    scanned.select("key", F.explode_outer("findings").alias("f")).where("f is not null").select("key", "f.*").createOrReplaceTempView("findings")
    docs.sparkSession.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION findings_of(wanted STRING) RETURNS TABLE (id STRING, severity STRING, match STRING) "
        "RETURN SELECT id, severity, match FROM findings WHERE key = wanted"
    )


def register_engine_views(engine: Engine, docs: DataFrame, key: str = "doc_id", text: str = "text", channel: str | Column = "message") -> None:
    """Register the views ``patterns`` (a row for each pattern of an engine), ``decisions`` (key, channel, decision, n_findings) and
    ``engine_findings`` (key and the columns of a finding) over ``docs``. SQL reads them lazily, with the plans of the engine.
    """
    spark = docs.sparkSession
    rows = [(p.id, p.category, p.severity, p.layer, list(p.channel), list(p.keywords), list(p.regex), p.negation_immune) for p in engine.patterns]
    schema = "id string, category string, severity string, layer string, channel array<string>, keywords array<string>, regex array<string>, negation_immune boolean"
    spark.createDataFrame(rows, schema).createOrReplaceTempView("patterns")
    given = F.lit(channel) if isinstance(channel, str) else channel
    scanned = engine.scan(docs.select(F.col(key).alias("key"), F.col(text).alias("text"), given.alias("channel")), "text", channel if isinstance(channel, str) else F.col("channel"))
    scanned.select("key", "channel", "decision", F.size("findings").alias("n_findings")).createOrReplaceTempView("decisions")
    # explode_outer keeps the optimiser from computing the findings twice
    scanned.select("key", F.explode_outer("findings").alias("f")).where("f is not null").select("key", "f.*").createOrReplaceTempView("engine_findings")


def register_receipts(calls: DataFrame, ts: Column, **lists) -> None:
    """Register the view ``receipts``: those of the decisions on ``calls`` (see toolcalls.decide for ``lists``)."""
    receipts(decide(calls, **lists), ts).createOrReplaceTempView("receipts")
