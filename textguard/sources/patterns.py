"""Pattern database and log sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATTERN_SCHEMA = "id string, name string, category string, severity string, channels array<string>, description string, keywords array<string>, regex array<string>, tier string, negation_immune boolean, retired boolean, _corrupt_record string"

#: Fixed value: a line of an access log. Address and user agent are its groups.
LOG_LINE = r'^(\S+) \S+ \S+ \[[^\]]*\] "[^"]*" \S+ \S+(?: "[^"]*")? "([^"]*)"'


def read_patterns(spark: SparkSession, folder: str, complete: bool = True) -> DataFrame:
    """One row per JSON pattern file below ``folder``; unreadable and, with ``complete``, incomplete files are skipped."""
    rows = spark.read.schema(PATTERN_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)
    whole = rows.where("_corrupt_record is null" + (" and id is not null and name is not null and category is not null and severity is not null" if complete else ""))
    return whole.drop("_corrupt_record").withColumnRenamed("channels", "channel").withColumn("negation_immune", F.coalesce("negation_immune", F.lit(False)))


def search_patterns(patterns: DataFrame, query: str = "", category: str | None = None, severity: str | None = None) -> DataFrame:
    """Patterns of a category and a severity, if given, whose name, description, category or a keyword contains ``query``."""
    for column, value in (("category", category), ("severity", severity)):
        patterns = patterns if value is None else patterns.where(F.col(column) == value)
    q = F.lit(query.lower())
    holds = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), q)
    return patterns.where(holds(F.col("name")) | holds(F.col("description")) | holds(F.col("category")) | F.exists(F.coalesce("keywords", F.array().cast("array<string>")), holds))


def parse_access_log(lines: DataFrame) -> DataFrame:
    """(ip, user_agent) of the column ``value`` of ``lines`` in the common or combined log format; lines of another shape and nulls are skipped."""
    return lines.where(F.rlike("value", F.lit(LOG_LINE))).select(*[F.regexp_extract("value", LOG_LINE, i).alias(c) for i, c in enumerate(("ip", "user_agent"), 1)])


def read_access_log(spark: SparkSession, path: str) -> DataFrame:
    """parse_access_log of text files."""
    return parse_access_log(spark.read.text(path))
