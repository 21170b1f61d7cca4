"""File sources and line-log sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders and kinds of file that a walk through a source tree passes over, and its largest file.
SKIPPED_FOLDERS = [
    ".git", "node_modules", "__pycache__", ".venv", "venv", ".env", "vendor", "dist", "build",
    ".next", ".nuxt", "coverage", ".tox", ".mypy_cache", ".pytest_cache", "egg-info",
]
BINARY_KINDS = [
    "png", "jpg", "jpeg", "gif", "bmp", "ico", "svg", "webp", "mp3", "mp4", "wav", "avi", "mov", "mkv", "webm",
    "zip", "tar", "gz", "bz2", "xz", "7z", "rar", "exe", "dll", "so", "dylib", "o", "a",
    "woff", "woff2", "ttf", "eot", "otf", "pyc", "pyo", "class", "jar", "pdf", "doc", "docx", "xls", "xlsx",
    "sqlite", "db", "sqlite3", "DS_Store",
]
LARGEST_FILE = 1_000_000


def wanted_file(path: Column) -> Column:
    """Whether no folder of ``path`` is a skipped one and its kind is not binary."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    skipped = F.exists(folders, lambda f: f.isin(SKIPPED_FOLDERS) | F.endswith(f, F.lit(".egg-info")))
    return ~skipped & ~F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin([k.lower() for k in BINARY_KINDS])


def read_tree(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of the text files below ``folder``; bytes that are no UTF-8 are dropped; empty files give no row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    small = files.where((F.col("length") <= LARGEST_FILE) & wanted_file(F.col("path")))
    raw = F.col("content").cast("string")
    # bad bytes become replacement characters, which go; those that the file has itself stand aside meanwhile
    bad, aside = F.lit("\ufffd"), F.lit("\uffff\ufffe\uffff")
    readable = F.when(F.is_valid_utf8(raw), raw).otherwise(F.replace(F.replace(F.make_valid_utf8(F.replace(raw, bad, aside)), bad, F.lit("")), aside, bad))
    return small.select("path", readable.alias("text"))


def read_table(spark: SparkSession, folder: str, name: str, small: int = 32 << 20) -> DataFrame:
    """The Parquet table ``name`` below ``folder``.

    A table of few bytes is dealt out to all cores, as its file may be a single row group, which one
    task reads; larger tables are read as they lie.
    """
    path = f"{folder}/{name}.parquet"
    size = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.sum("length")).first()[0]
    rows = spark.read.parquet(path)
    return rows.repartition(spark.sparkContext.defaultParallelism) if size is not None and size <= small else rows


def clean_subtitles(text: Column) -> Column:
    """Spoken text of subtitles: no blank lines, numbers, time lines or tags; lines joined by one space."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda line: F.trim(line))
    spoken = F.filter(lines, lambda line: (line != "") & ~F.rlike(line, F.lit(r"^[0-9]+$")) & ~F.contains(line, F.lit("-->")))
    return F.array_join(F.transform(spoken, lambda line: F.regexp_replace(line, "<[^>]+>", "")), " ")


def read_csv_log(spark: SparkSession, path: str) -> DataFrame:
    """(ip, user_agent) of a CSV log whose headers may be spelled in several ways; rows without an address go."""
    rows = spark.read.option("header", True).csv(path)
    named = {c.strip().lower(): c for c in rows.columns}
    pick = lambda *names: F.coalesce(*[F.col(f"`{named[n]}`") for n in names if n in named], F.lit(None).cast("string"))
    return rows.select(F.trim(pick("ip", "clientip", "client_ip")).alias("ip"), F.coalesce(pick("user_agent", "useragent", "ua"), F.lit("")).alias("user_agent")).where("ip <> ''")


def append_log(rows: DataFrame, path: str, ts: str = "ts") -> None:
    """Append rows as JSON lines, in one folder per day."""
    rows.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of append_log; broken lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_cards(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Candidate cards of JSON files: an array of cards, one card, or an object with ``patterns``."""
    raw = spark.read.text(path, wholetext=True)
    listed = F.coalesce(F.from_json(F.get_json_object("value", "$.patterns"), f"array<struct<{schema}>>"), F.from_json("value", f"array<struct<{schema}>>"))
    return raw.select(F.explode(listed).alias("c")).select("c.*").where("id is not null")


def read_attacks(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, channel, kind, category) of labelled attacks: a JSON object whose list ``attacks`` holds them.

    Without a channel an attack is a message, without a kind ``unspecified``; those without id or text are passed over.
    """
    listed = F.from_json(F.get_json_object("value", "$.attacks"), "array<struct<id: string, text: string, channel: string, kind: string, category: string>>")
    rows = spark.read.text(path, wholetext=True).select(F.explode(listed).alias("a")).select("a.*").where("id is not null and text is not null")
    return rows.withColumns({"channel": F.coalesce("channel", F.lit("message")), "kind": F.coalesce("kind", F.lit("unspecified"))})


#: Kinds of attack whose shape is known; all others are new in meaning.
KNOWN_SHAPES = ["canonical", "paraphrase", "obfuscated", "obfuscated_hardening"]


def attack_segment(kind: Column) -> Column:
    """known_shape or novel_semantic."""
    return F.when(kind.isin(KNOWN_SHAPES), "known_shape").otherwise("novel_semantic")


def read_clean_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(name, text) of the Markdown files of a folder, which are known to be clean."""
    files = spark.read.text(f"{folder}/*.md", wholetext=True)
    return files.select(F.url_decode(F.element_at(F.split(F.input_file_name(), "/"), -1)).alias("name"), F.col("value").alias("text"))
