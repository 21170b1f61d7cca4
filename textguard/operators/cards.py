"""Pattern cards (candidate rules): lint, dedup by signature, statistics.

A card is a row (id, name, category, severity, channel array, keywords array, regex array).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from ..sources.files_by_row import write_files
from .keywords import keyword_hits, usable_keywords

ID_SHAPE = r"^[A-Z]{2,}(-[A-Z]+)*-[0-9]+$"
SEVERITIES = ["critical", "high", "medium", "low"]
#: Characters that make a short keyword specific.
PATH_SIGNS = r"[/.\\*~_-]"
#: Words too common for a keyword, and the least number of examples that a card of the third form brings of each kind.
COMMON_WORDS = [
    "the", "and", "for", "with", "init", "docs", "doc", "code", "data", "file", "files", "agent", "agents", "note", "notes", "group", "path",
    "env", "key", "name", "type", "user", "tool", "tools", "api", "run", "get", "set", "add", "use", "ai",
]
LEAST_EXAMPLES = 8


def _compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def compile_flags(patterns: Column) -> Column:
    """For each regex of an array whether it compiles; a null array gives an empty one."""

    def check(lists: pd.Series) -> pd.Series:
        return lists.map(lambda found: [] if found is None else [p is not None and _compiles(p) for p in found])

    return F.pandas_udf(check, ArrayType(BooleanType()))(patterns)


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def lint(cards: DataFrame, denied: list[str] = (), categories: list[str] | None = None, clean: DataFrame | None = None) -> DataFrame:
    """``cards`` with violations: the names of all faults, in a fixed order.

    A column ``description`` is looked at where it exists, ``fixture_positive``, ``fixture_negative`` and ``validation_summary`` where the first does. With
    ``categories`` there is a column ``warnings`` besides, for categories outside them. ``clean`` (keyword, n_docs) are the keywords that clean texts hold, see
    clean_corpus_hits: those of four characters or more are faults.
    """
    has = set(cards.columns)
    bad_keyword = lambda test: F.exists(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: F.coalesce(test(F.trim(k)), F.lit(True)))
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    rules = {
        "id_shape": ~F.coalesce(F.rlike("id", F.lit(ID_SHAPE)), F.lit(False)),
        "name_empty": _blank(F.col("name")),
        "name_is_id": F.coalesce(F.trim("name") == F.col("id"), F.lit(False)),
        "category_empty": _blank(F.col("category")),
        "severity": ~F.coalesce(F.lower(F.trim("severity")).isin(SEVERITIES), F.lit(False)),
        "channel_empty": empty("channel"),
        "keywords_empty": empty("keywords"),
        "regex_empty": empty("regex"),
        "regex_broken": F.exists(compile_flags(F.col("regex")), lambda ok: ~ok),
        "keyword_punctuation": bad_keyword(lambda k: ~F.rlike(k, F.lit(r"[\p{L}\p{N}]"))),
        "keyword_short": bad_keyword(lambda k: (F.char_length(k) < 4) & ~F.rlike(k, F.lit(PATH_SIGNS))),
        "keyword_denied": bad_keyword(lambda k: F.lower(k).isin([d.lower() for d in denied])) if denied else F.lit(False),
    }
    if "description" in has:
        rules["keyword_common"] = bad_keyword(lambda k: F.lower(k).isin(COMMON_WORDS))
        rules["description_empty"] = _blank(F.col("description"))
    if "fixture_positive" in has:
        few = lambda c: F.coalesce(F.size(c), F.lit(0)) < LEAST_EXAMPLES
        rules |= {"examples_positive": few("fixture_positive"), "examples_negative": few("fixture_negative"), "summary_missing": _blank(F.col("validation_summary").cast("string"))}
    found = cards.withColumn("violations", F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()])))
    if categories is not None:
        found = found.withColumn("warnings", F.array_compact(F.array(F.when(~_blank(F.col("category")) & ~F.col("category").isin(categories), F.lit("category_unknown")))))
    if clean is None:
        return found
    held = clean.where(F.char_length(F.trim("keyword")) >= 4).select(F.lower(F.trim("keyword")).alias("keyword")).distinct()
    bad = usable_keywords(cards).select("id", F.trim("keyword").alias("keyword")).join(held, "keyword", "left_semi").select("id").distinct().withColumn("_held", F.lit(True))
    joined = found.join(bad, "id", "left")
    marked = F.when(F.col("_held"), F.concat("violations", F.array(F.lit("keyword_in_clean_texts")))).otherwise(F.col("violations"))
    return joined.select(*[marked.alias(c) if c == "violations" else F.col(f"`{c}`") for c in found.columns])


def clean_corpus_hits(clean: DataFrame, text: str, keywords: list[str]) -> DataFrame:
    """(keyword, n_docs): keywords that texts known to be clean hold. Counts are combined before they are shuffled."""
    return clean.select(F.explode(keyword_hits(F.col(text), keywords)).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n_docs"))


def too_general(clean: DataFrame, text: str, keywords: list[str], share: float = 0.01) -> list[str]:
    """Keywords that more than ``share`` of the clean texts hold: the denylist of an engine, made by a rule. It is no longer than ``keywords``."""
    total = clean.count()
    return sorted(r["keyword"] for r in clean_corpus_hits(clean, text, keywords).where(F.col("n_docs") > share * total).collect())


def signature(patterns: Column) -> Column:
    """Digest of the sorted, trimmed regexes of a card."""
    return F.sha2(F.array_join(F.array_sort(F.transform(patterns, lambda p: F.trim(p))), "\n"), 256)


def dedup(cards: DataFrame, live: DataFrame) -> DataFrame:
    """(id, duplicate_of): of the cards with equal signatures the smallest id stays (null), unless a live card has that signature; then that one.

    Smallest ids are combined before the shuffle, so that a signature of very many cards is no hot
    group; cards without a regex are no duplicates.
    """
    marked = cards.select("id", F.when(F.size("regex") > 0, signature(F.col("regex"))).alias("sig"))
    kept = marked.where("sig is not null").groupBy("sig").agg(F.min("id").alias("first"))
    known = live.where(F.size("regex") > 0).groupBy(signature(F.col("regex")).alias("sig")).agg(F.min("id").alias("live"))
    of = F.coalesce("live", "first")
    joined = marked.join(kept.join(known, "sig", "left"), "sig", "left")
    return joined.select("id", F.when(of != F.col("id"), of).alias("duplicate_of"))


def stats(cards: DataFrame) -> DataFrame:
    """Cards, keywords and regexes by category and severity, with totals ('all')."""
    named = cards.select("category", "severity", F.size("keywords").alias("k"), F.size("regex").alias("r"))
    grouped = named.rollup("category", "severity").agg(F.count("*").alias("cards"), F.sum("k").alias("keywords"), F.sum("r").alias("regexes"), F.grouping_id().alias("g"))
    return grouped.select(F.when(F.col("g") > 1, "all").otherwise(F.col("category")).alias("category"), F.when(F.col("g") > 0, "all").otherwise(F.col("severity")).alias("severity"), "cards", "keywords", "regexes")


def slug(name: Column) -> Column:
    """Lower-case words of a name joined by hyphens, at most 60 characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, 60)


def exported(cards: DataFrame, before: DataFrame, today: Column) -> DataFrame:
    """(folder, file, date_added, body): the file of each card, by category; a card whose file was exported ``before`` (file, date_added) keeps its date.

    Null ids, names, categories and severities take the words UNKNOWN, unnamed, uncategorized and medium.
    """
    filled = cards.select(F.coalesce("id", F.lit("UNKNOWN")).alias("id"), F.coalesce("name", F.lit("unnamed")).alias("name"), F.coalesce("category", F.lit("uncategorized")).alias("category"), F.coalesce("severity", F.lit("medium")).alias("severity"), "channel", "keywords", "regex")
    folder = F.replace("category", F.lit("_"), F.lit("-"))
    placed = filled.select(folder.alias("folder"), F.concat("id", F.lit("-"), slug(F.col("name")), F.lit(".json")).alias("file"), F.struct("id", "name", F.lit("1.0").alias("version"), "category", "severity", F.col("channel").alias("channels"), "keywords", "regex").alias("card"))
    known = before.groupBy("file").agg(F.min("date_added").alias("old"))
    dated = placed.join(known, "file", "left").withColumn("date_added", F.coalesce("old", today))
    return dated.select("folder", "file", "date_added", F.to_json(F.col("card").withField("date_added", F.col("date_added"))).alias("body"))


def write_export(files: DataFrame, path: str) -> None:
    """Write each exported card to its own file, folder/file below ``path``: all of them or, if the job fails, none."""
    write_files(files.select("folder", "file", "body"), path)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """(file, date_added) of the cards that lie below ``path``; a file that is no card has no date."""
    found = spark.read.text(f"{path}/*/*.json", wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.get_json_object("value", "$.date_added").alias("date_added"))
    return found.select(F.url_decode("file").alias("file"), "date_added")


def manifest(files: DataFrame) -> DataFrame:
    """(folder, n): cards by folder, and over all ('all')."""
    return files.rollup("folder").agg(F.count("*").alias("n"), F.grouping("folder").alias("g")).select(F.when(F.col("g") == 1, "all").otherwise(F.col("folder")).alias("folder"), "n")


def lint_counts(linted: DataFrame, by: str) -> DataFrame:
    """(by, passed, failed) from cards with violations."""
    return linted.groupBy(by).agg(F.count_if(F.size("violations") == 0).alias("passed"), F.count_if(F.size("violations") > 0).alias("failed"))
