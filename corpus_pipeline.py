"""A corpus pipeline out of the operators in textguard.llm.

documents -> language ID -> SimHash near-dedup -> substring dedup -> mixing -> best-fit packing.
Every stage takes (spark, docs, sf_dir) and works on all documents that the one before kept; all
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.llm import common, langid, mixing, packing, simhash, substring

#: A document is rejected by language ID below this likeness to its best profile. From about 20 words on, random
#: letters reach 0.25 and prose of a language that was not learned 0.36, while documents of learned ones lie above 0.42.
LEAST_LIKENESS = 0.4

#: Fingerprints, seeds and fitted profiles have no equivalent in SQL.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that are like one of the languages learned from the labelled rows.

    Texts that are null or have no letter go; repeated rows and rows with equal ids are judged each
    by its text; an empty table, or one without any labelled row, gives no rows.
    """
    profiles = langid.fit_profiles(docs)
    guess = common.fresh_name(docs, "guess")
    judged = docs.withColumn(guess, langid.predict_language(F.col("text"), profiles))
    return judged.where((F.col(f"{guess}.lang_pred") != langid.UNKNOWN) & (F.col(f"{guess}.score") >= LEAST_LIKENESS)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each SimHash component: the smallest id (a null one last), of equal ids the smallest hash of the text, then of the row.

    Rows that share an id but are no near copies of each other all stay; rows that are equal
    throughout leave one; an empty table gives no rows.
    """
    return simhash.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words that a document with a smaller id has too; n_chars follows the text.

    Null texts stay null, and rows with a null id lose nothing; rows with equal ids lose nothing to
    each other; every row stays, an empty table gives no rows.
    """
    cut = substring.remove_repeats(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw documents so that sources, languages and topics meet their targets.

    Rows with equal ids share their fate; null sources and languages are categories of their own;
    rows without a word are kept where their cell has none; an empty table gives no rows.
    """
    return mixing.mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents, measured in words, into training sequences.

    Each row is packed by itself, whatever its id; rows without a word get one row without a bin;
    pieces of equal length keep the order of the rows; an empty table gives no rows.
    """
    return packing.pack_documents(docs, common.word_count(F.col("text")))


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what a stage kept is stored once, read by the next, and freed after that."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        kept, path = common.store(stage(spark, docs, sf_dir))
        if before:
            common.release(docs, before)
        docs, before = kept, path
    return STAGES[-1][1](spark, docs, sf_dir)
