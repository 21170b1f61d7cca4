"""An inverted index of clean texts with places, by which keywords of new cards are looked up without reading the texts again.

A posting is a word (a run of letters and digits, lower-cased) of a text with what stands around it: the signs before it, the word and
the signs before that, and the signs behind. A keyword is such words too. All its words but the first are sought by equality, and its first
and last are held against what the posting says of its neighbours, so a lookup joins the keyword's words with the postings
and counts places where all of them follow each other. A keyword of one word may be the end of a longer one; those are
found among the distinct words. Results are those of cards.clean_corpus_hits.

Postings are as many as words and are written once, sorted by word, so that a lookup reads the row groups of its words.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .keywords import MOST_KEYWORDS, keyword_hits

_SIGNS, _WORD = r"[^\p{L}\p{N}]", r"[\p{L}\p{N}]"


@dataclass(frozen=True)
class WordIndex:
    """postings (doc, pos, word, gap, before, before_gap, behind) and words (word, n_docs)."""

    postings: DataFrame
    words: DataFrame


def build_index(clean: DataFrame, text: str, doc_id: str, path: str | None = None) -> WordIndex:
    """Index the texts of ``clean`` in the folder ``path``, or for a single lookup nowhere; ``doc_id`` tells its rows apart, null texts hold nothing."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    # the signs behind the last word are a piece without a word
    pieces = F.concat(F.regexp_extract_all(low, F.lit(f"{_SIGNS}*{_WORD}+"), F.lit(0)), F.array(F.regexp_extract(low, rf"{_SIGNS}*\z", 0)))
    parts = F.transform(pieces, lambda p: F.struct(F.regexp_extract(p, f"^{_SIGNS}*", 0).alias("gap"), F.regexp_extract(p, f"{_WORD}*$", 0).alias("word")))
    around = F.transform(F.array(parts), lambda ps: F.transform(ps, lambda p, i: F.struct(
        p["word"].alias("word"), p["gap"].alias("gap"), F.coalesce(F.get(ps, i - 1)["word"], F.lit("")).alias("before"),
        F.coalesce(F.get(ps, i - 1)["gap"], F.lit("")).alias("before_gap"), F.coalesce(F.get(ps, i + 1)["gap"], F.lit("")).alias("behind"),
    )))[0]
    postings = clean.select(F.col(doc_id).alias("doc"), F.posexplode(around).alias("pos", "p")).select("doc", "pos", "p.*").where("word <> ''")
    if path is None:
        return WordIndex(postings, postings.groupBy("word").agg(F.count_distinct("doc").alias("n_docs")))
    postings.repartitionByRange("word").sortWithinPartitions("word").write.mode("overwrite").parquet(f"{path}/postings")
    spark = clean.sparkSession
    kept = spark.read.parquet(f"{path}/postings")
    kept.groupBy("word").agg(F.count_distinct("doc").alias("n_docs")).write.mode("overwrite").parquet(f"{path}/words")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> WordIndex:
    return WordIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/words"))


def split_keyword(keyword: str) -> tuple[list[str], list[str]]:
    """(words, gaps) of a lower-case keyword: the signs before each word and, last, those behind."""
    words, gaps, inside = [], [""], False
    for c in keyword:
        if unicodedata.category(c)[0] in "LN":
            if not inside:
                words.append("")
            words[-1] += c
            inside = True
        else:
            if inside:
                gaps.append("")
            gaps[-1] += c
            inside = False
    return words, gaps + [""] * inside


def keyword_docs(index: WordIndex, keywords: list[str]) -> DataFrame:
    """(keyword, n_docs): keywords that indexed texts hold, and how many. A keyword without a letter or digit is an error."""
    wanted = sorted({k.lower() for k in keywords if k})
    if len(wanted) > MOST_KEYWORDS:
        raise ValueError(f"{len(wanted)} keywords; at most {MOST_KEYWORDS}")
    rows, ends = [], []
    for keyword in wanted:
        words, gaps = split_keyword(keyword)
        if not words:
            raise ValueError(f"no word in the keyword {keyword!r}")
        if len(words) == 1:
            (rows if gaps[0] else ends).append((keyword, 1, 1, words[0], gaps[0], None, None, gaps[1]))
        for i in range(1, len(words)):
            first, last = i == 1, i == len(words) - 1
            rows.append((keyword, len(words) - 1, i, words[i], gaps[i], words[0] if first else None, gaps[0] if first else None, gaps[-1] if last else ""))
    spark = index.postings.sparkSession
    schema = "keyword string, n int, i int, word string, gap string, first string, first_gap string, last_gap string"
    sought = spark.createDataFrame(rows, schema)
    if ends:
        # words that end like a keyword of one word: a hit inside a word must reach its end
        longer = index.words.select("word", F.explode(keyword_hits(F.col("word"), sorted({e[3] for e in ends}))).alias("end"))
        loose = spark.createDataFrame([(e[0], e[3], e[7]) for e in ends], "keyword string, end string, last_gap string").join(longer, "end")
        none = F.lit(None).cast("string")
        sought = sought.unionByName(loose.select("keyword", F.lit(1).alias("n"), F.lit(1).alias("i"), "word", F.lit("").alias("gap"), none.alias("first"), none.alias("first_gap"), "last_gap"))
    k, p = sought.alias("k"), index.postings.alias("p")
    one = F.col("k.n") == 1
    alone = one & F.col("k.first").isNull()  # a keyword of one word: its signs end what stands before
    gap = F.when(alone, F.endswith("p.gap", F.col("k.gap"))).otherwise(F.col("p.gap") == F.col("k.gap"))
    before = F.col("k.first").isNull() | F.when(
        F.col("k.first_gap") == "", F.endswith("p.before", F.col("k.first"))
    ).otherwise((F.col("p.before") == F.col("k.first")) & F.endswith("p.before_gap", F.col("k.first_gap")))
    met = k.join(p, F.col("k.word") == F.col("p.word")).where(gap & before & F.startswith("p.behind", F.col("k.last_gap")))
    places = met.groupBy("keyword", "n", "doc", (F.col("pos") - F.col("i")).alias("start")).agg(F.count_distinct("i").alias("found")).where("found = n")
    return places.groupBy("keyword").agg(F.count_distinct("doc").alias("n_docs"))
