"""Keyword lane: many keywords in many texts, with one automaton pass per text."""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Most keywords that are sent to tasks with the automaton; more are refused, not dropped.
MOST_KEYWORDS = 100_000


@lru_cache(8)
def automaton_of(words: tuple[str, ...]) -> ahocorasick.Automaton:
    """Automaton of words, built once in each Python worker."""
    automaton = ahocorasick.Automaton()
    for word in words:
        automaton.add_word(word, word)
    automaton.make_automaton()
    return automaton


def keywords_in(text: str | None, automaton: ahocorasick.Automaton) -> list[str]:
    """Sorted distinct keywords in lower-case ``text``.

    The left edge of a hit is open; it fails only if its last and the next character are both
    letters or digits.
    """
    found = set()
    for end, word in automaton.iter(text) if text else ():
        after = text[end + 1 : end + 2]
        if not (word[-1].isalnum() and after.isalnum()):
            found.add(word)
    return sorted(found)


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """Array of the keywords that ``text`` holds; null and empty texts hold none."""
    words = tuple(sorted({k.lower() for k in keywords if k}))
    if len(words) > MOST_KEYWORDS:
        raise ValueError(f"{len(words)} keywords; at most {MOST_KEYWORDS}")
    if not words:
        return F.array().cast("array<string>")

    def search(texts: pd.Series) -> pd.Series:
        automaton = automaton_of(words)
        return texts.map(lambda t: keywords_in(t, automaton))

    return F.pandas_udf(search, ArrayType(StringType()))(F.lower(F.coalesce(text, F.lit(""))))


def usable_keywords(cards: DataFrame, denied: DataFrame | None = None) -> DataFrame:
    """(id, keyword) of all cards, lower-cased, without denied ones."""
    rows = cards.select("id", F.explode("keywords").alias("k")).select("id", F.lower("k").alias("keyword")).where("keyword <> ''").distinct()
    return rows if denied is None else rows.join(denied.select(F.lower("keyword").alias("keyword")), "keyword", "left_anti").select("id", "keyword")
