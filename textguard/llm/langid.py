"""Language identification by rank-order n-gram profiles.

A language's profile is its most frequent letter n-grams in order of frequency. A document gets
the language whose profile has the smallest out-of-place distance: the sum, over the document's
own most frequent n-grams, of how far each one's rank is from its rank in the profile, or the
profile's length where it is missing.

Defined results: null text, empty text and text without a letter are ``und`` with score 0; ties
between languages go to the alphabetically first; in a profile n-grams of equal frequency sort by
code point, in a document they share the mean of their ranks; repeated rows get equal results and
count once in a profile; other columns are ignored; without any labelled row everything is ``und``.

Scale: learning reads the labelled rows, keeps a bounded random sample of different texts for each
language and sums n-gram counts in a shuffle; only the finished profiles reach the driver, one for
each of at most ``most_languages`` languages (the commonest; a dirty column may hold more values).
Prediction is one pass without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
_GAP = 1  # stands for everything that is no letter; a letter is its code point plus 1
_BITS = 21


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point, its symbol: the gap unless it is a letter."""
    flags = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return np.where(flags, np.arange(0x110000, dtype=np.int64) + 1, _GAP)


def ranked_ngrams(text: str | None, size: int | None, longest: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The ``size`` most frequent n-grams (all for None; n from 1 to ``longest``, at most 3) and their counts.

    n-grams lie inside one word, which has a gap on either side. They are packed into integers.
    """
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    symbols = np.concatenate(([_GAP], _letters()[raw], [_GAP]))
    gap = symbols == _GAP
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]
    keep[0] = True
    symbols = symbols[keep]
    if len(symbols) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    grams = [symbols[symbols != _GAP]]
    if longest > 1:
        grams.append(symbols[:-1] << _BITS | symbols[1:])
    if longest > 2:
        three = symbols[:-2] << 2 * _BITS | symbols[1:-1] << _BITS | symbols[2:]
        grams.append(three[symbols[1:-1] != _GAP])
    ordered = np.sort(np.concatenate(grams))
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    counts = np.diff(starts, append=len(ordered))
    best = np.argsort(-counts, kind="stable")[:size]
    return ordered[starts][best], counts[best]


@dataclass(frozen=True)
class RankProfiles:
    """languages; for each known n-gram (sorted) its rank in each language, ``size`` where missing."""

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    size: int
    longest: int

    def predict(self, text: str | None) -> tuple[str, float]:
        found, counts = ranked_ngrams(text, self.size, self.longest)
        if not len(found) or not self.languages:
            return UNKNOWN, 0.0
        own = np.empty(len(found))  # n-grams of equal count share the mean of their ranks
        edges = np.flatnonzero(np.concatenate(([True], counts[1:] != counts[:-1], [True])))
        for a, b in zip(edges[:-1], edges[1:]):
            own[a:b] = (a + b - 1) / 2
        at = np.minimum(np.searchsorted(self.grams, found), len(self.grams) - 1)
        hit = self.grams[at] == found
        ranks = self.ranks[:, at[hit]]
        out = np.where(ranks < self.size, np.minimum(np.abs(ranks - own[hit]), self.size), self.size).sum(axis=1) + self.size * (~hit).sum()
        best = int(np.argmin(out))
        return self.languages[best], float(1 - out[best] / (self.size * len(found)))


def fit_profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", size: int = 400, longest: int = 3, docs_per_language: int = 4000, most_languages: int = 500, seed: int = 7) -> RankProfiles:
    """Learn from rows with text and language; about ``docs_per_language`` different texts of each language, drawn by a hash of the text, are used; more than ``most_languages`` languages are an error."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    different = rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("n")).limit(most_languages + 1)
    totals = {r["lang"]: r["n"] for r in different.collect()}
    if len(totals) > most_languages:
        raise ValueError(f"more than {most_languages} languages; raise the bound")
    if not totals:
        return RankProfiles([], np.empty(0, np.int64), np.empty((0, 0)), size, longest)
    share = F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, min(1.0, docs_per_language / n))])
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.col("text")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(drawn < F.try_element_at(share, F.col("lang"))).dropDuplicates(["lang", "text"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, Counter] = {}
        for batch in batches:
            for doc, language in zip(batch["text"], batch["lang"]):
                grams, counts = ranked_ngrams(doc, None, longest)
                sums.setdefault(language, Counter()).update(dict(zip(grams.tolist(), counts.tolist())))
                if len(sums[language]) > 500_000:
                    yield pd.DataFrame([(language, g, n) for g, n in sums.pop(language).items()], columns=["lang", "gram", "n"])
        for language, counter in sums.items():
            yield pd.DataFrame([(language, g, n) for g, n in counter.items()], columns=["lang", "gram", "n"])

    summed = sample.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.asc("gram"))
    top = summed.select("lang", "gram", F.row_number().over(order).alias("rank")).where(F.col("rank") <= size).collect()
    languages = sorted({r["lang"] for r in top})
    grams = np.array(sorted({r["gram"] for r in top}), np.int64)
    ranks = np.full((len(languages), len(grams)), size, np.float64)
    for r in top:
        ranks[languages.index(r["lang"]), np.searchsorted(grams, r["gram"])] = r["rank"] - 1
    return RankProfiles(languages, grams, ranks, size, longest)


def predict_language(text: Column, profiles: RankProfiles) -> Column:
    """Struct (lang_pred string, score double) for a text column."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([profiles.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict(text)
