"""Quality rules on tokeniser fertility.

Public vocabularies cut every word of a document. Three measures follow for each of them:
characters per token, the share of fallback tokens (bytes of characters that the vocabulary does
not know), and the entropy of the document's tokens in bits. Texts outside their group's band are
rejected: symbol noise and tables cut into short tokens, machine strings and foreign scripts fall
back to bytes, repeated text has little entropy. A base filter on words and repetition goes first.

A group is a language, or the script where the language is unknown or has fewer than
``least_group`` different texts. Its band is fitted on all its different texts that pass the base
filter: Tukey's outer fence, ``fence`` spans between the quartiles beyond them. Quartiles shrug off
up to a quarter of bad texts on either side, and as copies of a text count once, a hot group of
copies moves nothing. No label is used. Wide fixed limits of the script hold besides, also where a
group is too small for a fence.

Defined results: null, empty and blank texts have no words, fail the base filter and have null
measures; a script without limits of its own takes ``DEFAULT_BAND``; ties between scripts go to
the first in ``SCRIPTS``; repeated rows and equal texts of a group get equal results; null
languages count as unknown; an empty table gives no rows; other columns are ignored.

Scale: texts are read in one pass without a shuffle, each distinct word of a chunk of documents
being cut once; what is kept of a document is a short row of numbers. Quartiles come from counts
of rounded measures, combined before they are shuffled, so they are exact to the rounding and do
not depend on the order of rows. The vocabulary files are read on the driver and sent with the
tasks (under 2 MB).
"""

from __future__ import annotations

import base64
import binascii
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Vocabulary files by name: pieces with byte fallback, and byte-level pieces of many languages.
VOCABULARIES = {"piece": "/opt/tokenizers/piece_bpe_32k.model", "multi": "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"}
CHUNK_BYTES = 4_000_000
#: Fixed value: the pattern by which a byte-level vocabulary splits text before it joins bytes.
BYTE_LEVEL_SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: First and last code point of scripts.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF)],
    "cyrillic": [(0x400, 0x52F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "thai": [(0xE00, 0xE7F)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
}


@dataclass(frozen=True)
class Band:
    """Fixed limits of a script; entropy in bits a token."""

    least_chars: float
    most_chars: float
    most_fallback: float
    least_entropy: float


DEFAULT_BAND = Band(0.2, 12.0, 0.9, 2.0)
#: Parameters: outer limits; scripts that vocabularies cover well have narrower ones.
BANDS = {
    "latin": Band(1.25, 8.0, 0.10, 3.5),
    "greek": Band(0.6, 6.0, 0.20, 3.0),
    "cyrillic": Band(1.0, 8.0, 0.10, 3.0),
    "han": Band(0.3, 4.0, 0.80, 2.5),
    "kana": Band(0.3, 4.0, 0.60, 2.5),
}
#: Parameters of fences: how many digits measures keep, and the least span between quartiles.
ROUNDING = 3
LEAST_SPAN = {"chars_per_token": 0.02, "fallback_share": 0.01, "token_entropy": 0.1}
SYMBOLS = b"#*$%&|<>"


@lru_cache(1)
def _script_of() -> np.ndarray:
    """For each code point, 1 plus the number of its script for letters, else 0."""
    out = np.zeros(0x110000, np.uint8)
    for number, ranges in enumerate(SCRIPTS.values(), 1):
        for low, high in ranges:
            out[low : high + 1] = [number * chr(i).isalpha() for i in range(low, high + 1)]
    return out


def script(text: str) -> str | None:
    """Script of most letters; None without a letter of a known script."""
    counts = np.bincount(_script_of()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)], minlength=len(SCRIPTS) + 1)[1:]
    return list(SCRIPTS)[int(counts.argmax())] if counts.any() else None


class Pieces:
    """Words cut by a sentencepiece model."""

    def __init__(self, model: bytes):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.processor.vocab_size()
        self.is_fallback = np.fromiter((self.processor.is_byte(i) or self.processor.is_unknown(i) for i in range(size)), bool, size)

    def cut(self, words: list[str]) -> list[list[int]]:
        return self.processor.encode(words, num_threads=1)


class ByteLevel:
    """Words, each after a space, cut by a byte-level vocabulary; tokens that are no whole characters count as fallback."""

    def __init__(self, ranks: bytes):
        known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=known, special_tokens={})
        self.is_fallback = np.zeros(max(known.values()) + 1, bool)
        for token, rank in known.items():
            try:
                token.decode()
            except UnicodeDecodeError:
                self.is_fallback[rank] = True

    def cut(self, words: list[str]) -> list[list[int]]:
        encode = self.encoding.encode_ordinary
        return [encode(" " + w) for w in words]


@lru_cache(8)
def vocabulary(content: bytes) -> Pieces | ByteLevel:
    """Vocabulary of a file's content: rank lines or a sentencepiece model."""
    first = content[: content.find(b"\n") + 1].split()
    try:
        lines = len(first) == 2 and first[1].isdigit() and base64.b64decode(first[0], validate=True) != b""
    except binascii.Error:
        lines = False
    return ByteLevel(content) if lines else Pieces(content)


def repeated_words(numbers: np.ndarray, width: int = 3) -> int:
    """Words inside windows of ``width`` words that are found twice or more."""
    m = len(numbers) - width + 1
    if m < 2:
        return 0
    names = numbers[:m].astype(np.int64)
    for j in range(1, width):
        names = np.unique(names * (int(numbers.max()) + 1) + numbers[j : m + j], return_inverse=True)[1]
    twice = np.bincount(names)[names] > 1
    covered = np.zeros(len(numbers), bool)
    for j in range(width):
        covered[j : m + j] |= twice
    return int(covered.sum())


def measure(texts: list[str | None], vocabularies: list[bytes], least_words: int = 50, most_repeated: int = 50) -> list[tuple]:
    """For each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, script; then for each vocabulary chars_per_token, fallback_share, token_entropy."""
    known: dict[bytes, int] = {}
    raws = [(t or "").encode() for t in texts]
    numbers = []
    for raw in raws:
        words = raw.split()
        for w in words:
            if w not in known:
                known[w] = len(known)
        numbers.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
    spelt = [w.decode() for w in known]
    chars = np.fromiter(map(len, spelt), np.int64, len(spelt))
    cuts = []
    for content in vocabularies:
        own = vocabulary(content)
        cut = own.cut(spelt) if spelt else []
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        cuts.append((sizes, np.fromiter((t for c in cut for t in c), np.int64, int(sizes.sum())), np.cumsum(sizes) - sizes, own.is_fallback))
    out = []
    for text, raw, own in zip(texts, raws, numbers):
        n = len(own)
        lines = [x for x in raw.split(b"\n") if x.strip()]
        repeats = repeated_words(own)
        base_failed = n < least_words or 100 * repeats > most_repeated * n
        word_chars = int(chars[own].sum())
        row = [n, word_chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeats, base_failed, script(text or "")]
        for sizes, flat, begin, is_fallback in cuts:
            lengths = sizes[own]
            total = int(lengths.sum())
            if not total:
                row += [None, None, None]
                continue
            tokens = flat[np.repeat(begin[own] - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)]
            counts = np.unique(tokens, return_counts=True)[1]
            entropy = float(np.log2(total) - (counts * np.log2(counts)).sum() / total)
            row += [word_chars / total, float(is_fallback[tokens].mean()), max(0.0, entropy)]
        out.append(tuple(row))
    return out


_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, script string"
MEASURES = ("chars_per_token", "fallback_share", "token_entropy")


def measures(text: Column, vocabularies: dict[str, str] = VOCABULARIES, least_words: int = 50, most_repeated: int = 50) -> Column:
    """Struct of the base counts, and of each vocabulary's measures (named ``measure_vocabulary``), of a text column."""
    contents = []
    for path in vocabularies.values():
        with open(path, "rb") as f:
            contents.append(f.read())
    kind = _BASE + "".join(f", {m}_{v} double" for v in vocabularies for m in MEASURES)
    names = [c.split()[0] for c in kind.split(", ")]

    @F.pandas_udf(kind)
    def cut(texts: pd.Series) -> pd.DataFrame:
        rows, chunk, size = [], [], 0
        for text in [*texts, ...]:
            if text is ... or size > CHUNK_BYTES:
                rows += measure(chunk, contents, least_words, most_repeated)
                chunk, size = [], 0
            if text is not ...:
                chunk.append(text)
                size += len(text or "")
        return pd.DataFrame(rows, columns=names)

    return cut(text)


def fences(measured: DataFrame, names: list[str], fence: float, least_group: int) -> DataFrame:
    """(band, limits): for each language and script with ``least_group`` different texts a map from each measure to its fences (low, high).

    ``measured`` has lang, script, base_failed, text_hash and the measures. Quartile q is the first rounded value that
    at least a share q of the texts do not exceed.
    """
    texts = measured.where("not base_failed").select("lang", "script", "text_hash", *names).distinct()
    both = F.array(F.concat(F.lit("lang:"), F.col("lang")), F.concat(F.lit("script:"), F.col("script")))
    values = F.array(*[F.struct(F.lit(n).alias("measure"), F.round(n, ROUNDING).alias("value")) for n in names])
    spread = texts.select(F.explode(F.array_compact(both)).alias("band"), F.explode(values).alias("v")).select("band", "v.*")
    counts = spread.groupBy("band", "measure", "value").agg(F.count("*").alias("n"))
    one = Window.partitionBy("band", "measure")
    upto = F.sum("n").over(one.orderBy("value"))
    placed = counts.select("band", "measure", "value", upto.alias("upto"), F.sum("n").over(one).alias("total")).where(F.col("total") >= least_group)
    quartile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("value")))
    cut = placed.groupBy("band", "measure").agg(quartile(0.25).alias("q1"), quartile(0.75).alias("q3"))
    least = F.create_map(*[F.lit(x) for n in names for x in (n, next(w for m, w in LEAST_SPAN.items() if n.startswith(m)))])
    span = F.lit(float(fence)) * F.greatest(F.col("q3") - F.col("q1"), least[F.col("measure")])
    entry = F.struct("measure", F.struct((F.col("q1") - span).alias("low"), (F.col("q3") + span).alias("high")))
    return cut.groupBy("band").agg(F.map_from_entries(F.collect_list(entry)).alias("limits"))


def judge_fertility(docs: DataFrame, text: str = "text", lang: str | None = "lang", doc_id: str = "doc_id", vocabularies: dict[str, str] = VOCABULARIES, bands: dict[str, Band] = BANDS, fence: float = 3.0, least_group: int = 100, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """Per row: doc_id, the base counts and base_failed, kept, rejected_by (first rule that fails), script, band, and the measures of each vocabulary.

    Characters per token must lie between the fences, the fallback share below the upper and the
    entropy above the lower one, for every vocabulary.
    """
    names = [f"{m}_{v}" for v in vocabularies for m in MEASURES]
    language = F.col(lang).cast("string") if lang else F.lit(None).cast("string")
    row = docs.select(F.col(doc_id).alias("doc_id"), language.alias("lang"), F.xxhash64(text).alias("text_hash"), measures(F.col(text), vocabularies, least_words, most_repeated).alias("m"))
    measured = checkpointed(row.select("doc_id", "lang", "text_hash", "m.*"))
    # a row for each language and script: a table of groups, whose size Spark checks before it broadcasts it
    limits = checkpointed(fences(measured, names, fence, least_group))
    of = lambda kind: limits.where(F.startswith("band", F.lit(f"{kind}:"))).select(F.expr(f"substring(band, {len(kind) + 2})").alias(kind), F.col("band").alias(f"{kind}_band"), F.col("limits").alias(f"{kind}_limits"))
    joined = measured.join(of("lang"), "lang", "left").join(of("script"), "script", "left")
    chosen = joined.withColumn("band", F.coalesce("lang_band", "script_band", "script")).withColumn("limits", F.coalesce("lang_limits", "script_limits"))
    fixed = lambda field: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for s, b in bands.items() for x in (s, float(getattr(b, field)))]), F.coalesce("script", F.lit(""))), F.lit(float(getattr(DEFAULT_BAND, field))))
    limit = lambda name, side, field, pick: pick(F.coalesce(F.try_element_at("limits", F.lit(name))[side], fixed(field)), fixed(field))
    faults = [F.when(F.col("base_failed"), "base").when(F.col(names[0]).isNull(), "no token")]
    for name in names:
        if name.startswith("chars_per_token"):
            faults.append(F.when((F.col(name) < limit(name, "low", "least_chars", F.greatest)) | (F.col(name) > limit(name, "high", "most_chars", F.least)), name))
        elif name.startswith("fallback_share"):
            faults.append(F.when(F.col(name) > limit(name, "high", "most_fallback", F.least), name))
        else:
            faults.append(F.when(F.col(name) < limit(name, "low", "least_entropy", F.greatest), name))
    judged = chosen.withColumn("rejected_by", F.coalesce(*faults))
    return judged.select("doc_id", *[c.split()[0] for c in _BASE.split(", ")[:6]], F.col("rejected_by").isNull().alias("kept"), "rejected_by", "script", "band", *names)
