"""Text normalisation: native folds first, one Arrow UDF for what Spark has no built-in for."""

from __future__ import annotations

import base64
import binascii
import html
import re
import sys
import unicodedata
from functools import lru_cache
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters that render as nothing.
INVISIBLE = r"[\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}\x{00AD}\x{034F}\x{061C}\x{2028}\x{2029}\x{E0001}-\x{E007F}]"
#: Digits and signs that stand for letters.
LEET = ("013457@$!", "oieastasi")
#: Look-alike letters of other scripts and the Latin letters they imitate: Cyrillic, Ukrainian, Armenian, Georgian, Greek, full width.
LOOKALIKE_PAIRS = {
    "АВСЕНКМОРТХ": "ABCEHKMOPTX",
    "аеорсух": "aeopcyx",
    "ІіЇїЄєҐґ": "IiIiEeGg",
    "ՈՍ": "OS",
    "ქ": "K",
    "ΑΒΕΗΙΚΜΝΟΡΤΧΖ": "ABEHIKMNOPTXZ",
    "αεορυ": "aeopu",
    "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ": "abcdefghijklmnopqrstuvwxyz",
}
LOOKALIKES = "".join(LOOKALIKE_PAIRS), "".join(LOOKALIKE_PAIRS.values())
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROT13 = (LOWER + UPPER, LOWER[13:] + LOWER[:13] + UPPER[13:] + UPPER[:13])
#: Views besides the plain text are only made up to this length.
VIEW_LIMIT = 2000
#: Sign between views; no text keeps it.
VIEW_MARK = "\x1e"
SEPARATOR = f" {VIEW_MARK} "


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE, "")


def fold_lookalikes(text: Column) -> Column:
    return F.translate(text, *LOOKALIKES)


def fold_leet(text: Column) -> Column:
    return F.translate(text, *LEET)


def rot13(text: Column) -> Column:
    return F.translate(text, *ROT13)


def collapse_whitespace(text: Column) -> Column:
    """Blanks other than newlines become one space; single newlines stay; ends are trimmed."""
    plain = F.regexp_replace(F.regexp_replace(text, r"[\t\r\x0B\f]", " "), " {2,}", " ")
    return F.regexp_replace(plain, r"^\s+|\s+$", "")


def _base64_segment(match: re.Match) -> str:
    raw = match.group(0)
    try:
        found = base64.b64decode(raw + "=" * (-len(raw) % 4)).decode("utf-8", "ignore")
    except (binascii.Error, ValueError):
        return raw
    return found if len(found) > 4 and found.isprintable() else raw


_FOLDED, _FOLDS = re.compile(f"[{LOOKALIKES[0]}]"), str.maketrans(*LOOKALIKES)


@lru_cache(1)
def _movable() -> list[tuple[int, int]]:
    """Ranges of the look-alikes and of the characters that NFKC changes or that may join the one before (those with a combining class, and second parts of compositions)."""
    moved = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3)) | set(map(ord, LOOKALIKES[0]))  # vowels and finals of Hangul join too
    for code in range(128, sys.maxunicode + 1):
        char = chr(code)
        if unicodedata.combining(char) or not 0xD800 <= code < 0xE000 and unicodedata.normalize("NFKC", char) != char:
            moved.add(code)
        parts = unicodedata.decomposition(char).split()
        if len(parts) == 2 and parts[0][0] != "<":
            moved.add(int(parts[1], 16))
    ordered = sorted(moved)
    return list(zip([c for c in ordered if c - 1 not in moved], [c for c in ordered if c + 1 not in moved]))


def _span(first: int, last: int) -> str:
    return rf"\x{{{first:X}}}-\x{{{last:X}}}"


def decodable() -> str:
    """What a text must hold for decode_layers to change it: entities, percent codes, hex escapes, long runs, and ``_movable`` characters.

    Read by Java and RE2 alike; ``is_decodable`` says the same faster.
    """
    return rf"&[#a-zA-Z]|%[0-9A-Fa-f]{{2}}|\\x[0-9A-Fa-f]{{2}}|[A-Za-z0-9+/]{{20,}}|[{''.join(_span(*r) for r in _movable())}]"


def _halved(ranges: list[tuple[int, int]]) -> str:
    """A class of ranges for Java, which tries those of a class one after the other for each character: here they stand
    inside halves and halves of halves, so that a character meets only the ranges of those it lies in."""
    if len(ranges) <= 4:
        return f"[{''.join(_span(*r) for r in ranges)}]"
    parts = ranges[: len(ranges) // 2], ranges[len(ranges) // 2 :]
    return "[" + "".join(f"[{_span(part[0][0], part[-1][1])}&&{_halved(part)}]" for part in parts) + "]"


@lru_cache(1)
def _decodable_signs() -> str:
    """``decodable()`` but for the long runs; of most characters one look tells that they are none of its."""
    return rf"[&%\\](?:(?<=&)[#a-zA-Z]|(?<=%)[0-9A-Fa-f]{{2}}|(?<=\\)x[0-9A-Fa-f]{{2}})|[{_span(128, sys.maxunicode)}&&{_halved(_movable())}]"


#: The long runs of ``decodable()``; Java keeps single letters in a table, but not ranges.
_LONG_RUN = f"[{LOWER}{UPPER}0123456789+/]{{20}}"


def is_decodable(text: Column) -> Column:
    """Whether ``decodable()`` matches, by regexes that Java evaluates fast."""
    return F.rlike(text, F.lit(_decodable_signs())) | F.rlike(text, F.lit(_LONG_RUN))


def decode_layers(text: str | None, passes: int = 3) -> str | None:
    """NFKC and look-alikes; then entities, percent codes, hex escapes and base64 runs until nothing changes (at most ``passes`` times)."""
    if text is None:
        return None
    text = unicodedata.normalize("NFKC", text)
    if _FOLDED.search(text):
        text = text.translate(_FOLDS)
    for _ in range(passes):
        before = text
        if "&" in text:
            text = html.unescape(text)
        if re.search("%[0-9A-Fa-f]{2}", text):
            text = unquote(text)
        text = re.sub(r"\\x([0-9A-Fa-f]{2})", lambda m: chr(int(m.group(1), 16)), text)
        text = re.sub(r"[A-Za-z0-9+/]{20,}={0,2}", _base64_segment, text)
        if text == before:
            break
    return text


#: Words spelt with a sign or a space between their letters (three at least), and what a text must hold to have one.
_JOINED = re.compile(r"\b[a-zA-Z](?:[.\-_][a-zA-Z]){2,}\b")
_SPACED = re.compile(r"(?<!\w)(?:[a-zA-Z] ){2,}[a-zA-Z](?!\w)")
_OUTSIDE = r"[^\p{L}\p{N}_]"
SPELT = rf"(?:^|{_OUTSIDE})(?:[a-zA-Z](?:[.\-_][a-zA-Z]){{2,}}|(?:[a-zA-Z] ){{2,}}[a-zA-Z])(?:$|{_OUTSIDE})"


def join_letters(text: str | None) -> str | None:
    """Words spelt with signs or single spaces between their letters drawn together; longer white space ends a word and becomes one space."""
    if text is None:
        return None
    text = _JOINED.sub(lambda m: re.sub(r"[.\-_]", "", m.group(0)), text)
    return " ".join(_SPACED.sub(lambda m: m.group(0).replace(" ", ""), part) for part in re.split(r"\s{2,}", text))


#: What a text must hold for join_letters to draw letters together once leet signs are letters: more than SPELT, but tried at few places.
_LETTER, _SIGN = f"[a-zA-Z{LEET[0]}]", r"[.\-_ ]"
_MAYBE_SPELT = rf"{_SIGN}{_LETTER}{_SIGN}{_LETTER}(?!{_LETTER})(?<=(?<!{_LETTER}){_LETTER}{_SIGN}{_LETTER}{_SIGN}{_LETTER})"
#: Characters that go or become spaces, as Java finds them fast.
_GOING = rf"[{VIEW_MARK}{_span(0xAD, 0xE007F)}&&[{VIEW_MARK}{INVISIBLE[1:]}]"
_PYTHON_INVISIBLE = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m.group(1), 16):08X}", INVISIBLE))
_LEET_SIGNS = str.maketrans(*LEET)


def unwrap(text: str) -> str:
    """A text without invisible characters, decoded, with leet signs as letters and spelt-out words joined.

    Leet signs become letters before spelt-out words are joined, so that signs inside such words count too.
    """
    return join_letters(decode_layers(_PYTHON_INVISIBLE.sub("", text.replace(VIEW_MARK, " "))).translate(_LEET_SIGNS))


def unwrapped(text: Column) -> Column:
    """``unwrap`` as a column: an Arrow UDF for the texts that hold something to strip, decode or join; to the others only leet signs matter."""

    def each(texts: pd.Series) -> pd.Series:
        return texts.map(unwrap, na_action="ignore")

    needed = F.rlike(text, F.lit(_GOING)) | is_decodable(text) | F.rlike(text, F.lit(_MAYBE_SPELT))
    return F.coalesce(F.pandas_udf(each, StringType())(F.when(needed, text)), fold_leet(text))


def normalize(text: Column) -> Column:
    """Folded lower-case text, followed by its views.

    The ROT13 view follows where it differs. Short texts are followed besides by all of this
    reversed, and then, where it differs, by the whole with each ``l`` that begins a word read as ``i``.
    """
    # longer white space becomes one space, so that what collapse_whitespace does is left to single signs and the ends
    plain = F.btrim(F.regexp_replace(unwrapped(text), r"(?U)[\s\x1C-\x1F]{2,}|[\t\r\x0B\f]", " "), F.lit(" \n"))
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    # lambdas use their own variable alone: Spark does not extract an Arrow UDF over this column where one uses another's
    with_view = lambda t, view: once(F.struct(t.alias("t"), view.alias("v")), lambda s: F.when(s["v"] != s["t"], F.concat_ws(SEPARATOR, s["t"], s["v"])).otherwise(s["t"]))
    reshaped = lambda t: with_view(t, F.regexp_replace(t, r"(?U)l(?=[a-z])(?<=\bl)", "i"))
    mirrored = lambda t: once(F.lower(F.concat_ws(SEPARATOR, t, F.reverse(t))), reshaped)
    turned = lambda p: F.struct((F.char_length(p) <= VIEW_LIMIT).alias("short"), with_view(p, rot13(p)).alias("t"))
    views = lambda s: F.when(s["short"], mirrored(s["t"])).otherwise(F.lower(s["t"]))
    return F.when(text.isNotNull(), once(once(plain, turned), views))
