"""scan_text(text, channel): the pattern engine as a table function of SQL, for LATERAL joins.

SQL hands a text and gets its findings as rows, so the function works on one text at a time; it is the engine's tables
(pieces, regexes, keywords) with Python's own regexes, and its results are those of ``Engine.scan``. Whole tables are
better scanned by ``Engine.scan``, whose guards and regexes run inside the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.engine import SAME_LETTERS, Engine, evaluation, keyword_finds
from ..operators.keywords import automaton_of
from . import rules as R
from .patterns import CHANNEL_ALIASES

FINDING = "id string, category string, severity string, layer string, match string, original_severity string, decision string"
_ROT13 = str.maketrans(*T.ROT13)


def normal_form(text: str) -> str:
    """functions.text.normalize of one text."""
    plain = T.unwrap(text)
    plain = re.sub(r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "", re.sub(" {2,}", " ", re.sub(r"[\t\r\x0B\f]", " ", plain)))
    turned = plain.translate(_ROT13)
    views = plain if turned == plain else plain + T.SEPARATOR + turned
    if len(plain) > T.VIEW_LIMIT:
        return views.lower()
    mirrored = (views + T.SEPARATOR + views[::-1]).lower()
    reshaped = re.sub(r"\bl(?=[a-z])", "i", mirrored)
    return mirrored if reshaped == mirrored else mirrored + T.SEPARATOR + reshaped


def windows(text: str) -> list[str]:
    last = max(0, -(-(len(text) - R.WINDOW_CHARS) // R.WINDOW_STEP))
    return [text[i * R.WINDOW_STEP : i * R.WINDOW_STEP + R.WINDOW_CHARS] for i in range(last + 1)]


def negated(before: str) -> bool:
    """scan.negated of the text before a match."""
    quoted = any(re.search(R.QUOTES, before[at + len(label) :]) for label in R.LABELS if (at := before.rfind(label)) >= 0)
    return quoted or any(phrase in before for phrase in R.NEGATIONS)


def described(before: str) -> bool:
    """scan.described of the last clause of the text before a match."""
    clause = re.split(r"[.!?] |\n", before)[-1]
    return any(phrase in clause for phrase in R.DESCRIBING)


class TextScanner:
    """The engine's tables, and the scan of one text with them."""

    def __init__(self, engine: Engine):
        self.patterns, self.table, self.numbers, self.channels = engine.patterns, engine.table, engine.numbers, engine.channels
        self.pieces, self.always = engine.index(range(len(engine.patterns)))
        self.owners = engine._owners(range(len(engine.patterns)))
        self.compiled: dict[int, tuple] = {}

    def first_match(self, number: int, text: str) -> tuple[str, int] | None:
        """(match, place) of the first match of a regex; a match in a window counts as the beginning of its text."""
        if number not in self.compiled:
            how, guards, core = evaluation(self.table[number][1])
            self.compiled[number] = how, [re.compile(g, re.I) for g in guards], re.compile(core, re.I)
        how, guards, core = self.compiled[number]
        if how == "plain":
            return (m.group(0), m.start()) if (m := core.search(text)) else None
        if any(g.match(text) for g in guards):
            return None
        return next(((m.group(0), 0) for w in windows(text) if (m := core.match(w))), None)

    def lane(self, numbers: list[int], text: str) -> dict[int, tuple[str, int]]:
        found: dict[int, tuple[str, int]] = {}
        for number in numbers:
            p = self.table[number][0]
            if p not in found and (hit := self.first_match(number, text)):
                found[p] = hit
        return found

    def scan(self, text: str | None, channel: str | None) -> list[tuple]:
        """Rows of ``FINDING`` in the order of Engine.scan."""
        if text is None:
            return []
        names = {channel, CHANNEL_ALIASES.get(channel, channel)}
        met = lambda p: channel not in self.channels or names & set(self.patterns[p].channel)
        folded, normal = text.translate(str.maketrans(*SAME_LETTERS)).lower(), normal_form(text)
        held = {w for _, w in automaton_of(tuple(self.pieces)).iter(folded)} if self.pieces else set()
        numbers = sorted({r for w in held for r in self.pieces[w]}.union(self.always))
        seen = self.lane([n for n in numbers if met(self.table[n][0])], text)
        known = [h for h in keyword_finds(normal, self.owners) if met(h["p"])] if self.owners else []
        unsure = [h["p"] for h in known if self.numbers[h["p"]] and h["p"] not in seen] if len(text) <= T.VIEW_LIMIT else []
        tried = self.lane(sorted(n for p in unsure for n in self.numbers[p]), normal)
        alone = [(h["p"], h["match"], h["at"] - 1, normal, False) for h in known if not self.numbers[h["p"]]]
        hits = alone + [(p, m, at, text, True) for p, (m, at) in seen.items()] + [(p, m, at, normal, False) for p, (m, at) in tried.items()]
        judged = []
        for p, match, at, over, describing in hits:
            rule = self.patterns[p]
            harmless = not rule.negation_immune and negated(over[max(0, at - R.NEGATION_CHARS) : at].lower())
            harmless = harmless or describing and rule.layer == "mechanism" and described(over[max(0, at - R.DESCRIBING_CHARS) : at].lower())
            judged.append((rule.id, rule.category, "review" if harmless else rule.severity, rule.layer, match[: R.MATCH_CHARS], rule.severity))
        rank = lambda s: R.SEVERITIES.get(s, 0)
        carriers = [f for f in judged if f[3] == "carrier"]
        kept = [f for f in judged if f[3] != "mechanism" or not any(c[1] == f[1] and rank(c[2]) >= rank(f[2]) for c in carriers)]
        worst = max(kept, key=lambda f: rank(f[2]), default=None)
        decision = "allow" if worst is None else R.DECISIONS[rank(worst[2])] if worst[2] in R.SEVERITIES else "quarantine"
        return [(*f, decision) for f in kept]


def register_scan_text(spark: SparkSession, engine: Engine, name: str = "scan_text") -> None:
    """Register the table function ``name(text, channel)`` of SQL: a row for each finding, with the text's decision.

    A null or unknown channel is met by all patterns; texts without findings give no row: join
    the findings back by key, as Spark runs LEFT JOIN LATERAL of a Python table function as an inner join.
    """
    scanner = TextScanner(engine)

    class ScanText:
        def eval(self, text: str, channel: str) -> Iterator[tuple]:
            yield from scanner.scan(text, channel)

    spark.udtf.register(name, F.udtf(ScanText, returnType=FINDING, useArrow=True))
