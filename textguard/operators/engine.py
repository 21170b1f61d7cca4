"""The pattern engine: patterns with keywords and regexes against texts of some channel.

Three lanes give findings. Keywords are sought in the normalised text by one automaton pass; a
pattern without regexes is found by a keyword, one with regexes only becomes a candidate. Regexes
are sought in the text itself. Candidates that the text itself does not confirm are tried on the
normalised text if the text is short. Guards, suppression of mechanisms and decisions are those of ``scan``.

Regexes meet texts as pairs: each regex is known by pieces of text of which its matches hold one; an automaton of all
pieces passes once over a text and gives the numbers of the regexes that it may match. Of those, only regexes whose
other necessary pieces the text holds too are evaluated.
The pairs stay an array in the text's row, so that no text is shuffled or copied, and their
regexes are looked up in a table inside the plan: the plan is the same for ten patterns and for thousands.

Patterns are a small table of checked size; each text is read in one narrow pass without a
shuffle, and findings stay in its row.

Defined results: null and empty texts have no findings and are allowed; patterns whose regexes all
fail to compile count as having none; a null or unknown channel in a column is met by all patterns,
so that nothing is missed, while an unknown channel given as a word is an error.
"""

from __future__ import annotations

import json
import re
import re._parser as regex_parser
from collections.abc import Iterable
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from ..functions.text import VIEW_LIMIT, VIEW_MARK, normalize
from ..plans import rules as R
from ..plans.patterns import CHANNEL_ALIASES, CHANNELS, MECHANISMS, Pattern
from . import scan as S
from .keywords import automaton_of

#: Most patterns that a plan takes; more are refused, not dropped.
MOST_PATTERNS = 5_000
#: Characters of normalised text that a keyword finding quotes before and after the keyword.
QUOTED_BEFORE, QUOTED_AFTER = 10, 20

#: Letters that count as another where case is ignored, although lower-casing keeps them or makes two of them.
SAME_LETTERS = ("ſıİ", "sii")

_FLAGS = re.compile(r"\(\?([aiLmsux]+)\)")
#: Escapes, whole character classes, Python's named groups, and repetitions, with and without a lower bound.
_TOKENS = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?P<|\(\?P=(\w+)\)|\{\d+,?\d*\}|\{,(?=\d+\})|.", re.S)


def java_regex(pattern: str) -> str:
    """Java spelling of a Python regex that ignores case, with Python's view of line ends and of Unicode."""

    def spell(match: re.Match) -> str:
        token = match.group(0)
        if token[0] == "[" and len(token) > 1:
            head = 2 if token[1] == "^" else 1
            inner = re.sub(r"\\.|\[|&(?=&)", lambda m: m.group(0) if m.group(0)[0] == "\\" else "\\" + m.group(0), token[head:-1], flags=re.S)
            return token[:head] + ("\\" if inner.startswith("]") else "") + inner + "]"
        fixed = {"(?P<": "(?<", "{,": "{0,", "{": r"\{", r"\Z": r"\z"}
        return rf"\k<{match.group(1)}>" if match.group(1) else fixed.get(token, token)

    flags = _FLAGS.match(pattern)
    kept = "".join(sorted(set(flags.group(1) if flags else "") - set("aLu") | {"i"}))
    return f"(?dU{kept})" + _TOKENS.sub(spell, pattern[flags.end() if flags else 0 :])


def leading_groups(regex: str, loose: bool) -> tuple[list[str], str]:
    """The look-aheads that a regex begins with (``loose``: blanks between them do not count), and what follows them."""
    groups = []
    while (regex := regex.lstrip() if loose else regex).startswith(("(?=", "(?!")):
        depth = 0
        for token in _TOKENS.finditer(regex):
            depth += {"(": 1, "(?P<": 1, ")": -1}.get(token.group(0), 0)
            if not depth:
                break
        groups.append(regex[: token.end()])
        regex = regex[token.end() :]
    return groups, regex


def evaluation(pattern: str) -> tuple[str, list[str], str]:
    """How a regex is evaluated: (``plain``, ``window`` or ``guarded``; guards; core).

    A regex that begins with a look-ahead is matched at the beginning of each window. If it is
    pinned to the beginning of the text besides, its leading negative look-aheads are guards that
    are held against the whole text, and the rest is matched at each window.
    """
    head = found.group(0) if (found := _FLAGS.match(pattern)) else ""
    loose = "x" in head
    pin = re.compile(r"\s*(?:\^|\\A)" if loose else r"\^|\\A").match(pattern, len(head))
    groups, rest = leading_groups(pattern[pin.end() if pin else len(head) :], loose or not pin)
    if not groups or not pin:
        return ("window" if groups else "plain"), [], pattern
    n_guards = next((i for i, g in enumerate(groups) if g[2] != "!"), len(groups))
    return "guarded", [head + g[3:-1] for g in groups[:n_guards]], head + "".join(groups[n_guards:]) + rest


def _best(choices: list[tuple[str, ...]]) -> tuple[str, ...]:
    return max(choices, key=lambda c: min(map(len, c)), default=())


def required_groups(regex: str) -> list[tuple[str, ...]]:
    """Groups of lower-case pieces of text: every match of a regex holds at least one piece of each group.

    Only runs of three ASCII characters or more count.
    """

    def needed(items) -> list[tuple[str, ...]]:
        choices, run = [], ""
        for op, value in [*items, (None, None)]:
            if op is regex_parser.LITERAL and value < 128:
                run += chr(value).lower()
                continue
            choices, run = [*choices, (run,)], ""
            if op is regex_parser.SUBPATTERN:
                choices += needed(value[3])
            elif op is regex_parser.ATOMIC_GROUP:
                choices += needed(value)
            elif op in (regex_parser.MAX_REPEAT, regex_parser.MIN_REPEAT, regex_parser.POSSESSIVE_REPEAT) and value[0] > 0:
                choices += needed(value[2])
            elif op is regex_parser.ASSERT and value[0] > 0:
                choices += needed(value[1])
            elif op is regex_parser.BRANCH:
                options = [_best(needed(branch)) for branch in value[1]]
                choices.append(tuple(dict.fromkeys(x for o in options for x in o)) if all(options) else ())
        return [c for c in choices if c and min(map(len, c)) >= 3]

    return needed(regex_parser.parse(regex, re.I))


def required_pieces(regex: str) -> tuple[str, ...]:
    """Lower-case pieces of text of which every match of a regex holds at least one; none where that cannot be told.

    Of several groups of pieces the one with the longest shortest piece is taken.
    """
    return _best(required_groups(regex))


def usable_regexes(pattern: Pattern) -> list[str]:
    """The regexes of a pattern that compile."""
    def compiles(rx: str) -> bool:
        try:
            re.compile(rx)
        except re.error:
            return False
        return True

    return [rx for rx in pattern.regex if compiles(rx)]


#: A regex of the table: number of its pattern, its Java spelling, whether it is held against windows and what bars it there,
#: and the regex by which everything from its first match on is cut off.
REGEX = "struct<p: int, rx: string, windowed: boolean, guards: array<string>, onward: string>"


def spelt(p: int, pattern: str) -> dict:
    """A row of the table of regexes."""
    how, guards, core = evaluation(pattern)
    at_start = lambda rx: rf"\A(?:{java_regex(rx)})"
    rx = java_regex(core) if how == "plain" else at_start(core)
    return {"p": p, "rx": rx, "windowed": how != "plain", "guards": [at_start(g) for g in guards], "onward": f"(?:{rx})(?s:.*)"}


def matches(text: Column, rx: Column) -> Column:
    """Whether a regex that is a column matches; unlike rlike, this keeps the compiled regex for the next text."""
    return F.call_function("regexp_instr", text, rx) > 0


def first_match(text: Column, pieces: Column, regex: Column) -> Column:
    """(p, match, at) of the first match of a row of the table of regexes, else null; ``pieces`` are the windows of ``text``.

    ``at`` counts characters, from 1; a match in a window counts as the beginning of its text.
    """
    first = lambda over: F.call_function("regexp_extract", over, regex["rx"], F.lit(0))
    made = lambda match, at: F.struct(regex["p"].alias("p"), match.alias("match"), at.cast("int").alias("at"))
    before = F.call_function("regexp_replace", text, regex["onward"], F.lit(""))
    plain = F.when(matches(text, regex["rx"]), made(first(text), F.char_length(before) + 1))
    hit = S.bound(F.filter(pieces, lambda w: matches(w, regex["rx"])), lambda ws: F.when(F.size(ws) > 0, made(first(ws[0]), F.lit(1))))
    return F.when(~regex["windowed"], plain).when(~F.exists(regex["guards"], lambda g: matches(text, g)), hit)


def candidates(folded: Column, pieces: dict[str, list[int]], always: list[int], groups: list[list[tuple[str, ...]]] = ()) -> Column:
    """Sorted numbers of the regexes that a text may match: those of the pieces it holds, and those that need none.

    ``groups`` has for each number further groups of pieces (see required_groups); a regex of whose groups a text lacks one is left out.
    """
    words = tuple(pieces)

    def may_match(text: str, number: int) -> bool:
        return not groups or all(any(piece in text for piece in group) for group in groups[number])

    def search(texts: pd.Series) -> pd.Series:
        automaton = automaton_of(words)
        return texts.map(lambda t: [] if t is None else sorted(r for r in {r for w in {w for _, w in automaton.iter(t)} for r in pieces[w]}.union(always) if may_match(t, r)))

    if not words:
        return F.when(folded.isNotNull(), F.array(*map(F.lit, always)).cast("array<int>")).otherwise(F.array().cast("array<int>"))
    return F.pandas_udf(search, ArrayType(IntegerType()))(folded)


def keyword_finds(text: str, owners: dict[str, list[int]]) -> list[dict]:
    """(p, match, at): for each pattern its first keyword in a normalised text, quoted with what stands around it.

    A keyword must not run on into a longer word on its right; quotes stay inside one view.
    """
    found: dict[int, dict] = {}
    for last, word in automaton_of(tuple(owners)).iter(text):
        start, end = last + 1 - len(word), last + 1
        if word[-1].isalnum() and text[end : end + 1].isalnum():
            continue
        left = text[max(0, start - QUOTED_BEFORE) : start].rpartition(VIEW_MARK)[2]
        right = text[end : end + QUOTED_AFTER].partition(VIEW_MARK)[0]
        for p in owners[word]:
            found.setdefault(p, {"p": p, "match": (left + word + right).strip(), "at": start + 1})
    return list(found.values())


def keyword_places(normal: Column, owners: dict[str, list[int]]) -> Column:
    """keyword_finds as a column: an array of (p, match, at)."""

    def search(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: keyword_finds(t, owners))

    kind = ArrayType(StructType().add("p", IntegerType()).add("match", StringType()).add("at", IntegerType()))
    if not owners:
        return F.array().cast(kind)
    return F.pandas_udf(search, kind)(F.coalesce(normal, F.lit("")))


class Engine:
    """Patterns made ready for scans.

    ``patterns`` are Pattern rows or a table with their columns (see sources.patterns);
    ``extra`` are the user's own; mechanisms join unless switched off. Keywords in
    ``denied`` are too general and are left out (see cards.too_general).
    """

    def __init__(self, patterns: Iterable[Pattern] | DataFrame = (), extra: Iterable[Pattern] | DataFrame = (), mechanisms: bool = True, denied: Iterable[str] = ()):
        self.carriers = [*self._listed(patterns), *self._listed(extra)]
        self.patterns = self.carriers + (MECHANISMS if mechanisms else [])
        if len(self.patterns) > MOST_PATTERNS:
            raise ValueError(f"more than {MOST_PATTERNS} patterns")
        self.denied = {d.lower() for d in denied}
        self.channels = sorted({*CHANNELS, *(c for p in self.patterns for c in p.channel)})
        self.regexes = [usable_regexes(p) for p in self.patterns]
        #: (pattern, regex) by number, and the numbers of each pattern
        self.table = [(p, rx) for p, regexes in enumerate(self.regexes) for rx in regexes]
        self.numbers = [[] for _ in self.patterns]
        for number, (p, _) in enumerate(self.table):
            self.numbers[p].append(number)

    def index(self, chosen: Iterable[int]) -> tuple[dict[str, list[int]], list[int]]:
        """The regexes of some patterns by the pieces of which their matches hold one, and those that need none."""
        pieces: dict[str, list[int]] = {}
        always = []
        for number in (n for p in chosen for n in self.numbers[p]):
            p, rx = self.table[number]
            needs = self.patterns[p].needs or required_pieces(rx)
            for piece in needs:
                pieces.setdefault(piece, []).append(number)
            if not needs:
                always.append(number)
        return pieces, always

    def groups(self) -> list[list[tuple[str, ...]]]:
        """For each regex its groups of pieces but the one that ``index`` goes by, those with the longest pieces first."""
        found = []
        for p, rx in self.table:
            every = required_groups(rx)
            used = () if self.patterns[p].needs else _best(every)
            found.append(sorted((g for g in dict.fromkeys(every) if g != used), key=lambda g: -min(map(len, g))))
        return found

    @staticmethod
    def _listed(patterns: Iterable[Pattern] | DataFrame) -> list[Pattern]:
        if not isinstance(patterns, DataFrame):
            return list(patterns)
        wanted = ["id", "category", "severity", "channel", "keywords", "regex", "negation_immune"]
        rows = patterns.select(*[F.col(c) if c in patterns.columns else F.lit(None).alias(c) for c in wanted]).orderBy("id").limit(MOST_PATTERNS + 1).collect()
        clean = lambda values: tuple(v for v in values or () if v)
        return [Pattern(r.id, r.category, r.severity, clean(r.channel), clean(r.keywords), clean(r.regex), bool(r.negation_immune)) for r in rows]

    def _owners(self, chosen: list[int]) -> dict[str, list[int]]:
        owners: dict[str, list[int]] = {}
        for p in chosen:
            for word in dict.fromkeys(k.lower() for k in self.patterns[p].keywords):
                if word and word not in self.denied:
                    owners.setdefault(word, []).append(p)
        return owners

    def info(self) -> dict[str, int]:
        """Counts of carriers, mechanisms, different keywords and patterns with regexes."""
        everything = range(len(self.patterns))
        return {"patterns": len(self.carriers), "mechanisms": len(self.patterns) - len(self.carriers), "keywords": len(self._owners(everything)), "regex_patterns": sum(map(bool, self.regexes))}

    def scan(self, docs: DataFrame, text: str = "text", channel: str | Column = "message") -> DataFrame:
        """``docs`` with findings (id, category, severity, layer, match, original_severity) and decision."""
        if isinstance(channel, str):
            if channel not in self.channels:
                raise ValueError(f"unknown channel {channel!r}; there are {', '.join(self.channels)}")
            names = {channel, CHANNEL_ALIASES.get(channel, channel)}
            chosen = [i for i, p in enumerate(self.patterns) if names & set(p.channel)]
            allowed = lambda given: F.lit(True)
        else:
            chosen = list(range(len(self.patterns)))
            alias = F.create_map(*[F.lit(x) for kv in CHANNEL_ALIASES.items() for x in kv])
            met = F.array(channel, F.coalesce(F.try_element_at(alias, channel), channel))
            unknown = channel.isNull() | ~channel.isin(self.channels)
            allowed = lambda given: unknown | F.arrays_overlap(met, given)
        facts = [{"id": p.id, "category": p.category, "severity": p.severity, "layer": p.layer, "immune": p.negation_immune, "regexes": numbers, "channel": p.channel} for p, numbers in zip(self.patterns, self.numbers)]
        table = F.from_json(F.lit(json.dumps(facts)), "array<struct<id string, category string, severity string, layer string, immune boolean, regexes array<int>, channel array<string>>>")
        regexes = F.from_json(F.lit(json.dumps([spelt(p, rx) for p, rx in self.table])), f"array<{REGEX}>")
        of = lambda hit: F.element_at(table, hit["p"] + 1)
        taken = {c.lower() for c in docs.columns}
        normal, keyworded, pairs, result = (next(n for n in ("_" * k + part for k in range(1, 99)) if n not in taken) for part in ("normal", "keyworded", "pairs", "result"))
        raw = F.col(text)
        empty = F.array().cast("array<struct<p int, match string, at int>>")

        def lane(over: Column, numbers: Column) -> Column:
            """First match of each pattern whose regexes have the ``numbers`` (sorted) in a text."""
            chosen = F.transform(numbers, lambda n: F.element_at(regexes, n + 1))
            cut = lambda rs: F.when(F.exists(rs, lambda r: r["windowed"]), S.windows(over))
            hits = S.bound(chosen, lambda rs: S.bound(cut(rs), lambda ws: F.array_compact(F.transform(rs, lambda r: first_match(over, ws, r)))))
            # of a pattern's regexes, which follow each other, the first that matches counts
            return S.bound(hits, lambda hs: F.filter(hs, lambda h, i: (i == 0) | (F.get(hs, i - 1)["p"] != h["p"])))

        def judged(hits: Column, over: Column, describing: bool) -> Column:
            """Findings of an array of matches, with the guards held against the text before each."""
            before = lambda h: S._before(over, h["at"], R.NEGATION_CHARS)
            clause = lambda h: F.regexp_replace(S._before(over, h["at"], R.DESCRIBING_CHARS), r"(?s)^.*(?:[.!?] |\n)", "")
            cut = F.transform(hits, lambda h: F.struct(of(h).alias("o"), h["match"].alias("match"), before(h).alias("before"), (clause(h) if describing else F.lit("")).alias("clause")))
            harmless = lambda c: (~c["o"]["immune"] & S.negated(c["before"])) | ((c["o"]["layer"] == "mechanism") & S.described(c["clause"]))
            return F.transform(cut, lambda c: F.struct(
                c["o"]["id"].alias("id"), c["o"]["category"].alias("category"), F.when(harmless(c), "review").otherwise(c["o"]["severity"]).alias("severity"),
                c["o"]["layer"].alias("layer"), F.substring(c["match"], 1, R.MATCH_CHARS).alias("match"), c["o"]["severity"].alias("original_severity"),
            ))

        owners = self._owners(chosen)

        def verdict(folded: Column, known: Column, seen: Column) -> Column:
            """Findings and decision, from the normalised text, keyword hits and matches in the text itself."""
            has_regex = lambda h: F.size(of(h)["regexes"]) > 0
            unsure = F.filter(known, lambda h: has_regex(h) & ~F.exists(seen, lambda m: m["p"] == h["p"]))
            open_ = F.when(F.char_length(raw) <= VIEW_LIMIT, F.flatten(F.transform(unsure, lambda h: of(h)["regexes"])))
            tried = S.bound(open_, lambda o: F.when(F.size(o) > 0, lane(folded, F.array_sort(o))).otherwise(empty))
            alone = F.filter(known, lambda h: ~has_regex(h))
            found = F.concat(judged(alone, folded, False), judged(seen, raw, True), judged(tried, folded, False))
            return S.bound(S.suppress_mechanisms(found), lambda fs: F.struct(fs.alias("findings"), S.decision_of(F.transform(fs, lambda f: f["severity"])).alias("decision")))

        out = docs.withColumn(normal, normalize(raw) if owners else F.lit(None).cast("string"))
        out = out.withColumn(keyworded, keyword_places(F.col(normal), owners))
        known = F.filter(keyworded, lambda h: allowed(of(h)["channel"]))
        out = out.withColumn(pairs, candidates(F.lower(F.translate(raw, *SAME_LETTERS)), *self.index(chosen), self.groups()))
        met_by = F.filter(pairs, lambda n: allowed(of(F.element_at(regexes, n + 1))["channel"]))
        seen = F.when(F.size(met_by) > 0, lane(raw, met_by)).otherwise(empty)
        # one nested expression: optimiser rules that copy a column's definition copy it once, not once for each use inside
        out = out.withColumn(result, S.bound(F.col(normal), lambda n: S.bound(known, lambda k: S.bound(seen, lambda s: verdict(n, k, s)))))
        kept = [c for c in docs.columns if c.lower() not in ("findings", "decision")]
        return out.select(*[F.col(f"`{c}`") for c in kept], f"{result}.findings", f"{result}.decision")
