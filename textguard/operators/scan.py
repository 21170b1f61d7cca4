"""Scanning: literal rule predicates, context guards, suppression and decisions.

Findings stay an array in each row, so a scan is a narrow projection without a shuffle.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import VIEW_LIMIT
from ..plans import rules as R


def rank_of(severity: Column) -> Column:
    """Rank of a severity; unknown ones rank 0."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in R.SEVERITIES.items() for x in kv]), severity), F.lit(0))


def decision_of(severities: Column) -> Column:
    """Decision of the worst of an array of severities, of equally bad ones the first; none allows, one that is not known quarantines."""
    table = F.create_map(*[F.lit(x) for name, rank in R.SEVERITIES.items() for x in (name, R.DECISIONS[rank])])
    worst = F.array_max(F.transform(severities, lambda s, i: F.struct(rank_of(s).alias("rank"), (-i).alias("place"), F.coalesce(s, F.lit("")).alias("severity"))))
    return F.when(F.size(severities) > 0, F.coalesce(F.try_element_at(table, worst["severity"]), F.lit("quarantine"))).otherwise("allow")


def bound(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _before(text: Column, at: Column, chars: int) -> Column:
    """The ``chars`` characters before position ``at``, lower-cased."""
    start = F.greatest(at - chars, F.lit(1))
    return F.lower(F.substring(text, start, at - start))


def _holds_any(text: Column, phrases: list[str]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(p)) for p in phrases])


def negated(before: Column) -> Column:
    """Whether a negation, or a label followed by a quotation mark, stands in the text before a match."""
    quoted = [F.contains(before, F.lit(label)) & F.rlike(F.regexp_extract(before, f"(?s).*{label}(.*)$", 1), F.lit(R.QUOTES)) for label in R.LABELS]
    return _holds_any(before, R.NEGATIONS) | reduce(or_, quoted)


def described(clause: Column) -> Column:
    """Whether the clause before a match speaks of defence or of attackers."""
    return _holds_any(clause, R.DESCRIBING)


def findings(text: Column, rules: list[R.Rule] = R.RULES) -> Column:
    """Array of (id, category, severity, layer, match) of the rules that match.

    Of each rule the first match decides; where a guard holds, it counts as review. Guards are
    evaluated on the few matches alone, each piece of context cut once.
    """
    hit = lambda r: F.struct(*[F.lit(getattr(r, c)).alias(c) for c in ("id", "category", "severity", "layer", "negation_immune")], F.regexp_extract(text, r.pattern, 0).alias("match"), (F.char_length(F.regexp_extract(text, f"(?s)^(.*?)(?:{r.pattern})", 1)) + 1).alias("at"))
    hits = F.array_compact(F.array(*[F.when(F.rlike(text, F.lit(r.pattern)), hit(r)) for r in rules]))
    placed = F.transform(hits, lambda h: F.struct(h.alias("h"), h["at"].alias("at")))
    clause = lambda at: F.regexp_replace(_before(text, at, R.DESCRIBING_CHARS), r"(?s)^.*(?:[.!?] |\n)", "")
    cut = F.transform(placed, lambda p: F.struct(p["h"].alias("h"), _before(text, p["at"], R.NEGATION_CHARS).alias("before"), F.when(p["h"]["layer"] == "mechanism", clause(p["at"])).otherwise("").alias("clause")))
    harmless = lambda c: (~c["h"]["negation_immune"] & negated(c["before"])) | described(c["clause"])
    made = lambda c: F.struct(c["h"]["id"].alias("id"), c["h"]["category"].alias("category"), F.when(harmless(c), "review").otherwise(c["h"]["severity"]).alias("severity"), c["h"]["layer"].alias("layer"), F.substring(c["h"]["match"], 1, R.MATCH_CHARS).alias("match"))
    return F.transform(cut, made)


def suppress_mechanisms(found: Column) -> Column:
    """Drop a mechanism where a carrier of its category ranks at least as high."""
    beaten = lambda all_, m: F.exists(all_, lambda c: (c["layer"] == "carrier") & (c["category"] == m["category"]) & (rank_of(c["severity"]) >= rank_of(m["severity"])))
    return bound(found, lambda all_: F.filter(all_, lambda f: (f["layer"] != "mechanism") | ~beaten(all_, f)))


def scan(docs: DataFrame, text: str = "text", rules: list[R.Rule] = R.RULES) -> DataFrame:
    """``docs`` with columns findings and decision; works on batch and streaming input."""
    found = docs.withColumn("findings", suppress_mechanisms(findings(F.col(text), rules)))
    return found.withColumn("decision", decision_of(F.transform("findings", lambda f: f["severity"])))


def windows(text: Column) -> Column:
    """Windows of 1200 characters every 600; the last one reaches the end."""
    n = F.char_length(text)
    last = F.when(n <= R.WINDOW_CHARS, 0).otherwise(F.ceil((n - R.WINDOW_CHARS) / R.WINDOW_STEP)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * R.WINDOW_STEP + 1, F.lit(R.WINDOW_CHARS)))


def cooccur(text: Column, first: str, second: str) -> Column:
    """Whether both patterns match inside one window."""
    return F.exists(windows(text), lambda w: F.rlike(w, F.lit(first)) & F.rlike(w, F.lit(second)))


def guarded(text: Column, guard: str, core: str) -> Column:
    """Whether ``core`` matches inside a window of a text that does not begin with ``guard``."""
    return ~F.rlike(text, F.lit(f"^(?:{guard})")) & F.exists(windows(text), lambda w: F.rlike(w, F.lit(core)))


def corroborated(text: Column, normal: Column, pattern: str) -> Column:
    """Whether ``pattern`` matches the text or, for short texts, its normalised form."""
    return F.rlike(text, F.lit(pattern)) | ((F.char_length(text) <= VIEW_LIMIT) & F.rlike(normal, F.lit(pattern)))


def secret_tokens(text: Column) -> Column:
    """Array of (ord, rule, token) of all secret-shaped tokens but stand-ins, in order of precedence."""
    def tokens(order: int, name: str, pattern: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        if name in R.SECRET_STARTS:
            found = F.when(_holds_any(text, R.SECRET_STARTS[name]), found).otherwise(F.array().cast("array<string>"))
        return F.transform(found, lambda t: F.struct(F.lit(order).alias("ord"), F.lit(name).alias("rule"), t.alias("token")))

    each = [tokens(i, name, rx) for i, (name, rx) in enumerate(R.SECRETS)]
    return F.filter(F.concat(*each), lambda s: ~F.rlike(s["token"], F.lit(R.PLACEHOLDERS)))


def secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, rule, token): distinct secret tokens, of equal tokens the first rule, no placeholders."""
    hits = docs.select(F.col(doc_id).alias("doc_id"), F.explode(secret_tokens(F.col(text))).alias("s")).select("doc_id", "s.*")
    return hits.groupBy("doc_id", "token").agg(F.min(F.struct("ord", "rule")).alias("r")).select("doc_id", F.col("r.rule").alias("rule"), "token")
