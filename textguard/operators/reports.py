"""Roll-ups over findings, scan logs and tool descriptors."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import rank_of


#: Severities that can corroborate, and the rungs of the ladder from the worst.
CORROBORATING = ["high", "critical"]
RUNGS = ["known_attack", "review_before_agent_ingestion", "clean_notes", "clean"]


def tier_of(patterns: DataFrame) -> DataFrame:
    """(id, tier) of patterns (id, tier, regex): the tier given, else B without a regex, else A."""
    has_regex = F.coalesce(F.size("regex"), F.lit(0)) > 0
    tier = F.when(F.coalesce("tier", F.lit("")) != "", F.col("tier")).when(has_regex, "A").otherwise("B")
    return patterns.select("id", tier.alias("tier")).groupBy("id").agg(F.max("tier").alias("tier"))


def note_only(tier: Column, severity: Column) -> Column:
    """Whether a finding only ever makes notes: tier B, or a severity below high."""
    return (F.coalesce(tier, F.lit("A")) == "B") | ~F.coalesce(severity.isin(CORROBORATING), F.lit(False))


def ladder(files: DataFrame, found: DataFrame, group: str, file: str) -> DataFrame:
    """Per group of files: overall, files_scanned, signature_hits, review_files and notes.

    ``files`` has a row for each file, ``found`` (group, file, id, category, severity, match, tier)
    one for each finding. A finding of tier S makes a known attack. Two ids with two different
    matches of one category in one file, none of them note-only or of tier S, ask for review. Any
    other finding makes notes, and a group without findings is clean. Null groups are a group of
    their own. Ids and matches of one file and category are counted by their smallest and largest,
    so no set is gathered.
    """
    signature = F.coalesce(F.col("tier") == "S", F.lit(False))
    counts = ~signature & ~note_only(F.col("tier"), F.col("severity"))
    two = lambda c: F.coalesce(F.min(F.when(counts, F.col(c))) != F.max(F.when(counts, F.col(c))), F.lit(False))
    match = found.withColumn("match", F.coalesce("match", F.lit("")))
    by = match.groupBy(group, file, "category").agg((two("id") & two("match")).alias("review"), F.count_if(signature).alias("hits"), F.count_if(~signature).alias("notes"))
    per_file = by.groupBy(group, file).agg(F.bool_or("review").alias("review"), F.sum("hits").alias("hits"), F.sum("notes").alias("notes"))
    graded = per_file.groupBy(group).agg(F.sum("hits").alias("signature_hits"), F.count_if("review").alias("review_files"), F.sum("notes").alias("notes"))
    scanned = files.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("files_scanned"))
    joined = scanned.join(graded, F.col("_group").eqNullSafe(graded[group]), "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    rung = F.when(number("signature_hits") > 0, RUNGS[0]).when(number("review_files") > 0, RUNGS[1]).when(number("notes") > 0, RUNGS[2]).otherwise(RUNGS[3])
    return joined.select(F.col("_group").alias(group), rung.alias("overall"), "files_scanned", *[number(c).alias(c) for c in ("signature_hits", "review_files", "notes")])


def daily_report(log: DataFrame, day: Column, decision: Column, latency: Column) -> DataFrame:
    """Per day: totals by decision, average latency, and the share of clean scans in whole per cent (halves to even)."""
    rows = log.select(day.alias("day"), decision.alias("decision"), latency.alias("latency"))
    count = lambda d: F.count_if(F.col("decision") == d)
    score = F.bround(count("allow") / F.count("*") * 100, 0).cast("long")
    return rows.groupBy("day").agg(
        F.count("*").alias("total"), count("block").alias("blocked"), count("quarantine").alias("quarantined"), count("allow").alias("clean"), count("allow_redacted").alias("redacted"),
        F.round(F.avg("latency"), 4).alias("avg_latency"), score.alias("protection_score"),
    )


def daily_categories(log: DataFrame, day: Column, categories: Column) -> DataFrame:
    """(day, category, n): how often each category of an array column comes up on a day."""
    return log.select(day.alias("day"), F.explode(categories).alias("category")).groupBy("day", "category").agg(F.count("*").alias("n"))


def last_threats(log: DataFrame, day: Column, decision: Column, order: list[str], n: int = 10) -> DataFrame:
    """The last ``n`` rows of each day that were not allowed."""
    return tail(log.withColumns({"day": day, "decision": decision}).where("decision <> 'allow'"), "day", order, n)


def tree_totals(scanned: DataFrame, group: str) -> DataFrame:
    """Per group of scanned files: files_scanned, files_with_threats, total_threats, and findings by severity."""
    n = lambda s: F.sum(F.size(F.filter("findings", lambda f: f["severity"] == s))).alias(s)
    threats = F.size("findings")
    return scanned.groupBy(group).agg(F.count("*").alias("files_scanned"), F.count_if(threats > 0).alias("files_with_threats"), F.sum(threats).alias("total_threats"), *[n(s) for s in ("critical", "high", "medium", "low")])


def tree_categories(scanned: DataFrame, group: str) -> DataFrame:
    """(group, category, n, place): categories of a group's findings, the commonest first, equal ones by name."""
    counted = scanned.select(group, F.explode("findings.category").alias("category")).groupBy(group, "category").agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "category")).cast("long"))


def tree_report(totals: DataFrame, categories: DataFrame, group: str) -> DataFrame:
    """(group, report): a text for each group from tree_totals and tree_categories (a few rows each)."""
    line = F.format_string("%6d  %s", "n", "category")
    listed = categories.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
    joined = totals.withColumnRenamed(group, "_group").join(listed, F.col("_group").eqNullSafe(listed[group]), "left")
    severities = F.array_compact(F.array(*[F.when(F.col(s) > 0, F.format_string(f"{s.upper():>10s}: %d", F.col(s))) for s in ("critical", "high", "medium", "low")]))
    head = F.format_string("Files scanned: %d\nFiles with threats: %d\nTotal threats: %d", "files_scanned", "files_with_threats", "total_threats")
    body = F.when(F.col("total_threats") > 0, F.array_join(F.concat(F.array(F.lit("Severities:")), severities, F.array(F.lit("Categories:")), F.coalesce("lines.line", F.array().cast("array<string>"))), "\n")).otherwise("No threats found.")
    return joined.select(F.col("_group").alias(group), F.concat_ws("\n", head, body).alias("report"))


def all_segments(scanned: DataFrame, key: str) -> DataFrame:
    """(key, clean, threats): a file made of segments is clean if all of them are; threats is the number of findings together."""
    return scanned.groupBy(key).agg(F.bool_and(F.size("findings") == 0).alias("clean"), F.sum(F.size("findings")).alias("threats"))


def tail(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of each key."""
    window = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("place", F.row_number().over(window)).where(F.col("place") <= n)


def pin_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(tool, change): added, removed or changed between two snapshots (tool, sha256)."""
    both = before.select("tool", F.col("sha256").alias("old")).join(after.select("tool", F.col("sha256").alias("new")), "tool", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.select("tool", change.alias("change")).where("change is not null")


#: Level and score by severity that code scanning shows; others count as a warning of score 5.0.
SARIF_LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "review": "note", "none": "none"}
SECURITY_SCORES = {"critical": "9.5", "high": "8.0", "medium": "5.5", "low": "3.0", "review": "2.0"}
#: Chapters of the documentation and the categories that they group; other categories have none.
CHAPTERS = {
    "prompt-injection": ["prompt_injection", "indirect_prompt_injection", "hidden_instruction", "jailbreak_evasion", "prompt_extraction", "prompt_leak", "parasitic_injection", "context_flooding", "retrieval_poisoning"],
    "mcp-tool-handoff-abuse": ["mcp_threat", "tool_poisoning", "tool_metadata_smuggling", "tool_chain_race", "tool_output_poisoning"],
    "callback-redirect-trust-drift": ["provenance_chain", "provenance_chain_fracture", "agent_contract_poisoning"],
    "outbound-endpoint-control-c2-drift": ["exfiltration", "ssrf", "dns_tunneling", "c2_indicator", "secret_detection"],
    "policy-scope-redefinition": ["policy_scope_redefinition", "authorization_bypass", "auth_bypass", "privilege_escalation", "approval_graph_poisoning"],
    "state-sync-poisoning": ["state_sync_poisoning", "cross_agent_injection"],
    "memory-persistence-poisoning": ["memory_poisoning", "memory_eviction_rehydration"],
    "package-dependency-registry-trust-abuse": ["supply_chain"],
    "browser-agent-navigation-link-safety-abuse": ["ui_injection", "social_engineering_ui", "social_engineering", "identity_phishing"],
    "agent-workflow-publish-path-abuse": ["agent_workflow_security", "agent_workflow", "agent_security"],
    "discovery-file-poisoning": ["discovery_file_poisoning", "agent_instruction_file_poisoning", "identity_discovery_poisoning"],
}
DOCS_URI = "https://docs.example.org/patterns"


def _looked_up(table: dict[str, str], key: Column, other: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(other))


def help_uri(category: Column, chapters: dict[str, list[str]] = CHAPTERS, root: str = DOCS_URI) -> Column:
    """Page of the chapter that a category belongs to, else the root."""
    pages = {c: f"{root}/{chapter}" for chapter, categories in chapters.items() for c in categories}
    return _looked_up(pages, category, root)


def sarif_rule(f: Column) -> Column:
    """Rule of a finding (id, category, severity and, where the struct has them, name and description)."""
    level, score = _looked_up(SARIF_LEVELS, f["severity"], "warning"), _looked_up(SECURITY_SCORES, f["severity"], "5.0")
    category = F.coalesce(f["category"], F.lit("unknown"))
    properties = F.struct(category.alias("category"), f["severity"].alias("severity"), score.alias("security-severity"), F.array(F.lit("security"), F.concat(F.lit("category:"), category)).alias("tags"))
    return F.struct(
        f["id"].alias("id"), f["id"].alias("name"), F.struct(f["id"].alias("text")).alias("shortDescription"), F.struct(F.concat(f["id"], F.lit(": "), category).alias("text")).alias("fullDescription"),
        help_uri(f["category"]).alias("helpUri"), properties.alias("properties"), F.struct(level.alias("level")).alias("defaultConfiguration"),
    )


def sarif_result(f: Column, location: Column, decision: Column) -> Column:
    """Result of a finding at a location."""
    level, score = _looked_up(SARIF_LEVELS, f["severity"], "warning"), _looked_up(SECURITY_SCORES, f["severity"], "5.0")
    place = F.struct(F.struct(F.struct(location.alias("uri"), F.lit(0).alias("index")).alias("artifactLocation")).alias("physicalLocation"))
    said = F.concat(f["id"], F.lit(" detected"), F.when(F.coalesce(f["match"], F.lit("")) != "", F.concat(F.lit(': "'), f["match"], F.lit('"'))).otherwise(""))
    properties = F.struct(F.coalesce(f["category"], F.lit("unknown")).alias("category"), f["severity"].alias("severity"), score.alias("security-severity"), F.substring(f["match"], 1, 200).alias("matched_text"), decision.alias("decision"))
    return F.struct(f["id"].alias("ruleId"), level.alias("level"), F.struct(said.alias("text")).alias("message"), F.array(place).alias("locations"), properties.alias("properties"))


def sarif_logs(scanned: DataFrame, key: str, version: str = "0.1") -> DataFrame:
    """(key, sarif): a SARIF 2.1.0 log (JSON) for each scanned row with findings, with its rules, in order of first use, and its results.

    A row is one artifact, so a log is as long as the row's findings and nothing is shuffled.
    """
    first = F.filter("findings", lambda f, i: ~F.exists(F.slice("findings", F.lit(1), i), lambda g: g["id"] == f["id"]))
    uri = F.concat(F.lit("input:"), F.col(key).cast("string"))
    driver = F.struct(F.lit("textguard").alias("name"), F.lit(version).alias("version"), F.lit(DOCS_URI).alias("informationUri"), F.transform(first, sarif_rule).alias("rules"))
    artifact = F.struct(F.struct(uri.alias("uri")).alias("location"), F.array(F.lit("analysisTarget")).alias("roles"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.array(artifact).alias("artifacts"), F.transform("findings", lambda f: sarif_result(f, uri, F.col("decision"))).alias("results"), F.lit("utf16CodeUnits").alias("columnKind"))
    log = F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))
    return scanned.where(F.size("findings") > 0).select(key, F.to_json(log).alias("sarif"))


def sarif_rules(found: DataFrame) -> DataFrame:
    """One row per rule that has findings: id, category, level, score, help_uri and the SARIF rule (JSON); its worst finding gives the severity."""
    rules = found.groupBy("id").agg(F.max_by("severity", "rank").alias("severity"), F.min("category").alias("category"))
    rule = sarif_rule(F.struct("id", "category", "severity"))
    rows = rules.withColumn("r", rule)
    return rows.select("id", "category", F.col("r.defaultConfiguration.level").alias("level"), F.col("r.properties")["security-severity"].alias("score"), F.col("r.helpUri").alias("help_uri"), F.to_json("r").alias("rule"))


def result_json(scanned: DataFrame, key: str, channel: str = "message", said: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """One JSON object per scanned row: its decision, worst severity (``none`` without findings), channel and findings.

    ``said`` gives the name and the reason of rules by their id; a rule that is not in it is named
    by its id and has an empty reason. Of equally bad severities the first is the worst.
    """
    def told(id_: Column, which: int, other: Column) -> Column:
        known = F.create_map(*[F.lit(x) for k, v in (said or {}).items() for x in (k, v[which])]).cast("map<string, string>")
        return F.coalesce(F.try_element_at(known, id_), other)

    ranked = F.transform("findings", lambda f, i: F.struct(rank_of(f["severity"]).alias("rank"), (-i).alias("place"), f["severity"].alias("severity")))
    findings = F.transform("findings", lambda f: F.struct(
        f["id"].alias("id"), told(f["id"], 0, f["id"]).alias("name"), f["severity"].alias("severity"), f["category"].alias("category"),
        F.coalesce(f["match"], F.lit("")).alias("matched_text"), told(f["id"], 1, F.lit("")).alias("reason"),
    ))
    severity = F.coalesce(F.array_max(ranked)["severity"], F.lit("none"))
    body = F.struct(F.col(key), "decision", severity.alias("severity"), F.lit(channel).alias("channel"), F.size("findings").alias("findings_count"), findings.alias("findings"))
    return scanned.select(key, F.to_json(body).alias("result"))


def summary_line(scanned: DataFrame, key: str) -> DataFrame:
    """One line per scanned row: PASS, or the decision and how many findings of how many categories led to it."""
    n, kinds = F.size("findings"), F.size(F.array_distinct("findings.category"))
    line = F.when(n == 0, "PASS").otherwise(F.concat_ws(" ", F.upper("decision"), n, F.lit("findings in"), kinds, F.lit("categories")))
    return scanned.select(key, line.alias("summary"))


def quality_metrics(judged: DataFrame, segment: str) -> DataFrame:
    """Confusion counts, precision, recall and F1 by segment and over all (segment 'all'), from booleans truth and caught.

    A ratio without a base is 0. ``seal`` is the digest of the metrics as canonical JSON (sorted keys, no blanks, ratios with four places), equal for equal results.
    """
    count = lambda c: F.count_if(c)
    truth, caught = F.col("truth"), F.col("caught")
    counts = judged.rollup(segment).agg(count(truth & caught).alias("tp"), count(truth & ~caught).alias("fn"), count(~truth & caught).alias("fp"), count(~truth & ~caught).alias("tn"), F.grouping(segment).alias("g"))
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 4)
    tp, fn, fp = F.col("tp"), F.col("fn"), F.col("fp")
    rated = counts.select(
        F.when(F.col("g") == 1, "all").otherwise(F.col(segment)).alias("segment"), "tp", "fn", "fp", "tn",
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )
    members = [F.concat(F.lit(f'"{c}":'), F.format_string("%.4f", c) if c in ("f1", "precision", "recall") else F.col(c).cast("string")) for c in ("f1", "fn", "fp", "precision", "recall", "tn", "tp")]
    return rated.withColumn("seal", F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}")), 256))


#: Severities that block on clean texts.
BLOCKING = ["critical", "high", "medium"]


def offenders(found: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Distinct ids of findings (id, severity) of clean texts that would block; with ``candidates`` (id) only those of them."""
    ids = found.where(F.col("severity").isin(BLOCKING)).select("id").distinct()
    return ids if candidates is None else ids.join(candidates.select("id").distinct(), "id", "left_semi")


def top_pairs(found: DataFrame, columns: list[str], most: int | None = 20) -> DataFrame:
    """The first ``most`` distinct combinations of ``columns`` of findings (None: all), in their order."""
    pairs = found.select(*columns).distinct().orderBy(*columns)
    return pairs if most is None else pairs.limit(most)


#: Most categories and refused scans that a page lists; what lies beyond is counted on it.
PAGE_CATEGORIES, PAGE_THREATS = 50, 20


def day_page(days: DataFrame, categories: DataFrame, threats: DataFrame, day: str) -> tuple[str, str]:
    """A day's report as text and as an HTML page, from daily_report, daily_categories and the refused scans (day, ts, decision, names).

    Both have the totals, the share of clean scans, the categories by number (equal ones by name) and the last refused scans; of a day
    without scans all numbers are 0 and the share is 100. Only one row, the first categories and the last scans come to the driver.
    """
    on = F.col("day").cast("string") == day
    row = days.where(on).first()
    names = ["total", "blocked", "quarantined", "clean", "redacted", "avg_latency", "protection_score"]
    totals = {n: row[n] or 0 for n in names} if row else dict.fromkeys(names[:-1], 0) | {"protection_score": 100}
    of_day = categories.where(on)
    listed, kinds = of_day.orderBy(F.desc("n"), "category").limit(PAGE_CATEGORIES).collect(), of_day.count()
    refused = threats.where(on)
    last, count = refused.orderBy(F.desc("ts"), "decision").limit(PAGE_THREATS).collect()[::-1], refused.count()
    said = lambda r: (str(r["ts"])[11:19], r["decision"].upper(), ", ".join(n or "" for n in r["names"] or ["unknown"]))

    lines = [f"Report of {day}", ""]
    lines += [f"{label + ':':<16}{value}" for label, value in [("Scans", totals["total"]), ("Blocked", totals["blocked"]), ("Quarantined", totals["quarantined"]), ("Clean", totals["clean"]), ("Redacted", totals["redacted"]), ("Mean time (ms)", f"{totals['avg_latency']:.2f}"), ("Clean (%)", totals["protection_score"])]]
    if listed:
        lines += ["", "Categories:", *(f"  {r['category']:<25} {r['n']:>6}  {'#' * min(r['n'], 20)}" for r in listed)]
        lines += [f"  and {kinds - len(listed)} more"] if kinds > len(listed) else []
    if last:
        lines += ["", "Last refused:", *("  [{}] {:>10}  {}".format(*said(r)) for r in last)]
        lines += [f"  and {count - len(last)} before"] if count > len(last) else []

    cell = lambda values, tag="td": "<tr>" + "".join(f"<{tag}>{html.escape(str(v))}</{tag}>" for v in values) + "</tr>"
    widest = max((r["n"] for r in listed), default=1)
    bar = lambda r: f"<tr><td>{html.escape(r['category'])}</td><td><meter max='{widest}' value='{r['n']}'></meter></td><td>{r['n']}</td></tr>"
    page = "".join([
        f"<!doctype html><title>Report of {html.escape(day)}</title><h1>Report of {html.escape(day)}</h1><p>{totals['protection_score']} % clean</p>",
        "<table>", cell(names[:-1], "th"), cell([totals[n] for n in names[:-1]]), "</table>", "<h2>Categories</h2><table>", *map(bar, listed), "</table>",
        f"<p>{kinds - len(listed)} more</p>" if kinds > len(listed) else "", "<h2>Last refused</h2><table>", *(cell(said(r)) for r in last), "</table>", f"<p>{count - len(last)} before</p>" if count > len(last) else "",
    ])
    return "\n".join(lines), page


def html_report(days: DataFrame) -> str:
    """A page with all rows of daily_report, the newest first: an aggregate of one row a day."""
    names = days.columns
    rows = days.orderBy(F.desc("day")).collect()
    line = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{html.escape(str(c))}</{tag}>" for c in cells) + "</tr>"
    return "<!doctype html><table>" + line(names, "th") + "".join(line(r, "td") for r in rows) + "</table>"
