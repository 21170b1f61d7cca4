"""The pattern engine against plain Python on small cases."""

import re

import pytest
from pyspark.sql import functions as F

from textguard.functions import text as T
from textguard.operators import engine as E
from textguard.operators import toolcalls
from textguard.plans.patterns import MECHANISMS, PLANTED, Pattern
from textguard.plans.table_functions import register_scan_text
from textguard.sources.patterns import search_patterns

DOC = "doc_id long, text string, channel string"


def scanned(spark, patterns, rows, channel="message", **given):
    docs = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r, None))) for i, r in enumerate(rows)], DOC)
    found = E.Engine(patterns, **given).scan(docs, channel=channel)
    return [(r.decision, [(f.id, f.severity, f.match) for f in r.findings]) for r in found.orderBy("doc_id").collect()]


def test_mechanisms_against_python(spark):
    docs = spark.createDataFrame(PLANTED, "doc_id long, text string")
    got = {r.doc_id: {f.id: (f.severity, f.match) for f in r.findings} for r in E.Engine().scan(docs, channel="file").collect()}
    for doc_id, text in PLANTED:
        want = {}
        for p in MECHANISMS:
            hits = [m for m in (re.search(rx, text, re.I) for rx in p.regex) if m]
            if "file" in p.channel and hits:
                want[p.id] = hits[0].group(0)[:50]
        assert {k: v[1] for k, v in got[doc_id].items()} == want
    assert all(f"MECH-{n:03d}" in got[-20 - n] for n in range(1, 12))
    assert got[-32]["MECH-001"][0] == got[-33]["MECH-001"][0] == "review" and not got[-34]
    assert got[-21]["MECH-001"][0] == "high"


@pytest.mark.parametrize("raw,text,hit", [
    (r"(?P<a>x)(?P=a)", "xx", True), (r"a{,2}b\Z", "ab", True), (r"a{b", "a{b", True), (r"[[&&x]", "[", True), (r"[]x]+$", "]x\n", True),
    (r"é", "É", True), (r"\bé\w", "aéa", False), ("a.b", "a\rb", True), ("a.b", "a\nb", False), (r"[^]a]", "]", False), (r"\{\{x", "{{x", True), (r"(?is)a.b", "A\nB", True),
])
def test_java_spelling(spark, raw, text, hit):
    assert bool(re.search(raw, text, re.I)) == hit
    assert spark.range(1).select(F.rlike(F.lit(text), F.lit(E.java_regex(raw)))).first()[0] == hit


def test_ways_of_evaluation():
    assert E.evaluation("(?i)a(?=b)") == ("plain", [], "(?i)a(?=b)") and E.evaluation("^Disallow:")[0] == "plain"
    assert E.evaluation("(?is)(?=.*a)(?=.*b)") == ("window", [], "(?is)(?=.*a)(?=.*b)")
    assert E.evaluation(r"(?is)^(?!.*[)(]a\()(?!b(c)d)(?=.*e).*") == ("guarded", [r"(?is).*[)(]a\(", "(?is)b(c)d"], "(?is)(?=.*e).*")


@pytest.mark.parametrize("regex,pieces", [
    ("abc|xyz?w", ("abc",)), ("abc|defg", ("abc", "defg")), ("(?i)AB[cd]EFGH?", ("efg",)), ("a.b", ()), ("(?:hello)?world", ("world",)), ("(?=.*alpha)(?=.*omega)", ("alpha",)), ("(?!never)x{3}", ()),
    (r"\bfoo\s+barbaz+", ("barba",)), ("(foo){0,2}", ()), ("(?x) f o o # c", ("foo",)), ("éabc", ("abc",)), ("(?<=left)right", ("right",)), ("(?:ab|cde)fgh", ("fgh",)),
])
def test_required_pieces(regex, pieces):
    found = E.required_pieces(regex)
    assert found == pieces or regex == "abc|xyz?w" and found == ()


def test_required_pieces_lose_no_match():
    for m in MECHANISMS:
        for rx in m.regex:
            for _, text in PLANTED:
                if re.search(rx, text, re.I):
                    assert not (pieces := E.required_pieces(rx)) or any(piece in text.lower() for piece in pieces)


ALL = ("message",)


def test_windows_and_guards(spark):
    near = Pattern("W-1", "c", "high", ALL, regex=(r"(?is)(?=.*alpha)(?=.*omega)",))
    guarded = Pattern("G-1", "c", "high", ALL, regex=(r"(?is)^(?!.*harmless)(?=.*alpha)(?=.*omega)", "zzz"))
    rows = ["alpha " + "x" * 300 + " omega", "alpha " + "x" * 3000 + " omega", "alpha omega " + "x" * 3000 + " harmless", "y" * 2000 + " alpha omega", "zzz harmless", "", None]
    got = scanned(spark, [near, guarded], rows, mechanisms=False)
    assert [[f[0] for f in g[1]] for g in got] == [["W-1", "G-1"], [], ["W-1"], ["W-1", "G-1"], ["G-1"], [], []]
    assert [g[0] for g in got] == ["block", "allow", "block", "block", "block", "allow", "allow"]


def test_keywords_and_candidates(spark):
    alone = Pattern("K-1", "c", "medium", ALL, keywords=("Ignore Previous", "general"))
    both = Pattern("K-2", "c", "high", ALL, keywords=("reveal",), regex=(r"reveal\s+the\s+plan",))
    broken = Pattern("K-3", "d", "low", ALL, keywords=("brokenword",), regex=("(",))
    rows = ["please ignore previous notes", "ignore previously", "general", "reveal it", "reveal the plan", "r3v3al the pl4n", "x" * 2001 + " r3v3al the pl4n", "never ignore previous notes", "brokenword", "nalp eht laever", "erirny gur cyna"]
    got = scanned(spark, [alone, both, broken], rows, mechanisms=False, denied=["GENERAL"])
    assert [[f[:2] for f in g[1]] for g in got] == [[("K-1", "medium")], [], [], [], [("K-2", "high")], [("K-2", "high")], [], [("K-1", "review")], [("K-3", "low")], [("K-2", "high")], [("K-2", "high")]]
    assert got[0][1][0][2] == "please ignore previous notes"


def test_channels(spark):
    mail = Pattern("C-1", "c", "high", ("email",), regex=("hello",))
    talk = Pattern("C-2", "c", "high", ("message",), regex=("hello",))
    rows = [("hello", c) for c in ("email", "message", "prompt", "file", None, "odd")]
    got = scanned(spark, [mail, talk], rows, channel=F.col("channel"), mechanisms=False)
    assert [[f[0] for f in g[1]] for g in got] == [["C-1", "C-2"], ["C-2"], ["C-2"], [], ["C-1", "C-2"], ["C-1", "C-2"]]
    assert [f[0] for f in scanned(spark, [mail, talk], ["hello"], channel="email", mechanisms=False)[0][1]] == ["C-1", "C-2"]
    with pytest.raises(ValueError):
        scanned(spark, [mail], ["hello"], channel="odd")


def test_carriers_beat_mechanisms_and_tables_load(spark):
    rows = [("A-1", "prompt_injection", "high", ["message"], None, ["override"], None), ("A-2", "x", "low", None, ["k"], None, True)]
    table = spark.createDataFrame(rows, "id string, category string, severity string, channel array<string>, keywords array<string>, regex array<string>, negation_immune boolean")
    assert [f[0] for f in scanned(spark, table, [PLANTED[0][1]])[0][1]] == ["A-1"]
    assert E.Engine(table).info() == {"patterns": 2, "mechanisms": 11, "keywords": 1, "regex_patterns": 12}
    clash = spark.createDataFrame([(1, "override the rules", "x")], "doc_id long, text string, _engine_raw string")
    assert E.Engine(table).scan(clash).columns == [*clash.columns, "findings", "decision"]


def test_normal_form(spark):
    rows = spark.createDataFrame([(0, "lgnore"), (1, "Х"), (2, "12 !"), (3, None), (4, "a" * 2001)], "i int, t string")
    got = {r.i: r.n for r in rows.select("i", T.normalize(F.col("t")).alias("n")).collect()}
    sep = T.SEPARATOR
    assert got[0] == sep.join(["lgnore", "ytaber", "rebaty", "erongl", "ignore", "ytaber", "rebaty", "erongl"])
    assert got[1] == f"x{sep}k{sep}k{sep}x" and got[2] == f"i2 i{sep}v2 v{sep}v 2v{sep}i 2i" and got[3] is None
    assert got[4] == "a" * 2001 + sep + "n" * 2001


def test_findings_ask_last(spark):
    attack = PLANTED[0][1]
    rows = [("Bash", {"command": f"echo {attack}"}), ("Bash", {"other": attack}), ("Read", {"p": "~/.ssh/x", "t": attack}), ("WebFetch", {"a": "fine"}), (None, None)]
    calls = spark.createDataFrame([(i, *r, "kept") for i, r in enumerate(rows)], "call_id long, tool_name string, tool_input map<string,string>, decision string")
    got = toolcalls.ask_on_findings(toolcalls.decide(calls, blocked_paths=["~/.ssh"]), E.Engine()).orderBy("call_id").collect()
    assert [(r.action, r.rule_id, r.lane) for r in got] == [("ask", "MECH-001", "fuzzy"), ("defer", "clean", "deterministic"), ("deny", "path", "deterministic"), ("defer", "clean", "deterministic"), ("defer", "clean", "deterministic")]
    assert got[0].detail == "block"


def test_search(spark):
    rows = [("1", "n", "c", "high", None, ["Abc"]), ("2", "xabc", "d", "low", None, None), ("3", None, "c", "low", None, [])]
    table = spark.createDataFrame(rows, "id string, name string, category string, severity string, description string, keywords array<string>")
    found = lambda *a, **k: sorted(r.id for r in search_patterns(table, *a, **k).collect())
    assert found("abc") == ["1", "2"] and found("abc", severity="low") == ["2"] and found(category="c") == ["1", "3"] and found() == ["1", "2", "3"]


def test_places_count_characters(spark):
    """Behind 60 characters of two units a negation still stands before the match."""
    rule = Pattern("A-1", "c", "high", ALL, regex=(r"override\s+the\s+rules",))
    smile = "\U0001f600"
    rows = ["Never override the rules", smile * 60 + " Never override the rules", smile * 60 + " we override the rules", "Never " + smile * 60 + " override the rules", "never " + "x" * 60 + " override the rules"]
    assert [g[1][0][1] for g in scanned(spark, [rule], rows, mechanisms=False)] == ["review", "review", "high", "high", "high"]


def many_patterns(n):
    """Patterns of several kinds: by pieces, by classes alone, with look-aheads, guarded, with groups that are referred to, and broken."""
    kinds = [
        lambda i: rf"word{i}\s+(?:left|right)", lambda i: rf"[0-9]{{{3 + i % 5}}}x{i}", lambda i: rf"(?=.*alpha{i}\b)(?=.*omega)", lambda i: rf"^(?!.*harmless)(?=.*beta{i}\b)(?=.*omega)",
        lambda i: rf"\b(\w+)\s+\1\s+end{i}\b", lambda i: "(", lambda i: rf"(?P<a>q{i})-(?P=a)", lambda i: rf"\d\d:\d{i % 10}",
    ]
    return [Pattern(f"M-{i:04d}", "c", ("high", "medium", "low")[i % 3], ALL, regex=(kinds[i % 8](i), rf"second{i}!")) for i in range(n)]


def test_large_tables_against_python(spark):
    """1,324 patterns: findings are those of Python's re, and the plan has as many nodes as with 40."""
    patterns = many_patterns(1324)
    rows = [f"word{i} left" for i in range(0, 1324, 97)] + [f"9999x{i} and 12:3{i % 10}" for i in range(1, 1324, 131)] + [f"alpha{i} omega beta{i + 1} omega" for i in range(2, 1324, 88)]
    rows += [f"it it end{i} q{i + 2}-q{i + 2} second{i + 1}! Second{i}!" for i in range(4, 1324, 104)] + ["harmless beta3 omega", "", None, "nothing here", "x" * 3000 + " word0 right"]

    def want(text):
        out = []
        for p in patterns:
            for rx in E.usable_regexes(p):
                how, guards, core = E.evaluation(rx)
                if text and (m := re.search(core, text, re.I) if how == "plain" else re.match(core, text, re.I)) and not any(re.match(g, text, re.I) for g in guards):
                    out.append((p.id, p.severity, m.group(0)[:50]))
                    break
        return out

    got = scanned(spark, patterns, rows, mechanisms=False)
    assert [g[1] for g in got] == [want(r) for r in rows] and sum(len(g[1]) for g in got) > 60
    docs = spark.createDataFrame([(0, "a", None)], DOC)
    nodes = lambda n: E.Engine(many_patterns(n)).scan(docs)._jdf.queryExecution().analyzed().toString().count("lambda")
    assert nodes(40) == nodes(1324)


def test_candidates_are_few():
    engine = E.Engine(many_patterns(1324), mechanisms=False)
    pieces, always = engine.index(range(1324))
    assert len(engine.table) == 2 * 1324 - 1324 // 8 and len(always) < 0.25 * len(engine.table) and len(pieces) > 1000


def test_scan_text_in_sql(spark):
    """The table function gives what Engine.scan gives, over documents and planted texts, by LATERAL."""
    patterns = [
        Pattern("K-1", "c", "medium", ALL, keywords=("ignore previous", "license")), Pattern("K-2", "c", "high", ("file",), keywords=("reveal", "token"), regex=(r"reveal\s+the\s+plan", r"token\s*=")),
        Pattern("W-1", "d", "low", ("file", "email"), regex=(r"(?is)^(?!.*harmless)(?=.*[0-9]{3})(?=.*@[a-z])",)), Pattern("X-1", "exfiltration", "high", ("file",), regex=(r"(?i)gather the api keys",)),
        Pattern("I-1", "i", "critical", ALL, keywords=("disregard",), negation_immune=True), Pattern("U-1", "u", "odd", ALL, regex=(r"oddity",)),
    ]
    engine = E.Engine(patterns)
    register_scan_text(spark, engine)
    planted = [(i, t) for i, t in PLANTED] + [(-50, "please ignore previous notes"), (-51, "never ignore previous notes, disregard"), (-52, "r3v3al the pl4n"), (-53, "\U0001f600" * 60 + " never override the earlier rules"), (-54, "an oddity"), (-55, 'example of "disregard" it'), (-56, None), (-57, "")]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    docs = docs.withColumn("channel", F.element_at(F.array(*map(F.lit, ["file", "message", "odd", "prompt", "web_content"])), (F.abs("doc_id") % 5 + 1).cast("int")))
    docs.createOrReplaceTempView("texts_to_scan")
    found = spark.sql("SELECT d.doc_id, f.* FROM texts_to_scan d, LATERAL scan_text(d.text, d.channel) f").collect()
    whole = engine.scan(docs, channel=F.col("channel")).select("doc_id", "decision", F.explode("findings").alias("f")).select("doc_id", "f.*", "decision").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, whole)) and len({r.id for r in found}) > 12
    rows = spark.sql("WITH f AS (SELECT d.doc_id, s.decision FROM texts_to_scan d, LATERAL scan_text(d.text, d.channel) s) SELECT d.doc_id, coalesce(max(f.decision), 'allow') AS decision FROM texts_to_scan d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id").collect()
    assert {r.doc_id: r.decision for r in rows} == {r.doc_id: r.decision for r in engine.scan(docs, channel=F.col("channel")).collect()}
    assert spark.sql("SELECT id, severity FROM scan_text('never ignore previous notes', 'message')").collect() == [("K-1", "review")]
