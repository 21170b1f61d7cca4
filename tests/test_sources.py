"""Line logs as a data source, files by row, and streams that restart or replay."""

import json
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from textguard.operators import cards, crawlers
from textguard.sources import files_by_row, lines
from textguard.streaming import scan_stream

ACCESS = ['1.2.3.4 - - [x] "GET /" 200 5 "-" "GPTBot/1"', '5.6.7.8 - - [x] "GET /" 200 5 "agent é"', "no line", "", '9.9.9.9 - - [x] "GET /" 200 5 ""']


@pytest.mark.parametrize("ending,last", [("\n", True), ("\r\n", True), ("\n", False)])
def test_ranges_give_every_line_once(tmp_path, ending, last):
    rng = random.Random(3)
    body = [("x" * rng.choice([0, 1, 5, 40])) for _ in range(60)]
    raw = (ending.join(body) + (ending if last else "")).encode()
    path = tmp_path / "f"
    path.write_bytes(raw)
    want, at = [], 0
    for line in raw.split(b"\n"):
        want.append((at, line.removesuffix(b"\r")))
        at += len(line) + 1
    want = [w for w in want if w[1]]
    for size in (1, 2, 7, 64, 10_000):
        lines_read = []
        for begin in range(0, len(raw), size):
            with open(path, "rb") as opened:
                lines_read += [x for x in lines.lines_of(opened, begin, begin + size) if x[1]]
        assert lines_read == want


def test_line_logs(spark, tmp_path):
    (tmp_path / "logs" / "b").mkdir(parents=True)
    (tmp_path / "logs" / "a.log").write_text("\n".join(ACCESS) + "\n")
    (tmp_path / "logs" / "b" / "c.log").write_text("\n".join(ACCESS[:2] * 50))
    (tmp_path / "logs" / "_SUCCESS").write_text("no log")
    got = lines.read_lines(spark, str(tmp_path / "logs"), range_bytes=100)
    assert got.rdd.getNumPartitions() > 30
    rows = sorted(got.collect(), key=lambda r: (r.file, r.offset))
    assert [(r.ip, r.user_agent, r.malformed) for r in rows[:4]] == [("1.2.3.4", "GPTBot/1", None), ("5.6.7.8", "agent é", None), (None, None, "no line"), ("9.9.9.9", "", None)]
    assert [r.ip for r in rows[4:]] == ["1.2.3.4", "5.6.7.8"] * 50 and {os.path.basename(r.file) for r in rows} == {"a.log", "c.log"}
    found = crawlers.verify_claims(got.where("malformed is null"), spark.createDataFrame([("openai_train", "1.2.3.0/24")], "vendor string, cidr string"))
    assert {r.claim: r.verified for r in found.collect()} == {"GPTBot (training)": 51, "all": 51}

    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "x.csv").write_text(' ClientIP ,other,UA\n1.1.1.1,x,"a, b"\n,x,y\n 2.2.2.2 ,x\n')
    (tmp_path / "csv" / "y.csv").write_text("user_agent,ip\nz,3.3.3.3\n")
    rows = lines.read_lines(spark, str(tmp_path / "csv"), "csv", range_bytes=16).orderBy("file", "offset").collect()
    assert [(r.ip, r.user_agent, r.malformed) for r in rows] == [("1.1.1.1", "a, b", None), (None, None, ",x,y"), ("2.2.2.2", "", None), ("3.3.3.3", "z", None)]

    (tmp_path / "r.jsonl").write_text('{"ts": "1", "n": {"a": 1}}\nbroken\n[1]\n{"ts": null}\n')
    rows = lines.read_lines(spark, str(tmp_path / "r.jsonl"), "json", ["ts", "n"]).orderBy("offset").collect()
    assert [(r.ts, r.n, r.malformed) for r in rows] == [("1", '{"a": 1}', None), (None, None, "broken"), (None, None, "[1]"), (None, None, None)]
    (tmp_path / "empty").mkdir()
    assert lines.read_lines(spark, str(tmp_path / "empty")).count() == 0
    with pytest.raises(Exception, match="unknown kind"):
        lines.read_lines(spark, str(tmp_path / "r.jsonl"), "xml").count()


def test_receipts_keep_the_order_of_files(spark, tmp_path):
    """Receipts of several files, read in ranges: file and offset give their order back."""
    (tmp_path / "r").mkdir()
    for day in ("2024-01-02", "2024-01-01"):
        (tmp_path / "r" / f"{day}.jsonl").write_text("".join(json.dumps({"ts": f"{day}T{i:02d}", "decision": "deny"}) + "\n" for i in range(24)))
    rows = lines.read_lines(spark, str(tmp_path / "r"), "json", ["ts", "decision"], range_bytes=50).orderBy("file", "offset").collect()
    assert [r.ts for r in rows] == [f"{d}T{i:02d}" for d in ("2024-01-01", "2024-01-02") for i in range(24)]


def test_one_file_for_each_card(spark, tmp_path):
    schema = "id string, name string, category string, severity string, channel array<string>, keywords array<string>, regex array<string>"
    made = spark.createDataFrame([("A-1", "First One!", "prompt_injection", "high", ["file"], ["k"], ["r"]), ("A-2", "second", "c2", None, None, None, None), ("A-3", None, None, "low", [], [], [])], schema).repartition(3)
    none = spark.createDataFrame([], "file string, date_added string")
    path = str(tmp_path / "db")
    cards.write_export(cards.exported(made, none, F.lit("2024-01-01")), path)
    tree = lambda: {os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names}
    assert tree() == {"prompt-injection/A-1-first-one.json", "c2/A-2-second.json", "uncategorized/A-3-unnamed.json"}
    card = json.loads((tmp_path / "db" / "prompt-injection" / "A-1-first-one.json").read_text())
    assert card["id"] == "A-1" and card["channels"] == ["file"] and card["date_added"] == "2024-01-01" and os.listdir(path).count("_job") == 0
    # a second run keeps the dates of what was there, and a new card gets the new one
    more = made.union(spark.createDataFrame([("A-4", "new", "c2", "low", [], [], [])], schema))
    cards.write_export(cards.exported(more, cards.read_export(spark, path), F.lit("2025-05-05")), path)
    dates = {r.file: r.date_added for r in cards.read_export(spark, path).collect()}
    assert dates == {"A-1-first-one.json": "2024-01-01", "A-2-second.json": "2024-01-01", "A-3-unnamed.json": "2024-01-01", "A-4-new.json": "2025-05-05"}


def test_a_failed_export_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([("a", f"{i}.json", "x") for i in range(20)] + [("..", "bad", "y")], "folder string, file string, body string")
    with pytest.raises(Exception, match="no file name"):
        files_by_row.write_files(rows, path)
    assert [f for _, _, names in os.walk(path) for f in names] == [] and not [d for d in (os.listdir(path) if os.path.exists(path) else []) if not d.startswith("_job")]
    files_by_row.write_files(rows.where("folder = 'a'"), path)
    assert sorted(os.listdir(path)) == ["a"] and len(os.listdir(path + "/a")) == 20
    with pytest.raises(Exception, match="exist"):
        rows.where("folder = 'a'").write.format("textguard_files").mode("append").save(path)
    assert sorted(os.listdir(path)) == ["a"]


def run(query, path):
    started = query.option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    started.awaitTermination(180)
    assert started.exception() is None
    started.stop()


@pytest.fixture()
def small_shuffles(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", scan_stream.STATE_STORE)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_pins_are_state(spark, tmp_path, small_shuffles):
    """The first digest by event time is pinned, not the smallest; state outlives a restart; a hot tool comes in parts."""
    folder = tmp_path / "in"
    folder.mkdir()
    write = lambda name, rows: (folder / name).write_text("".join(json.dumps(dict(zip(("ts", "tool", "sha256"), r))) + "\n" for r in rows))
    write("a.json", [("2024-01-01T05:00:00", "t", "1"), ("2024-01-01T04:00:00", "t", "2"), ("2024-01-01T06:00:00", "t", "2"), ("2024-01-01T05:00:00", "t", None), (None, "u", "9"), ("2024-01-01T00:00:00", "v", None)])
    read = lambda: spark.readStream.schema("ts timestamp, tool string, sha256 string").option("maxFilesPerTrigger", 1).json(str(folder))
    keep = lambda: scan_stream.pin_on_first_use(read()).writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append")
    run(keep(), tmp_path / "check")
    got = lambda: sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    first = [("t", "1", "changed", 1), ("t", "2", "new", 2), ("t", None, "changed", 1), ("u", "9", "new", 1), ("v", None, "changed", 1)]
    assert got() == first
    write("b.json", [("2023-01-01T00:00:00", "t", "1"), ("2024-02-01T00:00:00", "v", "5")] + [("2024-01-02T00:00:00", "t", "2")] * 30_000)
    run(keep(), tmp_path / "check")
    assert got() == sorted([*first, ("t", "1", "changed", 1), ("t", "2", "ok", 30_000), ("v", "5", "new", 1)], key=str)


def test_first_use_reads_parts_without_keeping_rows():
    class Kept:
        def __init__(self):
            self.value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    state = scan_stream.FirstUse()
    state.pinned = Kept()
    parts = (pd.DataFrame({"tool": "t", "sha256": [f"d{i % 3}"] * 10_000, "ts": pd.Timestamp("2024-01-01") + pd.Timedelta(hours=5 - i % 3)}) for i in range(100))
    (out,) = state.handleInputRows(("t",), parts, None)
    assert sorted(map(tuple, out.values)) == [("t", "d0", "changed", 340_000), ("t", "d1", "changed", 330_000), ("t", "d2", "new", 330_000)]


def test_calls_are_logged_once(spark, tmp_path, small_shuffles):
    """Repeated calls are dropped by the watermark, and a replayed batch changes no file."""
    folder, log = tmp_path / "in", str(tmp_path / "log")
    folder.mkdir()
    write = lambda name, rows: (folder / name).write_text("".join(json.dumps({"ts": t, "call_id": c}) + "\n" for t, c in rows))
    stream = lambda: scan_stream.calls_once(spark.readStream.schema("ts timestamp, call_id string").option("maxFilesPerTrigger", 1).json(str(folder)))
    write("a.json", [("2024-01-01T10:00:00", "x"), ("2024-01-01T10:00:00", "x"), ("2024-01-02T00:10:00", "y")])
    run(scan_stream.daily_log(stream(), log, str(tmp_path / "check")), tmp_path / "check")
    write("b.json", [("2024-01-02T00:20:00", "y"), ("2024-01-01T09:00:00", "late"), ("2024-01-02T00:30:00", "z")])
    run(scan_stream.daily_log(stream(), log, str(tmp_path / "check")), tmp_path / "check")
    rows = lambda: sorted((str(r.day), r.call_id) for r in scan_stream.read_daily_log(spark, log, "ts timestamp, call_id string").collect())
    assert rows() == [("2024-01-01", "x"), ("2024-01-02", "y"), ("2024-01-02", "z")]
    # without the mark of the last batch in the checkpoint the batch runs again: its folder is whole, so nothing is written
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(log) for f in names}
    before = files()
    commits = sorted((p for p in (tmp_path / "check" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    run(scan_stream.daily_log(stream(), log, str(tmp_path / "check")), tmp_path / "check")
    assert files() == before
