"""Normalisation at size: the fast regexes say what the plain ones say, and cost a few passes over the text."""

import re
import sys
import time

from pyspark.sql import functions as F

from textguard.functions import text as T
from textguard.plans.table_functions import normal_form


def test_fast_regexes_know_every_character(spark):
    """Over all code points, and over what stands in several characters, is_decodable says what decodable() says."""
    plain = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m.group(1), 16):08X}", T.decodable()))
    points = spark.range(sys.maxunicode + 1).where("id < 55296 or id > 57343")
    char = F.decode(F.unhex(F.concat(F.lit("00000061"), F.lpad(F.hex("id"), 8, "0"))), "UTF-32")
    found = points.select("id", T.is_decodable(char).alias("moves"), F.rlike(char, F.lit(T._GOING)).alias("goes")).where("moves or goes").collect()
    all_points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    assert {r.id for r in found if r.moves} == {c for c in all_points if plain.search("a" + chr(c))}
    assert {r.id for r in found if r.goes} == {c for c in all_points if T._PYTHON_INVISIBLE.search(chr(c)) or chr(c) == T.VIEW_MARK}
    texts = ["&", "&#", "&a", "& a", "%4", "%4g", "x%4F", "\\x4", "\\x4f", "\\y4f", "/" * 19, "é" + "+9aZ" * 5, "a" * 19 + "é" + "a" * 19, "", None, "%é&", "\\%&#"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.is_decodable(F.col("t")).alias("moves")).collect()
    assert {r.t: r.moves for r in rows} == {t: None if t is None else bool(plain.search(t)) for t in texts}


def test_normal_form_of_odd_texts(spark):
    """The plan gives what the same steps give in Python."""
    pieces = ["x", " ", "l", "a.b.c", "1-g-n", "h e l p", " \t", "\n\n", "\r", "\x1c", "\x85", "\u00a0", "\u200b", T.VIEW_MARK, "&#105;", "%72", "\u0435", "e\u0301", "\U0001f600", "lgnore", "_", "aWdub3JlIGV2ZXJ5dGhpbmcgbm93"]
    texts = [a + b + c for a in pieces for b in pieces for c in ("", "l4", " z")] + ["l" * 2001 + p for p in pieces]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.normalize(F.col("t")).alias("n")).collect()
    assert {r.i: r.n for r in rows} == {i: normal_form(t) for i, t in enumerate(texts)}


def test_normalisation_costs_a_few_passes(spark):
    """Prose is normalised in little more time than it takes to strip it of invisible characters; the class of decodable() took hundreds of times a pass."""
    prose = F.repeat(F.lit("Ein schöner Tag für 3 lange Wörter, und noch ein Satz dazu. "), 200)
    docs = spark.range(800, numPartitions=4).select(F.concat(prose, F.col("id")).alias("t")).cache()
    assert docs.count() == 800

    def seconds(column):
        took = []
        for _ in range(3):
            began = time.time()
            docs.select(F.sum(F.length(column))).collect()
            took.append(time.time() - began)
        return min(took)

    assert seconds(T.normalize(F.col("t"))) < 5 + 5 * seconds(T.strip_invisible(F.col("t")))


def test_one_arrow_udf_normalises(spark):
    """Texts go to Python at most once, and a column made by another Arrow UDF over the normal form can be evaluated."""
    docs = spark.createDataFrame([(1, "h e l p &amp; l1ke"), (2, None), (3, "plain")], "i int, t string")
    normal = docs.select("i", T.normalize(F.col("t")).alias("n"))
    assert normal._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    size = F.pandas_udf(lambda texts: texts.str.len().fillna(-1).astype("int64"), "long")
    got = {r.i: (r.n, r.size) for r in normal.withColumn("size", size("n")).collect()}
    assert all(size == (-1 if n is None else len(n)) for n, size in got.values()) and got[1][0].startswith("help & like")
