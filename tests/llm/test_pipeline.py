"""Every stage of the pipeline against a plain version on small tables."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from textguard.llm import common, langid

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, len(t or "")) for i, t, lang, src in rows], COLUMNS)


def test_language_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*[c.split()[0] for c in COLUMNS.split(", ")])
    strange = [(-1, None, None, "s"), (-2, "12 %", None, "s"), (-3, "\u03b1\u03b2\u03b3 \u03b4\u03b5\u03b6 " * 30, None, "s"), (-4, "zq xk wv jq vx kz qw " * 20, None, "s")]
    both = docs.unionByName(table(spark, strange))
    kept = pipeline.identify_language(spark, both, SF)
    profiles = langid.fit_profiles(both)
    want = sorted(r.doc_id for r in both.collect() if (p := profiles.predict(r.text))[0] != "und" and p[1] >= pipeline.LEAST_LIKENESS)
    assert sorted(r.doc_id for r in kept.collect()) == want and min(want) >= 0 and len(want) > 0.95 * docs.count()
    assert kept.columns == both.columns and pipeline.identify_language(spark, docs.limit(0), SF).count() == 0


def test_near_duplicate_stage(spark):
    a, b = "one two three four five six", "Seven eight nine ten eleven twelve"
    rows = [(5, a, "x", "s"), (2, a.upper(), None, "s"), (2, b, "x", "s"), (2, b, "x", "s"), (9, b, "y", None), (None, a, "x", "s"), (None, "alone in the world here", "x", "s"), (None, "alone in the world here", "x", "s"), (7, None, None, None), (8, "", None, None)]
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.text or "") for r in pipeline.drop_near_duplicates(spark, table(spark, rows), SF).collect())
    assert got == [(-1, "alone in the world here"), (2, a.upper()), (2, b), (7, "")]
    mapped = table(spark, rows).withColumn("key1", F.lit("x")).withColumn("extra", F.create_map(F.lit("a"), F.lit(1)))
    assert pipeline.drop_near_duplicates(spark, mapped, SF).count() == 4
    assert pipeline.drop_near_duplicates(spark, table(spark, []), SF).count() == 0


def test_passage_stage(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(1, f"head\n{passage} tail", "x", "s"), (2, f"other {passage}  end", "x", "s"), (3, None, "x", "s"), (None, passage, "x", "s"), (2, "short", "x", "s")]
    got = {(r.doc_id, r.text, r.n_chars) for r in pipeline.cut_repeated_passages(spark, table(spark, rows), SF).collect()}
    assert got == {(1, rows[0][1], len(rows[0][1])), (2, "other end", 9), (3, None, None), (None, passage, len(passage)), (2, "short", 5)}
    assert pipeline.cut_repeated_passages(spark, table(spark, []), SF).count() == 0


def test_mixing_and_packing_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = pipeline.mix_sources(spark, docs, SF)
    assert mixed.columns == docs.columns and 0.3 < mixed.count() / docs.count() < 0.8
    packed = pipeline.pack_sequences(spark, mixed, SF).toPandas()
    words = mixed.select(F.sum(common.word_count(F.col("text")))).first()[0]
    assert packed.length.sum() == words
    filled = packed.dropna(subset=["bin"]).groupby(["shard", "bin"]).agg({"length": "sum", "capacity": ["min", "max"]}).to_numpy().astype(np.int64)
    assert (filled[:, 0] <= filled[:, 1]).all() and (filled[:, 1] == filled[:, 2]).all()
    empty = docs.limit(0)
    assert pipeline.mix_sources(spark, empty, SF).count() == pipeline.pack_sequences(spark, empty, SF).count() == 0


def test_whole_pipeline(spark):
    assert [name for name, _ in pipeline.STAGES] == ["language_id", "simhash_dedup", "substring_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    rows = lambda d: sorted((r.doc_id, r.piece, r.start, r.length) for r in d.collect())
    assert rows(pipeline.run(spark, SF)) == rows(docs)


def test_stored_tables_are_freed(spark):
    made, path = common.store(spark.range(1000))
    assert made.count() == 1000
    common.release(made, path)
    assert spark.read.parquet(path).count() == 0
