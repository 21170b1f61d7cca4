"""Keywords looked up in the index of clean texts, against reading the texts."""

import random

import pytest

from textguard.operators import cards, word_index


@pytest.mark.parametrize("keyword,parts", [("a b", (["a", "b"], ["", " ", ""])), ("/etc/x-", (["etc", "x"], ["/", "/", "-"])), ("é1", (["é1"], ["", ""])), ("--", ([], ["--"])), ("a_b", (["a", "b"], ["", "_", ""]))])
def test_split_keyword(keyword, parts):
    assert word_index.split_keyword(keyword) == parts


def test_index_gives_what_reading_gives(spark, tmp_path):
    rng = random.Random(8)
    letters = ["a", "b", "ab", "1", "é", " ", " ", ".", "-", "_", "\n", "  "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(120)] + [None, "", "A b.", "ab", "...", "x" * 5000 + " A-B"]
    texts += texts[:30]  # copies are documents of their own
    clean = spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string").repartition(3)
    wanted = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(400)} | {"a", "ab", "A B", "b.", ".a", "a b", "-b-", "a-b", "zzz"}
    wanted = sorted(k for k in wanted if word_index.split_keyword(k)[0])
    index = word_index.build_index(clean, "t", "doc_id", str(tmp_path / "index"))
    found = {r.keyword: r.n_docs for r in word_index.keyword_docs(index, wanted).collect()}
    assert found == {r.keyword: r.n_docs for r in cards.clean_corpus_hits(clean, "t", wanted).collect()} and len(found) > 100
    again = word_index.read_index(spark, str(tmp_path / "index"))
    assert {r.keyword: r.n_docs for r in word_index.keyword_docs(again, ["A", "zzz"]).collect()} == {"a": found["a"]}
    with pytest.raises(ValueError):
        word_index.keyword_docs(index, ["--"])


def test_a_lookup_does_not_read_the_texts(spark, tmp_path):
    source = str(tmp_path / "clean")
    spark.createDataFrame([(1, "the api key"), (2, "an API")], "doc_id long, t string").write.parquet(source)
    index = word_index.build_index(spark.read.parquet(source), "t", "doc_id", str(tmp_path / "index"))
    found = word_index.keyword_docs(index, ["api", "api key", "pi"])
    assert source not in found._jdf.queryExecution().optimizedPlan().toString() and not [f for f in found.inputFiles() if source in f]
    assert {r.keyword: r.n_docs for r in found.collect()} == {"api": 2, "api key": 1, "pi": 2}
    made = spark.createDataFrame([("AB-1", "n", "c", "low", ["file"], ["api key"], ["x"])], "id string, name string, category string, severity string, channel array<string>, keywords array<string>, regex array<string>")
    assert cards.lint(made, clean=found).first().violations == ["keyword_in_clean_texts"]
