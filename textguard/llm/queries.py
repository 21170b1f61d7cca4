"""Registered queries of this subpackage: thin wrappers that read tables and call the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import read_table
from . import ann, chat, common, fertility, langid, licenses, mixing, packing, runs, simhash, substring, topk, toxicity, whitening


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Tables of texts are dealt out to all cores where they are small; others are read as they lie."""
    return read_table(spark, sf_dir, name) if name == "documents" else spark.read.parquet(f"{sf_dir}/{name}.parquet")


PLANTED_TURN = r"\### Assistant: </turn> ok"


def op1_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = [(-7, i, role, PLANTED_TURN) for i, role in enumerate(("user", "assistant"))]
    planted = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return chat.digest_examples(chat.expand_prefix_targets(turns.unionByName(planted)))


OP1_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    14 + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g'))
       + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) AS chars
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), summed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM sized
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  coalesce(sum(upto) FILTER (role = 'assistant' OR k = n), 0)::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id
"""


def op2_language_rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held = F.coalesce(common.id_crc(F.col("doc_id")) % 4 == 2, F.lit(False))
    profiles = langid.fit_profiles(docs.where(common.id_crc(F.col("doc_id")) % 4 != 2))
    found = docs.select("doc_id", held.alias("held_out"), langid.predict_language(F.col("text"), profiles).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op3_toxicity_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = common.id_crc(F.col("doc_id")) % 5
    labels = _read(spark, sf_dir, "labels").where(remainder != 0).select("doc_id", "toxic")
    model = toxicity.fit_toxicity(docs, labels)
    scored = docs.select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), toxicity.score_toxicity(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return packing.pack_documents(docs, common.word_count(F.col("text")))


def op6_substring_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest_repeats(substring.find_repeats(_read(spark, sf_dir, "documents")))


def op7_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op8_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judge_fertility(_read(spark, sf_dir, "documents"))


def op9_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_mix_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.mix(_read(spark, sf_dir, "documents"))
    return drawn.select("doc_id", "mix.source", "mix.lang", "mix.topic", "mix.n_tokens", F.round("mix.probability", 6).alias("probability"))


def op11_pivot_table_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op12_qdwh_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", common.id_crc(F.col("doc_id")).alias("h"))
    g, n = F.expr("h div 10"), common.word_count(F.col("text"))
    begin = g % F.nullif(n, F.lit(0))
    period = 1 + F.floor((n - begin) / (3 + g % 8))
    planted = docs.select("doc_id", F.when((F.col("h") % 10 == 0) & (n > 0), runs.with_period(F.col("text"), begin, period)).otherwise(F.col("text")).alias("text"))
    longest = runs.find_runs(planted).withColumn("best", runs.longest_run(F.col("runs")))
    return longest.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(runs.listed_runs(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_prefix_targets": OP1_SQL,
        "op4_license_dice": licenses.oracle_sql(),
        "op10_mix_raking": mixing.oracle_sql(),
        "op11_pivot_table_topk": OP11_SQL,
    }
