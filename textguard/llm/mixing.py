"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Token counts are summed by cell (source, language, topic). Raking multiplies the cells' shares of
the sample in turn so that each marginal meets its target, round after round. A cell cannot give
more tokens than it has, so its share is bounded by its supply in every step, and the others of its
category make up for it in later rounds. A cell's share of the sample over its supply is the
probability with which each of its documents is drawn.

A target is the natural share to the power ``temper`` (1 keeps it, 0 makes categories equal), or a
given map of shares; categories absent from a given map get none. Where a category's target is more
than its whole supply, it is taken whole and the others share the rest in proportion to their
targets; so targets can be met before raking begins, and ``marginals`` compares them with the draw.

Defined results: null text has no token; null source, language or topic is a category of its own,
written as an empty string; documents of cells without any token are kept; a document is drawn by
a hash of its id, so repeated rows, and all rows without an id, share their fate; ties do not
arise; an empty table gives no rows; other columns stay.

Scale: documents are read for the cell sums (combined before the shuffle) and again for the draw.
Raking runs on the cells only, whose number is the product of the categories' and is counted: up to
``most_cells`` they lie in one partition and are broadcast for the draw, above that marginals are
grouped and joined and the draw's join is shuffled, with the same result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh_name, word_count

DIMENSIONS = ("source", "lang", "topic")
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.8}
ROUNDS = 12
BUDGET = 0.5
SEED = 17
MOST_CELLS = 50_000

#: Parameters: kinds of text by signs or by a word that they are full of; a kind needs one for each ``WORDS_A_MARK`` words.
MARKS = {"table": "|", "symbols": "#%*&$", "code": "={;", "contact": "@"}
WORD_MARKS = {"legal": "licens"}
WORDS_A_MARK = 50


def topic_of(text: Column, words: Column) -> Column:
    """Kind of text: the one whose signs are most frequent (of equal ones the first named), prose where all are rare."""
    count = lambda t, mark: F.floor((F.octet_length(t) - F.octet_length(F.replace(t, F.lit(mark), F.lit("")))) / len(mark)).cast("int")
    found = [sum((count(text, sign) for sign in signs[1:]), count(text, signs[0])) for signs in MARKS.values()]
    found += [count(F.lower(text), word) for word in WORD_MARKS.values()]
    # the largest struct: most signs, then the first kind; inside transform it is computed once
    most = F.array_max(F.array(*[F.struct(n.alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (n, name) in enumerate(zip(found, [*MARKS, *WORD_MARKS]))]))
    kind = lambda m: F.when((m["n"] > 0) & (m["n"] * WORDS_A_MARK >= words), m["name"]).otherwise("prose")
    return F.when(text.isNotNull(), F.element_at(F.transform(F.array(most), kind), 1))


def draw(key: Column, seed: int) -> Column:
    """Uniform number in [0, 1) from a hash of the key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def reachable(shares: DataFrame) -> DataFrame:
    """``shares`` (wanted, supply) with column ``target``: min(supply, s * wanted), where s makes targets add up to 1 if supplies allow (``wanted`` need not).

    s grows until no further category runs dry; each step is one sum over the categories.
    """
    scale, dry = 0.0, -1
    while True:
        out = (F.col("wanted") > 0) & (F.lit(scale) * F.col("wanted") >= F.col("supply"))
        now = shares.agg(F.count_if(out).alias("dry"), F.coalesce(F.sum(F.when(out, F.col("supply"))), F.lit(0.0)).alias("taken"), F.coalesce(F.sum(F.when(~out, F.col("wanted"))), F.lit(0.0)).alias("rest")).first()
        if now["dry"] == dry or not now["rest"]:
            return shares.withColumn("target", F.least("supply", F.lit(scale) * F.col("wanted")))
        dry, scale = now["dry"], max(scale, (1 - now["taken"]) / now["rest"])


def rake(cells: DataFrame, targets: dict[str, dict[str, float]], temper: dict[str, float], rounds: int, budget: float | None = None, grouped: bool = False) -> DataFrame:
    """``cells`` (dimensions, tokens) with columns supply, target_<dimension> and fitted: shares of the sample that meet the targets.

    The sample holds ``budget`` of all tokens, which bounds the shares; without a budget nothing does.
    ``grouped`` groups and joins for marginals instead of using windows over cells that lie in one partition.
    """
    total = cells.agg(F.sum("tokens")).first()[0]
    if not total:
        return cells.withColumns({c: F.lit(None).cast("double") for c in ("supply", *[f"target_{d}" for d in DIMENSIONS], "fitted")})
    supply = F.col("tokens") / F.lit(budget * total) if budget else F.lit(float("inf"))
    cells = cells.withColumns({"supply": supply, "fitted": F.col("tokens") / F.lit(total)})
    for d in DIMENSIONS:
        own = cells.groupBy(d).agg(F.sum("supply").alias("supply"), F.sum("tokens").alias("tokens"))
        if d in targets:
            given = F.create_map(*[F.lit(x) for k, v in targets[d].items() for x in (k, float(v))])
            wanted = F.coalesce(F.try_element_at(given, F.col(d)), F.lit(0.0))
        else:
            wanted = F.pow(F.col("tokens"), F.lit(float(temper.get(d, 1.0))))
        met = reachable(checkpointed(own.select(d, "supply", wanted.alias("wanted")))).select(d, F.col("target").alias(f"target_{d}"))
        cells = cells.join(met, d)
    cells = checkpointed(cells if grouped else cells.coalesce(1))
    for i in range(rounds):
        for d in DIMENSIONS:
            if grouped:
                cells = cells.join(cells.groupBy(d).agg(F.sum("fitted").alias("marginal")), d)
            else:
                cells = cells.withColumn("marginal", F.sum("fitted").over(Window.partitionBy(d)))
            raised = F.when(F.col("marginal") > 0, F.col("fitted") * F.col(f"target_{d}") / F.col("marginal")).otherwise(F.lit(0.0))
            cells = cells.withColumn("fitted", F.least("supply", raised)).drop("marginal")
        if grouped or i % 4 == 3:
            cells = checkpointed(cells)
    return cells


def fitted_cells(sized: DataFrame, name: str, targets: dict[str, dict[str, float]] | None, temper: dict[str, float] | None, rounds: int, budget: float, most_cells: int) -> tuple[DataFrame, bool]:
    """The raked cells of documents with struct ``name``, with their probability; and whether they are few."""
    summed = sized.groupBy(*[F.col(f"{name}.{d}").alias(d) for d in DIMENSIONS]).agg(F.sum(f"{name}.n_tokens").cast("double").alias("tokens")).where("tokens > 0")
    cells = checkpointed(summed)
    small = cells.count() <= most_cells
    raked = rake(cells, targets or {}, TEMPER if temper is None else temper, rounds, budget, grouped=not small)
    return checkpointed(raked.withColumn("probability", F.least(F.lit(1.0), F.col("fitted") / F.col("supply")))), small


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", lang: str = "lang", topic: Column | None = None, targets: dict[str, dict[str, float]] | None = None, temper: dict[str, float] | None = None, rounds: int = ROUNDS, budget: float = BUDGET, seed: int = SEED, most_cells: int = MOST_CELLS) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns, and a struct column ``mix`` (source, lang, topic, n_tokens, probability; renamed with underscores if taken)."""
    name = fresh_name(docs, "mix")
    words = word_count(F.col(text))
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    kind = F.coalesce(topic if topic is not None else topic_of(F.col(text), words), F.lit(""))
    sized = docs.select("*", F.struct(of(source).alias("source"), of(lang).alias("lang"), kind.alias("topic"), words.alias("n_tokens")).alias(name))
    cells, small = fitted_cells(sized, name, targets, temper, rounds, budget, most_cells)
    cell, p = fresh_name(docs, "cell"), fresh_name(docs, "p")
    fitted = cells.select(F.struct(*DIMENSIONS).alias(cell), F.col("probability").alias(p))
    joined = sized.join(F.broadcast(fitted) if small else fitted, F.struct(*[F.col(f"{name}.{d}").alias(d) for d in DIMENSIONS]) == F.col(cell), "left")
    probability = F.coalesce(F.col(p), F.lit(1.0))
    drawn = joined.where(draw(F.col(doc_id), seed) < probability)
    return drawn.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(name).withField("probability", probability).alias(name))


def marginals(cells: DataFrame) -> DataFrame:
    """(dimension, category, target, fitted): how near the raked cells of ``rake`` come to the targets, for every category."""
    each = [cells.groupBy(F.lit(d).alias("dimension"), F.col(d).alias("category")).agg(F.max(f"target_{d}").alias("target"), F.sum("fitted").alias("fitted")) for d in DIMENSIONS]
    return reduce(DataFrame.unionByName, each)


def oracle_sql(temper: dict[str, float] = TEMPER, rounds: int = ROUNDS, budget: float = BUDGET, seed: int = SEED) -> str:
    """DuckDB SQL with the rows of the query over ``documents``."""
    targets = "".join(f""", c_{d} AS (SELECT {d}, sum(supply) AS supply, pow(sum(supply), {temper[d]}) / sum(pow(sum(supply), {temper[d]})) OVER () AS wanted FROM base GROUP BY {d}
), o_{d} AS (SELECT *, sum(supply) OVER w - supply AS taken, sum(wanted) OVER () - sum(wanted) OVER w + wanted AS rest, wanted / supply AS ratio FROM c_{d} WINDOW w AS (ORDER BY wanted / supply DESC, {d} ROWS UNBOUNDED PRECEDING)
), s_{d} AS (SELECT max_by((1 - taken) / rest, ratio) AS scale FROM o_{d} WHERE (1 - taken) / rest * ratio < 1
), t_{d} AS (SELECT {d}, least(supply, coalesce((SELECT scale FROM s_{d}), 1e300) * wanted) AS t_{d} FROM c_{d})""" for d in DIMENSIONS)
    joins = " ".join(f"JOIN t_{d} USING ({d})" for d in DIMENSIONS)
    steps = "".join(f", f{i + 1} AS (SELECT * REPLACE (least(supply, coalesce(w * t_{d} / nullif(sum(w) OVER (PARTITION BY {d}), 0), 0)) AS w) FROM f{i})" for i, d in enumerate(DIMENSIONS * rounds))
    counts = [" + ".join(f"strlen(text) - strlen(replace(text, '{sign}', ''))" for sign in signs) for signs in MARKS.values()]
    counts += [f"(strlen(lower(text)) - strlen(replace(lower(text), '{word}', ''))) // {len(word)}" for word in WORD_MARKS.values()]
    kinds = [*MARKS, *WORD_MARKS]
    return rf"""
WITH worded AS (
  SELECT doc_id, text, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0)::BIGINT AS n_tokens,
    {", ".join(f"{c} AS k{i}" for i, c in enumerate(counts))} FROM documents
), sized AS (
  SELECT doc_id, source, lang, n_tokens, CASE WHEN text IS NULL THEN '' WHEN m = 0 OR m * {WORDS_A_MARK} < n_tokens THEN 'prose' {" ".join(f"WHEN k{i} = m THEN '{k}'" for i, k in enumerate(kinds))} END AS topic
  FROM (SELECT *, greatest({", ".join(f"k{i}" for i in range(len(kinds)))}) AS m FROM worded)
), cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM sized GROUP BY ALL HAVING sum(n_tokens) > 0
), base AS (SELECT *, tokens / ({budget} * sum(tokens) OVER ()) AS supply, tokens / sum(tokens) OVER () AS w FROM cells){targets}
, f0 AS (SELECT * FROM base {joins}){steps}
, p AS (SELECT source, lang, topic, least(1.0, w / supply) AS probability FROM f{rounds * len(DIMENSIONS)})
SELECT doc_id, source, lang, topic, n_tokens, round(coalesce(probability, 1.0), 6) AS probability
FROM sized LEFT JOIN p USING (source, lang, topic)
WHERE ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < coalesce(probability, 1.0)
"""
