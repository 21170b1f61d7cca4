"""Pivot-table search, whitening by spectral division and periodic runs, against brute force and on odd tables."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from textguard.llm import queries, runs, topk, whitening

SF = "/root/testdata/sf0.001"
VEC = "vec_id long, embedding array<double>"


# --- pivot-table search


def brute_topk(rows, k, asks):
    """(query_id, rank, vec_id, score) in whole Python numbers."""
    hold = lambda v: max(topk.LEAST, min(topk.MOST, v))
    whole = lambda v: [hold(int(np.floor(c * 1024)) if abs(c) < 1e300 else (topk.MOST if c > 0 else topk.LEAST)) for c in v]
    good = [(i, whole(v)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    sizes = [len(v) for _, v in good]
    dims = max(set(sizes), key=lambda d: (sizes.count(d), d))
    good, best = [(i, v) for i, v in good if len(v) == dims], {}
    for q, a in good:
        for c, b in good if asks(q) else []:
            if c != q:
                score = hold(sum(x * y for x, y in zip(a, b)))
                best[q, c] = max(score, best.get((q, c), topk.LEAST))
    out = []
    for q in {q for q, _ in best}:
        near = sorted((-s, c) for (o, c), s in best.items() if o == q)[:k]
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(near)]
    return sorted(out)


def found_topk(spark, rows, k=3, step=5, **bounds):
    vectors = spark.createDataFrame(rows, VEC).repartition(3)
    return sorted(tuple(r) for r in topk.top_inner_products(vectors, F.col("vec_id") % step == 0, k=k, **bounds).collect())


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((6, 8))
    rows = [(i, (centres[i % 6] + 0.1 * rng.standard_normal(8)).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[7][1]) for i in range(50)]  # copies, more than k
    rows += [(2000 + i, np.round(rng.standard_normal(8)).tolist()) for i in range(100)]  # ties
    assert found_topk(spark, rows, pivots=8, shard_rows=64) == brute_topk(rows, 3, lambda i: i % 5 == 0)


def test_topk_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0]), (5, [1.0, 2.0]), (5, [3.0, -1.0]), (5, [1.0, 2.0]), (7, [0.0, 0.0]), (10, [0.0, -0.0]), (8, None), (15, []), (20, [1.0, None]),
        (25, [float("nan"), 1.0]), (30, [float("inf"), 1.0]), (35, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (40, [1e200, -1e200]), (45, [1e300, 1.0]), (50, [-3e9, 4e9]), (55, [1e-200, 1e-200]),
    ]
    assert found_topk(spark, rows) == brute_topk(rows, 3, lambda i: i % 5 == 0)
    assert found_topk(spark, rows[:1]) == [] and found_topk(spark, rows[6:7]) == []
    clash = spark.createDataFrame([(0, [1.0], 1, 2), (5, [2.0], 3, 4)], VEC + ", x int, h1 int")
    assert [tuple(r) for r in topk.top_inner_products(clash, F.col("vec_id") == 0).collect()] == [(0, 1, 5, 1024 * 2048)]


def test_topk_prunes_and_keeps_ties():
    rng = np.random.default_rng(1)
    centres = rng.integers(-300, 300, (10, 16))
    x = np.repeat(centres, 300, 0) + rng.integers(-5, 5, (3000, 16))
    ids = [[i] for i in range(3000)]
    held = topk.Pivots(topk.spread_pivots(x[::20].astype(float), 10))
    asked, counted, real = x[::100], [], topk.exact_products
    topk.exact_products = lambda a, b: counted.append(len(a) * len(b)) or real(a, b)
    try:
        found = topk.search_shard(held, x, ids, asked, [None] * len(asked), 4)
    finally:
        topk.exact_products = real
    for j, best in enumerate(found):
        scores = x @ asked[j]
        want = sorted(range(3000), key=lambda i: (-scores[i], i))[:5]
        assert best.rows.tolist()[:5] == want
    assert sum(counted) < 0.7 * len(asked) * 3000


def test_topk_inner_products_are_exact():
    rng = np.random.default_rng(2)
    for size in (1000, 10**6, 10**9, 2**62):
        a, b = (rng.integers(-size, size, (20, 7)) for _ in range(2))
        want = [[max(topk.LEAST, min(topk.MOST, sum(int(p) * int(q) for p, q in zip(r, s)))) for s in b] for r in a]
        assert topk.exact_products(a, b).tolist() == want


# --- whitening


def reference_whitening(vectors, count):
    x = np.floor(256 * np.array(vectors)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, mean = len(fit), fit.mean(0)
    values, axes = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    order = np.argsort(-values)[:count]
    return ((n * x - fit.sum(0)) ** 2).sum(1), (x - mean) @ axes[:, order] / np.sqrt(values[order]), values[order] / values.sum(), n


def test_whitening_against_eigh(spark):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((300, 6)) @ rng.standard_normal((6, 6))
    vectors = np.vstack((vectors, np.repeat(vectors[:1], 200, 0)))  # copies count once
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], VEC)
    got = whitening.whiten(frame.repartition(3)).orderBy("vec_id", "component").toPandas()
    deviation, white, explained, n = reference_whitening(vectors, 4)
    values = got.whitened.to_numpy().reshape(-1, 4)
    assert np.abs(values * np.sign((values * white).sum(0)) - white).max() < 1e-9
    assert (got.deviation.to_numpy().reshape(-1, 4) == deviation[:, None]).all() and set(got.n) == {n}
    assert np.allclose(got.explained.to_numpy().reshape(-1, 4), explained) and got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1


@pytest.mark.parametrize("spectrum", [[5, 4, 3, 2, 1], [7, 7, 7, 7], [9, 9, 3, 3, 3, 1, 0, 0], [1e12, 1.0, 1e-3], [1.0], [2, 1], [0, 0, 0], [4, 4, 4, 4, 4, 1e-9], list(range(40, 0, -1))])
def test_components_by_division(spectrum):
    rng = np.random.default_rng(len(spectrum))
    for turned in (True, False):
        turn = np.linalg.qr(rng.standard_normal((len(spectrum), len(spectrum))))[0] if turned else np.eye(len(spectrum))
        a = turn @ np.diag(spectrum) @ turn.T
        values, axes = whitening.principal_components((a + a.T) / 2, 4)
        size = max(spectrum) or 1
        assert np.allclose(values, sorted(spectrum, reverse=True)[:4], rtol=0, atol=1e-12 * size)
        assert np.abs(a @ axes - axes * values).max() < 1e-12 * size and np.allclose(axes.T @ axes, np.eye(len(values)), atol=1e-12)


def test_polar_factor_is_orthogonal():
    rng = np.random.default_rng(5)
    a = rng.standard_normal((12, 12))
    u = whitening.polar_factor(a + a.T)
    assert np.abs(u @ u - np.eye(12)).max() < 1e-12 and np.linalg.eigvalsh(u @ (a + a.T)).min() > -1e-12


def test_whitening_odd_rows(spark):
    rows = [(1, [1.0, 0.5]), (1, [1.0, 0.5]), (None, [0.25, -0.5]), (3, [0.0, -0.0]), (4, None), (5, []), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [1.0, float("-inf")]), (9, [1.0, 2.0, 3.0])]
    got = whitening.whiten(spark.createDataFrame(rows, VEC)).toPandas()
    assert len(got) == 8 and set(got.n) == {3} and set(got.component) == {1, 2}
    deviation, white, _, _ = reference_whitening([v for _, v in rows[:4]], 2)
    assert sorted(got[got.component == 1].deviation) == sorted(deviation)
    assert np.allclose(sorted(np.abs(got[got.component == 1].whitened)), sorted(np.abs(white[:, 0])))
    assert whitening.whiten(spark.createDataFrame(rows[:2], VEC)).count() == 0 == whitening.whiten(spark.createDataFrame(rows[4:5], VEC)).count()
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300]), (2, [-1e300]), (3, [0.0])], VEC)).toPandas()
    assert len(huge) == 3 and huge.deviation.max() == whitening.LARGEST and np.isfinite(huge.whitened).all()
    clash = whitening.whiten(spark.createDataFrame([(1, [1.0], 2), (2, [2.0], 3)], VEC + ", x int")).toPandas()
    assert sorted(clash.whitened) == [-1.0, 1.0]


def test_deviations_are_exact():
    x = np.array([[3, -5], [2**61, -(2**62)]])
    assert whitening.deviations(x[:1], 7, [2, 3]).tolist() == [(21 - 2) ** 2 + (-35 - 3) ** 2]
    assert whitening.deviations(x, 7, [2, 3]).tolist() == [(21 - 2) ** 2 + (-35 - 3) ** 2, whitening.LARGEST]


# --- periodic runs


def brute_runs(words, least, times):
    out = []
    for period in range(1, len(words)):
        i = 0
        while i + period < len(words):
            j = i
            while j + period < len(words) and words[j] == words[j + period]:
                j += 1
            size = j + period - i
            if j > i and size >= max(least, times * period) and not any(all(words[x] == words[x + p] for x in range(i, i + size - p)) for p in range(1, period)):
                out.append((i, size, period))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_brute_force():
    rng = random.Random(6)
    for _ in range(600):
        words = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 30))]
        if words and rng.random() < 0.6:
            a, p = rng.randrange(len(words)), rng.randint(1, 9)
            words = words[:a] + [words[min(len(words) - 1, a + i % p)] for i in range(len(words) - a + 12)] + [rng.randrange(3) for _ in range(9)]
        for least, times in ((6, 4), (2, 2), (9, 3)):
            want = brute_runs(words, least, times)
            assert runs.runs_of(words, least, times) == want == runs.runs_of(words, least, times, prune=False)


def test_collapsed_against_brute_force():
    rng = random.Random(7)
    for _ in range(300):
        words = [b"%d" % rng.randrange(2) for _ in range(rng.randint(0, 40))]
        found = runs.runs_of(words, 2, 2)
        dropped = {i for start, length, period in found for i in range(start + period, start + length)}
        assert runs.collapsed(words, found) == b" ".join(w for i, w in enumerate(words) if i not in dropped)


def test_runs_of_odd_texts(spark):
    texts = [None, "", " \t\n", "a", "a a a a a a", "x " * 30_000, "ha ho   " * 5, "\U0001f600 b " * 4]
    rows = [(i % 7, t, 9, "r") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long, runs string")
    got = [(r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.find_runs(docs.coalesce(1)).collect()]
    assert got[:5] == [(0, [], ""), (0, [], ""), (0, [], ""), (1, [], "a"), (6, [(0, 6, 1)], "a")]
    assert got[5] == (30_000, [(0, 30_000, 1)], "x") and got[6] == (15, [(0, 15, 3)], "ha ho  ") and got[7] == (8, [(0, 8, 2)], "\U0001f600 b")
    assert runs.find_runs(docs.limit(0)).count() == 0
    best = spark.sql("SELECT array(named_struct('start', 5L, 'length', 8L, 'period', 2L), named_struct('start', 1L, 'length', 8L, 'period', 1L)) a, cast(array() as array<struct<start:bigint,length:bigint,period:bigint>>) b")
    row = best.select(runs.longest_run(F.col("a")).alias("a"), runs.longest_run(F.col("b")).alias("b"), runs.listed_runs(F.col("a")).alias("l"), runs.listed_runs(F.col("b")).alias("m")).first()
    assert tuple(row.a) == (1, 8, 1) and row.b is None and row.l == "5,8,2\n1,8,1\n" and row.m == ""


def test_runs_query_against_brute_force(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        words, h = (text or "").encode().split(), zlib.crc32(str(doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        found = brute_runs(words, 6, 4) if n < 400 else runs.runs_of(words, prune=False)
        dropped = {i for start, length, period in found for i in range(start + period, start + length)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
        row = got[doc_id]
        assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (len(found), *best, 1000 * best[1] // best[2] if found else None)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{z},{p}\n" for s, z, p in found).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest()


def test_whitening_and_search_on_tables(spark):
    got = queries.op12_qdwh_whitening(spark, SF).toPandas()
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' ORDER BY 1").fetchall()
    deviation, white, explained, n = reference_whitening([v for _, v in rows], 4)
    values = got.sort_values(["vec_id", "component"]).whitened.to_numpy().reshape(-1, 4)
    assert np.abs(values * np.sign((values * white).sum(0)) - white).max() < 1e-8
    assert got.groupby("component").explained.first().to_numpy() == pytest.approx(explained, rel=1e-9) and got.identity_error.max() < 1e-9
