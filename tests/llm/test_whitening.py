"""Embedding whitening against numpy on whole numbers, and its defined cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.llm import whitening
from sheaf.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, x string, Deviation string, whitened int"


def brute(vectors):
    """(exact deviations, whitened, explained) of lists of whole numbers, with Python integers for everything before the eigenvectors."""
    fit = sorted(set(map(tuple, vectors)))
    n, d = len(fit), len(fit[0])
    s = [sum(v[i] for v in fit) for i in range(d)]
    deviation = [sum((n * v[i] - s[i]) ** 2 for i in range(d)) for v in vectors]
    c = np.array([[(n * v[i] - s[i]) / n for i in range(d)] for v in fit])
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:16], u[:, ::-1][:, :16]
    white = np.array([[(n * v[i] - s[i]) / n for i in range(d)] for v in vectors]) @ u / np.sqrt(e)
    return deviation, white, e / np.trace(c.T @ c / n)


def test_query_against_brute_force(spark):
    found = QUERIES["op11_embedding_whitening"](spark, SF)
    assert [f"{c} {t}" for c, t in found.dtypes] == ["vec_id bigint", "component int", "n bigint", "deviation bigint", "whitened double", "explained double", "identity_error double"]
    rows = found.toPandas().sort_values(["vec_id", "component"])
    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    deviation, white, explained = brute([tuple(math.floor(64 * float(c)) + 1_000_000 for c in r.embedding) for r in table])
    assert rows.vec_id.tolist() == [r.vec_id for r in table for _ in range(16)] and rows.component.tolist() == list(range(1, 17)) * len(table)
    assert rows.deviation.tolist() == [v for v in deviation for _ in range(16)] and set(rows.n) == {len(table)}
    got = rows.whitened.to_numpy().reshape(-1, 16)
    got *= np.sign((got * white).sum(axis=0))
    assert np.allclose(got, white, rtol=1e-6, atol=1e-8)
    assert np.allclose(rows.explained.to_numpy()[:16], explained, rtol=1e-9)
    assert 0 <= rows.identity_error.iloc[0] < 1e-9 and rows.identity_error.nunique() == 1


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0, "x", "y", 1) for i, v in vectors], VECTORS)


def test_rows_that_take_no_part_and_repeats(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(v) for v in np.float32(rng.normal(size=5))]) for i in range(40)]
    bad = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [math.nan] * 5), (103, [math.inf] + [0.0] * 4), (104, []), (105, [1.0, 2.0])]
    found, model = whitening.whiten(frame(spark, [*good, *bad, (7, good[3][1]), (None, good[4][1])]))
    rows = found.collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in rows) == sorted([(False, i) for i in range(40)] + [(False, 7), (True, 0)])
    # copies don't weigh more
    vectors = [tuple(math.floor(64 * v) + 1_000_000 for v in x) for _, x in good]
    deviation, white, _ = brute(vectors)
    of = {(r.vec_id, int(r.deviation)): r.whitened for r in rows}
    assert model.n == len(set(vectors)) and all((i, deviation[i]) in of for i in range(40)) and (7, deviation[3]) in of and (None, deviation[4]) in of
    got = np.array([of[(i, deviation[i])] for i in range(40)])
    assert np.allclose(got * np.sign((got * white).sum(axis=0)), white)
    assert np.allclose(got.T @ got / len(got), np.eye(5), atol=0.2) and model.identity_error < 1e-9


def test_no_variance_one_row_and_no_rows(spark):
    one, model = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]))
    assert [(r.vec_id, int(r.deviation), r.whitened) for r in one.orderBy("vec_id").collect()] == [(1, 0, [None, None]), (2, 0, [None, None])]
    assert model.n == 1 and model.identity_error == 0
    flat, model = whitening.whiten(frame(spark, [(i, [float(i), 2.0, -float(i)]) for i in range(9)]))
    rows = flat.orderBy("vec_id").collect()
    assert all(r.whitened[0] is not None and r.whitened[1:] == [None, None] for r in rows) and model.identity_error < 1e-9
    none, model = whitening.whiten(frame(spark, [(1, None)]))
    assert none.count() == 0 and model is None
    assert whitening.whiten(spark.createDataFrame([], VECTORS))[0].count() == 0


@pytest.mark.parametrize("size", [1e9, 1e13, 1e300])
def test_exact_with_very_large_entries(spark, size):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(v) for v in rng.normal(size=3) * size]) for i in range(12)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    found, model = whitening.whiten(df)
    whole = [tuple(math.floor(min(max(64 * v, -float(whitening.LARGEST)), float(whitening.LARGEST))) + 1_000_000 for v in x) for _, x in vectors]
    deviation, white, _ = brute(whole)
    rows = found.orderBy("vec_id").collect()
    assert [int(r.deviation) if r.deviation is not None else None for r in rows] == [v if v < 10**38 else None for v in deviation]
    if size == 1e300:  # all entries at the bounds: equal eigenvalues, whose components are any pair
        return
    got = np.array([[v or 0 for v in r.whitened] for r in rows])
    assert np.allclose(got * np.sign((got * white).sum(axis=0)), white, rtol=1e-6, atol=1e-6) and model.identity_error < 1e-6


def test_the_plan_moves_vectors_once(spark):
    rows = whitening.prepare(spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding"))
    plan = rows.select("x").distinct()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "BatchEvalPython" not in plan
    assert rows.where(F.size("x") != 64).count() == 0
