from __future__ import annotations

import math

import numpy as np
import pytest

from billcycle.llm import whitening
from billcycle.llm.whitening import op13_whitening, whiten

SCHEMA = "vec_id long, embedding array<double>"


def reference(rows, components=4):
    """x, n, exact deviation and numpy's eigenvectors for the usable rows of one length."""
    kept = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.stack([v for _, v in kept])
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - total / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-9 * values[0]).sum()))
    exact = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, total, strict=True)) for row in x]
    return [i for i, _ in kept], x, n, total, exact, values, vectors, k


def check(df, rows):
    ids, x, n, total, exact, values, vectors, k = reference(rows)
    found = df.collect()
    assert len(found) == len(ids) * k and {r.n for r in found} == {n} and {r.component for r in found} == set(range(1, k + 1))
    assert sorted((r.vec_id, r.deviation) for r in found if r.component == 1) == sorted(zip(ids, exact, strict=True))
    assert {r.identity_error for r in found} == {found[0].identity_error} and found[0].identity_error < 1e-9
    gaps = np.abs(np.diff(values[: k + 1])) > 1e-6 * values[0]
    expected = (x - total / n) @ vectors[:, :k] / np.sqrt(values[:k])
    for c in range(1, k + 1):
        own = {r.vec_id: r for r in found if r.component == c}
        got = np.array([own[i].whitened for i in ids])
        assert own[ids[0]].explained == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
        if (c == 1 or gaps[c - 2]) and (c > len(gaps) or gaps[c - 1]):  # a component of its own
            assert np.abs(got - expected[:, c - 1] * np.sign(got @ expected[:, c - 1])).max() < 1e-9


def test_against_numpy_with_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(9) * np.linspace(3, 0.1, 9)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[4][1]) for i in range(150)]  # a third are copies, fitted once
    rows += [(2000, None), (2001, [math.nan] * 9), (2002, [None] + [1.0] * 8), (2003, [math.inf] * 9), (2004, [])]
    rows += [(2005, [-0.0, 0.0, -1e-9] * 3)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    check(op13_whitening(spark, str(tmp_path)), rows)


def test_equal_eigenvalues_and_few_dimensions(spark):
    """The axes in both directions: all eigenvalues are the same, and one start finds one direction only."""
    rows = [(i, (np.eye(3)[i % 3] * (1 if i < 3 else -1)).tolist()) for i in range(6)]
    check(whiten(spark.createDataFrame(rows, SCHEMA)), rows)


def test_rank_and_vectors_that_are_all_equal(spark):
    rng = np.random.default_rng(3)
    flat = rng.integers(-5, 6, (40, 2)) @ rng.integers(-3, 4, (2, 6))
    rows = [(i, v.astype(float).tolist()) for i, v in enumerate(flat)]
    df = whiten(spark.createDataFrame(rows, SCHEMA))
    assert {r.component for r in df.select("component").distinct().collect()} == {1, 2}  # no other has any variance
    check(df, rows)
    assert whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], SCHEMA)).count() == 0


def test_it_ends_once_nothing_larger_can_be_left(spark, monkeypatch):
    passes = []
    summed = whitening.summed
    monkeypatch.setattr(whitening, "summed", lambda *a: passes.append(1) or summed(*a))
    rng = np.random.default_rng(6)
    rows = [(i, (rng.standard_normal(40) * 0.3 ** np.arange(40) * 1000).tolist()) for i in range(200)]
    check(whiten(spark.createDataFrame(rows, SCHEMA)), rows)
    assert len(passes) < 30


def test_lengths_large_numbers_and_other_columns(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(3).tolist(), "c", 1) for i in range(20)] + [(100 + i, rng.standard_normal(2).tolist(), "c", 2) for i in range(10)]
    rows += [(None, [1.0, 2.0, 3.0], None, None), (7, [1.0, 2.0, 3.0], "c", 1), (300, [1e300, 0.0, 0.0], "c", 1)]
    df = whiten(spark.createDataFrame(rows, SCHEMA + ", component string, x int"))
    found = df.collect()
    assert sum(r.component == 1 for r in found) == 32 and 300 not in {r.vec_id for r in found}
    assert sum(r.vec_id == 7 for r in found) == 2 * 3 and sum(r.vec_id is None for r in found) == 3
    assert {r.n for r in found if r.vec_id == 105} == {10}
    huge = whiten(spark.createDataFrame([(i, [float(i) * 1e9, float(i % 3)]) for i in range(9)], SCHEMA)).collect()
    assert {r.deviation for r in huge if r.vec_id == 0} == {None} and {r.deviation for r in huge if r.vec_id == 4} != {None}
    assert whiten(df.limit(0).selectExpr("vec_id", "array(whitened) as embedding")).count() == 0
