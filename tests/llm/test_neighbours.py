from __future__ import annotations

import math

import numpy as np
import pytest

from billcycle.llm import neighbours
from billcycle.llm.neighbours import Forest, nearest_neighbours, op11_neighbours

SCHEMA = "vec_id long, embedding array<double>"


def usable(v) -> bool:
    return bool(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)


def unit(v) -> np.ndarray:
    x = np.array(v, float)
    x = x / np.abs(x).max()
    return x / np.sqrt((x * x).sum())


def brute(rows, k=5, every=50):
    """Sorted (query_id, rank, vec_id, score to 12 digits) over all rows."""
    known = [(i, unit(v), len(v)) for i, v in rows if usable(v)]
    out = []
    for a, (i, x, d) in enumerate(known):
        if i is None or i % every:
            continue
        found = [(-round(float(x @ y), 12), j is None, j or 0, j) for b, (j, y, e) in enumerate(known) if a != b and d == e]
        out += [(i, rank, j, -s) for rank, (s, _, _, j) in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return sorted(out, key=str)


def found_rows(df):
    return sorted(((r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in df.collect()), key=str)


def test_small_tables_are_searched_whole(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(160)]
    rows += [(1000 + i, rows[50][1]) for i in range(80)]  # a third of the rows are copies, many of them queries
    rows += [(2000 + i, [2.0**i * c for c in rows[0][1]]) for i in range(3)]  # the same direction
    rows += [(100, rows[3][1]), (100, rows[3][1]), (None, rows[3][1]), (None, rows[9][1])]
    rows += [(3000, None), (3050, []), (3100, [0.0] * 6), (3150, [math.nan] + [1.0] * 5), (3200, [None] + [1.0] * 5), (3250, [math.inf] * 6)]
    rows += [(4000, [1.0, 2.0]), (4050, [1e-300, 1e-300]), (4001, [1e300, -1e300]), (5000, [3.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found_rows(nearest_neighbours(df, lambda i: i % 50 == 0)) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 4])
def test_fewer_candidates_than_asked(spark, n):
    rows = [(50 * i, [1.0, float(i)]) for i in range(n)]
    assert found_rows(nearest_neighbours(spark.createDataFrame(rows, SCHEMA), lambda i: i % 50 == 0)) == brute(rows)


def test_empty_tables_and_other_columns(spark):
    df = spark.createDataFrame([(50, [1.0, 2.0], 7, "x")], SCHEMA + ", rank int, node string")
    found = nearest_neighbours(df, lambda i: i % 50 == 0)
    assert found.columns == ["query_id", "rank", "vec_id", "score"] and found.count() == 0
    assert nearest_neighbours(df.limit(0), lambda i: i % 50 == 0).count() == 0


def clustered(rng, n, width=24):
    centres = rng.standard_normal((n // 40, width))
    return centres[rng.integers(0, len(centres), n)] + 0.6 * rng.standard_normal((n, width))


def test_recall_and_pieces(spark, tmp_path, monkeypatch):
    """Vectors in clusters and others without any; blocks and pieces of a few rows."""
    monkeypatch.setattr(neighbours, "PIECE", 7)
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 24 * 8 * 500)
    rng = np.random.default_rng(9)
    x = np.concatenate([clustered(rng, 3000), rng.standard_normal((3000, 24)), np.tile(rng.standard_normal(24), (3000, 1))])
    order = rng.permutation(len(x))
    rows = [(int(i), x[j].tolist()) for i, j in enumerate(order)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    x = x[order].astype(np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = op11_neighbours(spark, str(tmp_path)).toPandas().sort_values(["query_id", "rank"])
    assert len(found) == 5 * len(range(0, len(rows), 50))
    hits = 0
    for query, own in found.groupby("query_id"):
        scores = u @ u[query]
        scores[query] = -2
        assert np.allclose(own["score"], scores[own["vec_id"]], atol=1e-12)
        assert list(own["rank"]) == [1, 2, 3, 4, 5] and list(own["score"]) == sorted(own["score"], reverse=True)
        best = np.lexsort((np.arange(len(u)), -np.round(scores, 12)))[:5]
        hits += len(set(best.tolist()) & set(own["vec_id"]))
    assert hits / len(found) >= 0.93


def test_the_queue_takes_branches_by_distance():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest = Forest(x, len(x), 8, trees=3)
    at = forest.leaves(x)
    assert forest.depth == 5 and max(np.bincount(at[:, 0])) < 200
    order = list(forest.search(x[0]))
    assert len(set(order)) == len(order) == 3 * 32
    assert set(order[:3]) == {(t, int(at[0, t])) for t in range(3)}  # its own leaves come first
    assert {(t, leaf) for t in range(3) for leaf in range(32)} == {(t, int(leaf)) for t, leaf in order}


def test_all_equal_projections():
    forest = Forest(np.tile(np.eye(4)[0], (5000, 1)), 5000, 4)
    assert len(np.unique(forest.leaves(np.eye(4)[:1]), axis=0)) == 1
