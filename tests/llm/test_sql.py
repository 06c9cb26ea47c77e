"""The near-duplicate queries against their SQL, on the given tables and on planted rows."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest

from billcycle.llm.queries import oracle_sql, queries
from checks.verify import TABLES, normalised, sql_rows
from tests.llm.conftest import ODD_TEXTS

GIVEN = "/root/testdata/sf0.001"


def agree(spark, folder, name):
    found = queries()[name](spark, folder)
    columns, rows = sql_rows(folder, oracle_sql()[name])
    mine = normalised(found.columns, found.collect())
    assert sorted(columns) == sorted(found.columns)
    assert mine == normalised(columns, rows)
    return mine


@pytest.fixture()
def planted(spark, prose, tmp_path):
    """Tables like the given ones, with copies, chains of near copies, odd texts and unusable vectors."""
    folder = str(tmp_path)
    for name in TABLES:
        if name not in ("documents", "embeddings"):
            os.symlink(f"{GIVEN}/{name}.parquet", f"{folder}/{name}.parquet")
    rng = random.Random(3)
    texts = [prose(i, 12 + i % 60) for i in range(60)] + [prose(5, 17).upper()] * 3 + [*ODD_TEXTS]
    chain = prose(900, 100).split(" ")
    for i in range(8):
        chain[rng.randrange(100)] = f"new{i}"
        texts.append("  ".join(chain))
    rng.shuffle(texts)
    # one file a table, as the given ones
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").toPandas().to_parquet(f"{folder}/documents.parquet")
    noise = np.random.default_rng(4)
    centres = noise.normal(size=(5, 16))
    vectors = [(centres[i % 5] + noise.normal(scale=0.3, size=16)).tolist() for i in range(120)]
    vectors += [vectors[7], [2 * x for x in vectors[8]], None, [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").toPandas().to_parquet(
        f"{folder}/embeddings.parquet"
    )
    return folder


@pytest.mark.parametrize("name", ["op6_vectors", "op10_ngram_join"])
def test_given_tables(spark, name):
    assert agree(spark, GIVEN, name)


@pytest.mark.parametrize("name", ["op6_vectors", "op10_ngram_join"])
def test_planted_rows(spark, planted, name):
    rows = agree(spark, planted, name)
    assert 1 < len({r[0] for r in rows}) < len(rows)  # component_id comes first
