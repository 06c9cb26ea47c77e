"""The pipeline's stages, each against a plain version of its rule on its own input."""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from billcycle.llm import language
from billcycle.llm.token_ids import TOKENIZER, tokenizer_path
from tests.llm.conftest import ODD_TEXTS
from tests.llm.test_near_duplicates import brute
from tests.llm.test_texts import hits

FOLDER = "/root/testdata/sf0.001"


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_registered():
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert [name for name in __spark_entry__.queries() if re.match(r"op\d+_", name)] == [
        n for n in __spark_entry__.queries() if n.startswith("op")
    ]
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_stages(spark, documents, prose, tmp_path):
    given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    odd = [(900 + i, t, None, None) for i, t in enumerate(ODD_TEXTS)]
    odd += [(None, "the same text of no id", "en", "src0")] * 2 + [(950, given.first().text, "fr", "src1")] * 2
    docs = given.unionByName(documents(odd))
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)

    def step(name, docs):
        stage[name](spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    kept = step("language_id", docs)
    assert kept.columns == columns
    gone = {r.text for r in docs.exceptAll(kept).collect()}
    assert all(t is None or not any(c.isalpha() for c in t) or len(t) < 30 for t in gone) and None in gone

    unique = step("near_duplicates", kept)
    before = sorted(rows_of(kept), key=lambda r: (r[0] is None, r[0] or 0))
    _, groups = brute([(i, r[1]) for i, r in enumerate(before)])
    assert unique.columns == columns and unique.count() == len(set(groups))
    first = sorted((before[g][0] is None, before[g][0] or 0) for g in set(groups))
    assert sorted((r[0] is None, r[0] or 0) for r in rows_of(unique)) == first

    clean = step("benchmark_free", unique)
    wanted = [r for r in rows_of(unique) if hits(r[1], bench)[1] == 0]
    assert sorted(map(str, rows_of(clean))) == sorted(map(str, wanted)) and len(wanted) < unique.count()

    mixed = step("source_mix", clean)
    sizes = clean.groupBy("source").agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).collect()
    assert mixed.columns == columns and len(sizes) > 10
    assert set(rows_of(mixed)) <= set(rows_of(clean))
    assert 0.9 < mixed.agg(F.sum("n_chars")).first()[0] / clean.agg(F.sum("n_chars")).first()[0] < 1.1

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(TOKENIZER))
    read = [tuple(r) for r in step("token_ids", mixed).collect()]
    ids = [(r[0], tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in rows_of(mixed)]
    assert sorted((str(i), n, c) for i, _, n, c in read) == sorted(
        (str(i), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids
    )


def test_run_over_nothing(spark, documents, tmp_path):
    documents([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_no_stage_touches_other_columns(spark):
    """Columns by the names of those made on the way, in any case of letters, and an empty table."""
    added = ["copy", "text_key", "Row_Key", "found_score", "found_language", "rid", "h", "odd name"]
    given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = given.select("*", *[F.concat(F.lit(f"{c} "), "doc_id").alias(c) for c in added])
    mine = {r.doc_id: tuple(r[c] for c in added) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, FOLDER)
        assert found.columns == docs.columns, name
        rows = found.collect()
        assert rows and all(tuple(r[c] for c in added) == mine[r.doc_id] for r in rows), name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), FOLDER).count() == 0, name


def test_the_language_sample_is_the_same_in_any_order(spark, monkeypatch):
    """A third of the rows are one text; the windows learned from do not depend on how rows are dealt to tasks."""
    given = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    copies = given.where("lang is not null").limit(1).crossJoin(spark.range(100)).select("doc_id", "text", "lang")
    seen = []
    monkeypatch.setattr(language, "train", lambda x, y, languages: seen.append((x.tobytes(), y.tobytes(), languages)))
    for parts in (2, 7):
        language.learn(given.unionByName(copies).repartition(parts), 10)
    assert seen[0] == seen[1] and len(seen[0][1]) > 0
