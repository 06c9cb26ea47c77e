"""A corpus pipeline of five stages over ``documents``; each stage's rows are written as Parquet and read by the next.

All stages but the last return the columns of documents, whatever their names: columns made on the way have names that the
input does not have. Every stage gives an empty table for an empty one, and takes texts of any length whole. Language identification drops texts without a letter and
texts of which no language gets MIN_SCORE; the n-gram join keeps the smallest doc_id of each group of near duplicates, once;
decontamination drops documents that share a window with the benchmark; mixing drops or repeats documents so that
sources reach their weights; the last stage writes the rest as token ids and returns what it reads back of each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billcycle.llm.common import free_name, scratch, ship_code, table
from billcycle.llm.decontaminate import decontaminate
from billcycle.llm.language import learn, predict
from billcycle.llm.mixing import mixed_rows
from billcycle.llm.ngram_join import ngram_join
from billcycle.llm.token_ids import written_and_read

MIN_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text has a letter and a language of a score of MIN_SCORE or more.

    Null and empty texts and those without a letter go, and all rows go where none has a language to learn from. Rows with equal texts stay
    or go together, whatever their other columns hold.
    """
    language, score = free_name(docs.columns, "found_language"), free_name(docs.columns, "found_score")
    found = predict(docs, learn(docs), (language, score))
    return found.where((F.col(language) != "und") & (F.col(score) >= MIN_SCORE)).select(*_named(docs))


def _named(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def _digest(*columns: str) -> Column:
    """A digest of the columns; rows that share it are equal in them."""
    parts = [F.coalesce(F.concat(F.lit("+"), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in columns]
    return F.md5(F.concat_ws("\x1f", *parts).cast("binary"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row of the smallest doc_id stays (null last, then by the row's digest), once.

    Rows without words (null, empty or blank texts) are in no group and all stay. Rows that are equal in all columns are one.
    """
    key, row_key = _digest(*docs.columns), free_name(docs.columns, "row_key")
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", key.alias("key"))
    found = scratch(ngram_join(docs.select(row.alias("doc_id"), "text")).where("n_shingles > 0"))
    dropped = scratch(found.where("doc_id <> component_id").select("doc_id.key").distinct())
    # what is dropped grows with the documents, so it is never sent to every task, however small it is
    gone = dropped.withColumnRenamed("key", row_key).hint("merge")
    kept = docs.withColumn(row_key, key).join(gone, row_key, "left_anti")
    repeated = found.where("doc_id = component_id").groupBy("doc_id.key").count().where("count > 1")
    repeated = scratch(repeated.select(F.col("key").alias(row_key)))
    if not repeated.isEmpty():  # equal rows are one
        once = kept.join(repeated, row_key, "left_semi").dropDuplicates([row_key])
        kept = kept.join(repeated, row_key, "left_anti").unionByName(once)
    return kept.select(*_named(docs))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text shares no window with an item of the benchmark.

    Texts without words share none and stay; rows with equal texts stay or go together. An empty benchmark drops nothing.
    """
    key, text_key = _digest("text"), free_name(docs.columns, "text_key")
    found = decontaminate(docs.select(key.alias(text_key), "text"), table(spark, sf_dir, "benchmark"))
    hit = scratch(found.where("contaminated").select(text_key).distinct())
    return docs.withColumn(text_key, key).join(hit, text_key, "left_anti").select(*_named(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it.

    Rows without words take nothing and go; a null source is one of the sources; rows equal in id and text come equally often.
    """
    return mixed_rows(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row, in ascending doc_id order (null first), read back from the files.

    A null or empty text is the end id alone. Rows of one doc_id each have their own ids. Other columns are not in the result.
    """
    return written_and_read(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_free", benchmark_free),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: SQL has no trained network and no tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_code(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch(stage(spark, docs, sf_dir))
    return docs
