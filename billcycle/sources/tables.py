"""Tables, CSV exports and the month-snapshot sink."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billcycle.functions.dates import month_start

MONTH_COLUMN = "snapshot_month"


def load(spark: SparkSession, name_or_path: str) -> DataFrame:
    """A catalog table by name, or Parquet files by path."""
    if "/" in name_or_path or name_or_path.endswith(".parquet"):
        return spark.read.parquet(name_or_path)
    return spark.table(name_or_path)


_LINE = "_rejected_line"


def _csv_rows(spark: SparkSession, path: str, schema: T.StructType, null_text: str) -> tuple[DataFrame, Column, dict]:
    """All lines by the schema, with the text of those that don't fit; whether a line doesn't; the options of the reader."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _LINE, "nullValue": null_text, "emptyValue": ""}
    fields = T.StructType([*schema.fields, T.StructField(_LINE, T.StringType())])
    rows = spark.read.options(header=True, enforceSchema=False, columnPruning=False, **options).schema(fields).csv(path)
    # all columns are named, so that a line is bad whatever the query reads of it; their hash adds nothing
    whole = F.concat(_LINE, F.substring(F.hash(*[F.col(f"`{n}`") for n in schema.fieldNames()]).cast("string"), 1, 0))
    rows = rows.withColumn(_LINE, whole)
    return rows, F.coalesce(F.length(_LINE), F.lit(-1)) >= 0, options


def _struct(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def read_csv_export(
    spark: SparkSession, path: str, schema: str | T.StructType | None = None, *, null_text: str = ""
) -> DataFrame:
    """A CSV export with a header. Exports spell NULL as a word (``null``) or leave it empty.

    With a schema the header has to name its columns in its order, and a line with more or fewer fields or a value that is none of its
    type fails the query; :func:`split_csv_export` sets such lines apart.
    """
    if schema is None:
        return spark.read.options(header=True, nullValue=null_text, emptyValue="").csv(path)
    rows, bad, _ = _csv_rows(spark, path, _struct(schema), null_text)
    refused = F.raise_error(F.concat(F.lit("line that does not fit the schema: "), F.col(_LINE))).cast("boolean")
    return rows.where(F.when(bad, refused).otherwise(F.lit(True))).drop(_LINE)


def split_csv_export(
    spark: SparkSession, path: str, schema: str | T.StructType, *, null_text: str = ""
) -> tuple[DataFrame, DataFrame]:
    """The rows of an export that fit the schema, and the rejected lines (line, reason); no value is changed or lost.

    The reason is ``number of fields``, or names the columns whose value is none of their type. A header that names other columns, or these in
    another order, still fails the query: every line would be wrong.
    """
    wanted = _struct(schema)
    names = wanted.fieldNames()
    rows, bad, options = _csv_rows(spark, path, wanted, null_text)
    as_texts = ", ".join(f"`{n}` string" for n in [*names, _LINE])
    rejected = rows.where(bad).withColumn("_texts", F.from_csv(_LINE, as_texts, options))
    unread = [F.when(F.col(f"`{n}`").isNull() & F.col("_texts")[n].isNotNull(), F.lit(n)) for n in names]
    reason = F.when(F.col("_texts")[_LINE].isNotNull(), "number of fields").otherwise(F.concat_ws(", ", *unread))
    return rows.where(~bad).drop(_LINE), rejected.select(F.col(_LINE).alias("line"), reason.alias("reason"))


def write_month_snapshots(cycles: DataFrame, path: str) -> None:
    """Write cycles partitioned by ``snapshot_month``, replacing only the months they hold.

    The rebalance keeps files even: a month larger than a partition is split, small ones share a task.
    """
    (
        cycles.hint("rebalance", F.col(MONTH_COLUMN))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(MONTH_COLUMN)
        .parquet(path)
    )


def read_month_snapshot(spark: SparkSession, path: str, month: str | dt.date) -> DataFrame:
    """One month of a written snapshot table; the filter prunes to its folder."""
    return load(spark, path).where(F.col(MONTH_COLUMN) == F.lit(month_start(month))).drop(MONTH_COLUMN)


def create_month_table(
    spark: SparkSession, name: str, path: str, columns: T.StructType, *, buckets: int, key: str = "entity_id"
) -> None:
    """Declare the table of month snapshots at ``path``, bucketed and sorted by ``key``; months already written there are found.

    Two months of it are aggregated by entity without a shuffle (:func:`entity_pair_of_months` of the table), at a task for each
    bucket: take as many that a month's share of one fits a task. An entity's cycles in a month are bounded by the calendar;
    where one entity may hold a large part of all rows, keep to :func:`write_month_snapshots`. A NULL key has one bucket.
    """
    wanted = T.StructType([f for f in columns.fields if f.name != MONTH_COLUMN] + [T.StructField(MONTH_COLUMN, T.DateType())])
    # no rows: the folder is there afterwards, and what it holds stays
    spark.createDataFrame([], wanted).write.mode("append").partitionBy(MONTH_COLUMN).parquet(path)
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} ({wanted.toDDL()}) USING parquet PARTITIONED BY ({MONTH_COLUMN}) "
        f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {int(buckets)} BUCKETS LOCATION '{place}'"
    )
    spark.catalog.recoverPartitions(name)


def write_month(snapshot: DataFrame, name: str, month: str | dt.date, *, key: str = "entity_id") -> None:
    """Replace one month of a table of :func:`create_month_table`; other months stay, whatever the session's overwrite mode is.

    Rows are rebalanced by the buckets' own hash: a task writes few buckets, and a large one is split into more files.
    """
    spark = snapshot.sparkSession
    columns = [c for c in spark.table(name).columns if c != MONTH_COLUMN]
    buckets = int(spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Num Buckets'").first()["data_type"])
    first = month_start(month)
    spark.sql(
        f"INSERT OVERWRITE TABLE {name} PARTITION ({MONTH_COLUMN} = DATE '{first.isoformat()}') SELECT * FROM {{rows}}",
        rows=snapshot.select(*columns).hint("rebalance", buckets, F.col(key)),
    )
