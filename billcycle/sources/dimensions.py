"""Constant dimensions; their size is fixed by this file, so they may be broadcast."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billcycle.functions.dates import to_date
from billcycle.schemas import CITIES, TENURE_BUCKETS


def _constant(spark: SparkSession, columns: dict[str, str], rows: Sequence[tuple]) -> DataFrame:
    """Literal rows as part of the plan, so that their small size is known to the planner."""
    lines = [
        F.struct(*[F.lit(value).cast(dtype).alias(name) for value, (name, dtype) in zip(row, columns.items())])
        for row in rows
    ]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*lines)))


def dim_city(
    spark: SparkSession, names: Sequence[str] = (), cities: dict[int, str] = CITIES
) -> DataFrame:
    """City ids and names, all or only the named ones."""
    rows = _constant(spark, {"city_id": "int", "city_name": "string"}, list(cities.items()))
    return rows.where(F.col("city_name").isin(list(names))) if names else rows


def city_ids(names: Sequence[str], cities: dict[int, str] = CITIES) -> list[int]:
    """Ids of the named cities, for the KPI filters."""
    return [city_id for city_id, name in cities.items() if name in names]


def with_city_name(facts: DataFrame, cities: dict[int, str] = CITIES, column: str = "city_id") -> DataFrame:
    """Add the city name; rows of unknown cities keep a NULL name."""
    dimension = dim_city(facts.sparkSession, cities=cities).withColumnRenamed("city_id", column)
    return facts.join(F.broadcast(dimension), column, "left")


def dim_tenure_bucket(spark: SparkSession) -> DataFrame:
    """Tenure buckets as half-open month ranges."""
    rows = [(name, lo, hi) for name, (lo, hi) in TENURE_BUCKETS.items()]
    return _constant(spark, {"bucket": "string", "min_months": "int", "max_months": "int"}, rows)


def month_spine(spark: SparkSession, as_of: str | dt.date, n: int = 18) -> DataFrame:
    """The last ``n`` months, newest first: name, first day, exclusive end, last day."""
    current = F.trunc(F.lit(to_date(as_of)), "MM")
    start = F.col("month_start")
    return (
        spark.range(n)
        .select(F.add_months(current, -F.col("id").cast("int")).alias("month_start"))
        .select(
            F.date_format(start, "yyyy-MM").alias("month"),
            "month_start",
            F.add_months(start, 1).alias("month_end_exclusive"),
            F.last_day(start).alias("month_end"),
        )
        .orderBy(start.desc())
    )
