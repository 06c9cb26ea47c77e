"""A billing timeline and its month snapshots, kept up to date as the log grows.

The log is read beyond a high-water mark of transition ids only. What is kept of it are the candidates of each part
(:func:`billcycle.operators.cycles.cycle_candidates`), which add up: a run appends those of the new transitions, and only entities
that have new ones are numbered again. Of the month snapshots, only months of which a row differs are written again.

Below the path lie ``candidates/run=N``, ``months/run=N/snapshot_month=M`` and ``runs``, one row for each finished run. That row is
written last and says which folders are valid, so a run that fails at any point leaves the former state as it was and is simply
started again. One run at a time may write.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billcycle.functions.dates import to_date
from billcycle.operators import cycles
from billcycle.schemas import ITEM
from billcycle.sources.tables import MONTH_COLUMN

_RUNS = "run int, first_run int, mark bigint, entity_type string, vertical string, bounded boolean, months map<date,int>"


@dataclass(frozen=True)
class Run:
    """A finished run: candidates are those of ``first_run`` to ``run``; ``months`` says which run holds a month's rows."""

    run: int
    first_run: int
    mark: int | None
    entity_type: str
    vertical: str | None
    bounded: bool
    months: dict[dt.date, int]

    def scope(self) -> tuple:
        return self.entity_type, self.vertical, self.bounded


def last_run(spark: SparkSession, path: str) -> Run | None:
    """The last finished run, or none."""
    try:
        rows = spark.read.schema(_RUNS).parquet(f"{path}/runs").orderBy(F.desc("run")).limit(1).collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return Run(**rows[0].asDict()) if rows else None


def _finish(spark: SparkSession, path: str, done: Run) -> Run:
    row = (done.run, done.first_run, done.mark, *done.scope(), done.months)
    spark.createDataFrame([row], _RUNS).coalesce(1).write.mode("append").parquet(f"{path}/runs")
    return done


def _candidates(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Candidates of the runs ``first`` to ``last``; the filter prunes to their folders."""
    return spark.read.parquet(f"{path}/candidates").where(F.col("run").between(first, last)).drop("run")


def _same_entity(left: DataFrame, entities: DataFrame, how: str) -> DataFrame:
    """Rows (not) of these entities; the null id is one of them."""
    other = entities.select(F.col("entity_id").alias("_entity"))
    return left.join(other, left["entity_id"].eqNullSafe(other["_entity"]), how)


def _snapshots(timeline: DataFrame, months: Iterable[dt.date], bounded: bool) -> DataFrame:
    return cycles.with_realised_revenue(cycles.month_snapshots(timeline, sorted(months), bounded=bounded))


def _month_rows(spark: SparkSession, path: str, schema: T.StructType, months: dict[dt.date, int]) -> DataFrame:
    """Rows of these months from the runs that hold them; a month may have none."""
    if not months:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("run", T.IntegerType())])).parquet(f"{path}/months")
    held: dict[int, list[dt.date]] = {}
    for month, run in months.items():
        held.setdefault(run, []).append(month)
    wanted = F.lit(False)
    for run, of_run in sorted(held.items()):
        wanted = wanted | ((F.col("run") == run) & F.col(MONTH_COLUMN).isin(of_run))
    return rows.where(wanted).select(*schema.names)


def _differing_months(before: DataFrame, after: DataFrame) -> list[dt.date]:
    """Months of which the two differ in a row, repeats counted; at most as many as months are kept."""
    both = before.withColumn("_n", F.lit(-1)).unionByName(after.withColumn("_n", F.lit(1)))
    rows = both.groupBy(*[c for c in both.columns if c != "_n"]).agg(F.sum("_n").alias("_n"))
    return [r[0] for r in rows.where("_n <> 0").select(MONTH_COLUMN).distinct().collect()]


def update_timeline(
    spark: SparkSession,
    state_transitions: DataFrame,
    path: str,
    *,
    months: Iterable[str | dt.date] = (),
    vertical: str | None,
    entity_type: str = ITEM,
    bounded: bool = False,
    overlap: int = 0,
) -> Run:
    """Bring the tables below ``path`` up to the log's last transition; the first run reads the whole log.

    ``months`` are added to those kept. Transitions are expected to come with rising ids; ``overlap`` reads that many ids
    below the mark again, for transitions stored late (what was read before changes nothing). ``bounded`` as in
    :func:`billcycle.operators.cycles.in_month`: without it a month also holds all later cycles, so that most months change
    with every run. Entity type, vertical and ``bounded`` are fixed by the first run; others raise ValueError.
    """
    last = last_run(spark, path)
    wanted = {to_date(m).replace(day=1) for m in months}
    if last is None:
        last = Run(0, 1, None, entity_type, vertical, bounded, {})
    elif last.scope() != (entity_type, vertical, bounded):
        raise ValueError(f"{path} holds (entity type, vertical, bounded) = {last.scope()}")
    log = state_transitions
    if last.mark is not None:
        log = log.where(F.col("id") > last.mark - overlap)
    mark = log.agg(F.max("id")).first()[0]
    added = wanted - set(last.months)
    if last.run and not added and (mark is None or (mark == last.mark and not overlap)):
        return last

    run = last.run + 1
    if mark is not None:
        log = log.where(F.col("id") <= mark)  # a log that grows meanwhile is for the next run
    new = cycles.cycle_candidates(cycles.snapshot_extract(log, entity_type=entity_type, vertical=vertical))
    new.write.mode("overwrite").parquet(f"{path}/candidates/run={run}")
    whole = _candidates(spark, path, last.first_run, run)
    changed = _candidates(spark, path, run, run).select("entity_id").distinct()

    held = dict(last.months)
    parts = []
    if last.months:
        rebuilt = cycles.timeline_of_candidates(cycles.merge_candidates(_same_entity(whole, changed, "left_semi")))
        after = _snapshots(rebuilt, last.months, bounded)
        before = _month_rows(spark, path, after.schema, last.months)
        differing = _differing_months(_same_entity(before, changed, "left_semi"), after)
        if differing:
            others = _month_rows(spark, path, after.schema, {m: last.months[m] for m in differing})
            parts += [_same_entity(others, changed, "left_anti"), _snapshots(rebuilt, differing, bounded)]
            held |= dict.fromkeys(differing, run)
    if added:
        parts.append(_snapshots(cycles.timeline_of_candidates(cycles.merge_candidates(whole)), added, bounded))
        held |= dict.fromkeys(added, run)
    if parts:
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        rows = rows.hint("rebalance", F.col(MONTH_COLUMN))
        rows.write.mode("overwrite").partitionBy(MONTH_COLUMN).parquet(f"{path}/months/run={run}")
    marks = [m for m in (last.mark, mark) if m is not None]
    return _finish(spark, path, replace(last, run=run, mark=max(marks, default=None), months=held))


def compact(spark: SparkSession, path: str) -> Run:
    """Merge the candidates of all runs into one folder. No result changes; folders no longer named stay for the caller to delete."""
    last = last_run(spark, path)
    if last is None:
        raise ValueError(f"no finished run below {path}")
    run = last.run + 1
    merged = cycles.merge_candidates(_candidates(spark, path, last.first_run, last.run))
    merged.write.mode("overwrite").parquet(f"{path}/candidates/run={run}")
    return _finish(spark, path, replace(last, run=run, first_run=run))


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    """The billing timeline of the log up to the mark, from the candidates: no document is read."""
    last = last_run(spark, path)
    if last is None:
        raise ValueError(f"no finished run below {path}")
    return cycles.timeline_of_candidates(cycles.merge_candidates(_candidates(spark, path, last.first_run, last.run)))


def read_months(spark: SparkSession, path: str, months: Iterable[str | dt.date] | None = None) -> DataFrame:
    """Rows of the kept months (or of some) with ``snapshot_month`` and realised revenue; a month not kept raises ValueError."""
    last = last_run(spark, path)
    if last is None:
        raise ValueError(f"no finished run below {path}")
    wanted = set(last.months) if months is None else {to_date(m).replace(day=1) for m in months}
    if missing := sorted(wanted - set(last.months)):
        raise ValueError(f"months not kept: {', '.join(map(str, missing))}")
    schema = _snapshots(read_timeline(spark, path), wanted or {dt.date(2000, 1, 1)}, last.bounded).schema
    return _month_rows(spark, path, schema, {m: last.months[m] for m in wanted})
