"""Billing cycles rebuilt from the state-transition log.

A transition carries a JSON after-image with the tenure the item is in and, when the renewal is
late, the overdue cycle that follows. Each distinct tenure is a billing cycle, and so is each
overdue cycle that no tenure starting on the same day has absorbed.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from billcycle.functions.dates import month_bounds, next_month, to_date
from billcycle.functions.firstrow import first_by_id
from billcycle.functions.jsonx import parse_json
from billcycle.functions.money import money
from billcycle.schemas import ITEM, PURE_OVERDUE, SNAPSHOT_PATHS, TENURE

_TENURE_COLUMNS = (
    "entity_id", "period_start", "period_end", "activation_date", "pickup_date", "months",
    "pre_tax_amount", "amount_paid", "base_price", "state_transition_id", "event_id",
)
_OVERDUE_COLUMNS = (
    "entity_id", "ro_start", "ro_end", "activation_date", "pickup_date", "base_price",
    "state_transition_id", "event_id",
)


def snapshot_extract(
    state_transitions: DataFrame,
    addresses: DataFrame | None = None,
    events: DataFrame | None = None,
    *,
    entity_type: str = ITEM,
    city_id: int | None = None,
    vertical: str | None,
    entity_ids: Sequence[int] | None = None,
    named: bool = True,
) -> DataFrame:
    """Typed columns of the after-image, one row per transition with a tenure start.

    ``city_id`` needs ``addresses``; with ``events`` a transition must have its event and, if ``named``, gets its
    name. What reduces the transitions afterwards does better without: rows of fixed width stay in the hash
    aggregate, and :func:`with_event_name` names the few that are left. Both tables grow with the log (every transition has an event of its own), so no side is
    hinted: the document is parsed first, and what a join shuffles is the narrow row. The planner
    broadcasts a side only after its size is known to be small.
    """
    if (city_id is None) != (addresses is None):
        raise ValueError("city_id and addresses go together")
    log = state_transitions.where(F.col("entity_type") == entity_type)
    if entity_ids is not None:
        log = log.where(F.col("entity_id").isin(list(entity_ids)))
    fields = {
        "vertical": SNAPSHOT_PATHS["vertical"],
        "delivery_address_id": SNAPSHOT_PATHS["delivery_address_id"],
        "tsd": SNAPSHOT_PATHS["tenure_start_date"],
        "ted": SNAPSHOT_PATHS["tenure_end_date"],
        "months": SNAPSHOT_PATHS["tenure_in_months"],
        "ro_start": SNAPSHOT_PATHS["renewal_overdue_cycle_start_date"],
        "ro_end": SNAPSHOT_PATHS["renewal_overdue_cycle_end_date"],
        **{
            name: SNAPSHOT_PATHS[name]
            for name in ("activation_date", "pickup_date", "pre_tax_amount", "amount_paid", "base_price")
        },
    }
    rows = parse_json(
        log.select(F.col("id").alias("state_transition_id"), "entity_id", "event_id", "snapshot"),
        "snapshot",
        fields,
        required={"tsd": None, **({"vertical": vertical} if vertical else {})},
    ).drop("vertical")
    if addresses is not None:
        in_city = addresses.where(F.col("city_id") == city_id).select(
            F.col("id").cast("bigint").alias("delivery_address_id")
        )
        rows = rows.join(in_city, "delivery_address_id")
    rows = rows.drop("delivery_address_id")
    if events is not None:
        rows = with_event_name(rows, events) if named else rows.join(
            events.select(F.col("id").alias("event_id")), "event_id", "left_semi"
        )
    order = ["state_transition_id", "entity_id", "event_id"]
    return rows.select(*order, *[c for c in rows.columns if c not in order])


def with_event_name(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Rows that have an ``event_id`` with the name of the event."""
    return rows.join(events.select(F.col("id").alias("event_id"), F.col("name").alias("event_name")), "event_id")


def _with_name(columns: Sequence[str], snapshots: DataFrame) -> list[str]:
    return [*columns, *(["event_name"] if "event_name" in snapshots.columns else [])]


def tenure_cycles(snapshots: DataFrame) -> DataFrame:
    """First transition of every (entity, tenure start, tenure end)."""
    rows = (
        snapshots.where(F.col("tsd").isNotNull())
        .withColumnsRenamed({"tsd": "period_start", "ted": "period_end"})
        .select(*_with_name(_TENURE_COLUMNS, snapshots))
    )
    firsts = first_by_id(rows, ["entity_id", "period_start", "period_end"], "state_transition_id")
    return firsts.withColumn("period_type", F.lit(TENURE))


def overdue_cycles(snapshots: DataFrame) -> DataFrame:
    """First transition of every (entity, overdue start, overdue end)."""
    rows = snapshots.where(F.col("ro_start").isNotNull()).select(*_with_name(_OVERDUE_COLUMNS, snapshots))
    return first_by_id(rows, ["entity_id", "ro_start", "ro_end"], "state_transition_id")


def pure_overdue(overdue: DataFrame, tenures: DataFrame) -> DataFrame:
    """Overdue cycles on whose start day no tenure of the entity starts, whatever its end."""
    starts = tenures.select("entity_id", F.col("period_start").alias("ro_start"))
    alone = overdue.join(starts, ["entity_id", "ro_start"], "left_anti")
    return alone.select(
        "entity_id",
        F.col("ro_start").alias("period_start"),
        F.col("ro_end").alias("period_end"),
        "activation_date",
        "pickup_date",
        F.lit(None).cast("int").alias("months"),
        F.lit(None).cast("double").alias("pre_tax_amount"),
        F.lit(None).cast("double").alias("amount_paid"),
        "base_price",
        "state_transition_id",
        "event_id",
        *(["event_name"] if "event_name" in overdue.columns else []),
        F.lit(PURE_OVERDUE).alias("period_type"),
    )


def _cycle_columns(cycles: DataFrame) -> DataFrame:
    return cycles.select(
        "entity_id",
        "period_start",
        "period_end",
        "activation_date",
        "pickup_date",
        "months",
        F.when(F.col("period_type") == PURE_OVERDUE, F.col("base_price"))
        .otherwise(F.col("pre_tax_amount"))
        .alias("cycle_amount"),
        "period_type",
        "state_transition_id",
        "event_id",
        *(["event_name"] if "event_name" in cycles.columns else []),
        (F.datediff("period_end", "period_start") + 1).cast("bigint").alias("days"),
    )


def unreadable_values(state_transitions: DataFrame, *, vertical: str | None, entity_type: str = ITEM) -> DataFrame:
    """Per field of the after-image the values that are there but are no value of its type, and are read as NULL."""
    log = state_transitions.where(F.col("entity_type") == entity_type).select("snapshot")
    raw = {f"raw_{name}": (path, "string") for name, (path, _) in SNAPSHOT_PATHS.items()}
    rows = parse_json(log, "snapshot", {**SNAPSHOT_PATHS, **raw}, {"vertical": vertical} if vertical else {})
    counts = rows.agg(*[F.count_if(F.col(f"raw_{n}").isNotNull() & F.col(n).isNull()).alias(n) for n in SNAPSHOT_PATHS])
    lines = [F.struct(F.lit(n).alias("field"), F.col(n).alias("unreadable")) for n in SNAPSHOT_PATHS]
    return counts.select(F.inline(F.array(*lines)))


def number_cycles(cycles: DataFrame) -> DataFrame:
    """``cycle_num`` 1..n by start within the entity; ties go by transition id.

    This window holds one entity's cycles, not its transitions. They have been reduced to one row
    per pair of dates before, so the calendar bounds a group however many transitions it had.
    """
    by_start = Window.partitionBy("entity_id").orderBy("period_start", "state_transition_id", "period_type")
    return cycles.select(F.row_number().over(by_start).cast("bigint").alias("cycle_num"), *cycles.columns)


def cycle_candidates(snapshots: DataFrame) -> DataFrame:
    """First transition of every tenure and of every overdue cycle, absorbed or not, from one pass over the snapshots.

    A transition emits its tenure and its overdue cycle as two candidates; one aggregate keeps the first of each. Candidates of
    parts of the log add up to those of the whole: :func:`merge_candidates`.
    """
    common = [c for c in _with_name(("entity_id", "activation_date", "pickup_date", "base_price",
                                     "state_transition_id", "event_id"), snapshots)]
    tenure = F.struct(
        F.lit(True).alias("is_tenure"),
        F.col("tsd").alias("period_start"),
        F.col("ted").alias("period_end"),
        F.col("months"),
        F.col("pre_tax_amount"),
        F.col("amount_paid"),
    )
    overdue = F.struct(
        F.lit(False).alias("is_tenure"),
        F.col("ro_start").alias("period_start"),
        F.col("ro_end").alias("period_end"),
        F.lit(None).cast("int").alias("months"),
        F.lit(None).cast("double").alias("pre_tax_amount"),
        F.lit(None).cast("double").alias("amount_paid"),
    )
    candidates = snapshots.select(*common, F.inline(F.array(tenure, overdue)))
    return merge_candidates(candidates.where(F.col("period_start").isNotNull()))


def merge_candidates(candidates: DataFrame) -> DataFrame:
    """The first of each cycle among candidates of several parts of the log."""
    return first_by_id(candidates, ["entity_id", "period_start", "is_tenure", "period_end"], "state_transition_id")


def _without_absorbed(firsts: DataFrame) -> DataFrame:
    """Candidates that are cycles, with their kind: all tenures, and the overdue ones on whose start day no tenure starts."""
    same_start = (
        Window.partitionBy("entity_id")
        .orderBy("period_start")
        .rangeBetween(Window.currentRow, Window.currentRow)
    )
    kept = firsts.withColumn("_absorbing", F.max("is_tenure").over(same_start)).where(
        F.col("is_tenure") | ~F.col("_absorbing")
    )
    return kept.withColumn(
        "period_type", F.when(F.col("is_tenure"), F.lit(TENURE)).otherwise(F.lit(PURE_OVERDUE))
    )


def timeline_of_candidates(firsts: DataFrame) -> DataFrame:
    """:func:`billing_timeline` from merged candidates, without the log."""
    return number_cycles(_cycle_columns(_without_absorbed(firsts)))


def _typed_cycles(snapshots: DataFrame) -> DataFrame:
    """Cycles of every entity with their kind, from one pass over the snapshots.

    The same rows as ``tenure_cycles`` united with ``pure_overdue``. Taken literally that reads the
    log three times. Here one aggregate keeps the first of each candidate, and the anti-join becomes a look at the peers of the
    same start day in the window order the numbering needs anyway: two shuffles.
    """
    return _without_absorbed(cycle_candidates(snapshots))


def billing_cycles(snapshots: DataFrame) -> DataFrame:
    """Unnumbered cycles of every entity, from one pass over the snapshots: :func:`_typed_cycles`."""
    return _cycle_columns(_typed_cycles(snapshots))


def pure_overdue_cycles(snapshots: DataFrame) -> DataFrame:
    """:func:`pure_overdue` of a log, from the same one pass."""
    alone = _typed_cycles(snapshots).where(~F.col("is_tenure"))
    order = ("entity_id", "period_start", "period_end", "activation_date", "pickup_date", "months", "pre_tax_amount",
             "amount_paid", "base_price", "state_transition_id", "event_id")
    return alone.select(*_with_name(order, snapshots), "period_type")


def billing_timeline(snapshots: DataFrame) -> DataFrame:
    """All cycles of every entity with number, amount and length in days."""
    return number_cycles(billing_cycles(snapshots))


def union_timeline(tenures: DataFrame, alone: DataFrame) -> DataFrame:
    """The timeline from already materialised ``tenure_cycles`` and ``pure_overdue`` tables."""
    return number_cycles(_cycle_columns(tenures.unionByName(alone)))


def in_month(cycles: DataFrame, month: str | dt.date, *, bounded: bool = False) -> DataFrame:
    """Cycles that end in ``month`` or later and belong to entities activated by its end.

    As in the source, a later cycle also counts; ``bounded`` asks that it has started by the end.
    """
    first, end, _ = month_bounds(month)
    rows = cycles.where((F.col("period_end") >= F.lit(first)) & (F.col("activation_date") < F.lit(end)))
    return rows.where(F.col("period_start") < F.lit(end)) if bounded else rows


def month_snapshot(
    snapshots: DataFrame, month: str | dt.date, *, renumber: bool = False, bounded: bool = False
) -> DataFrame:
    """The month's cycles. ``renumber`` counts within the month instead of the whole history."""
    if renumber:
        return number_cycles(in_month(billing_cycles(snapshots), month, bounded=bounded))
    return in_month(billing_timeline(snapshots), month, bounded=bounded)


def month_snapshots(cycles: DataFrame, months: Sequence[str | dt.date], *, bounded: bool = False) -> DataFrame:
    """Several months in one pass over ``cycles``: a row for each month a cycle belongs to."""
    starts = F.array(*[F.lit(to_date(m).replace(day=1)) for m in months])
    rows = cycles.withColumn("snapshot_month", F.explode(starts))
    following = F.add_months("snapshot_month", 1)
    rows = rows.where(
        (F.col("period_end") >= F.col("snapshot_month")) & (F.col("activation_date") < following)
    )
    return rows.where(F.col("period_start") < following) if bounded else rows


def with_realised_revenue(cycles: DataFrame, month: str | dt.date | None = None) -> DataFrame:
    """Add ``realised_revenue``: the amount in proportion to the cycle's days inside the month.

    The snapshot tables this library reproduces hold the column without saying how it is made; this
    derivation is our own. ``month`` defaults to the row's ``snapshot_month``.
    """
    if month is None:
        first, end = F.col("snapshot_month"), F.add_months("snapshot_month", 1)
    else:
        first, end = F.lit(to_date(month).replace(day=1)), F.lit(next_month(month))
    inside = F.datediff(
        F.least(F.date_add("period_end", 1), end), F.greatest(F.col("period_start"), first)
    )
    inside = F.greatest(inside, F.lit(0)).cast("decimal(10,0)")
    # the product keeps the scale of the amount: Spark would take digits off a wider one
    amount = money("cycle_amount").cast("decimal(27,6)")
    share = F.try_divide(amount * inside, F.col("days").cast("decimal(10,0)"))
    return cycles.withColumn("realised_revenue", F.round(share, 2).cast("double"))
