"""Event history of entities: filtered transitions, effective tenure, renewal de-duplication."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billcycle.functions.dates import local_time
from billcycle.functions.firstrow import extreme_coded_row, extreme_row
from billcycle.functions.jsonx import parse_json
from billcycle.schemas import (
    EVENT_PRIORITY,
    HISTORY_EXPORT,
    HISTORY_EVENTS,
    OTHER_EVENT_PRIORITY,
    RENEWAL_APPLIED,
    RENEWAL_OVERDUE,
    SNAPSHOT_PATHS,
    STATE_EVENTS,
)


def event_priority(event_name: str = "event_name") -> Column:
    """Rank of an event among those of one cycle, best first."""
    ranks = F.create_map(*[F.lit(x) for pair in EVENT_PRIORITY.items() for x in pair])
    return F.coalesce(F.try_element_at(ranks, F.col(event_name)), F.lit(OTHER_EVENT_PRIORITY))


def named_transitions(
    state_transitions: DataFrame,
    events: DataFrame,
    event_names: Sequence[str],
    *,
    vertical: str | None,
    entity_types: Sequence[str] | None = None,
    entity_ids: Sequence[int] | None = None,
    require_activation: bool = False,
    fields: Sequence[str] | None = None,
) -> DataFrame:
    """Transitions whose event is one of ``event_names``, with the after-image (or some ``fields`` of it) as columns.

    Plain filters reach the scan; stored entity types are upper case. The document is parsed before the join with the events, which
    grow with the log, so the join shuffles narrow rows and only the wanted events.
    """
    log = state_transitions
    if entity_types is not None:
        log = log.where(F.col("entity_type").isin([t.upper() for t in entity_types]))
    if entity_ids is not None:
        log = log.where(F.col("entity_id").isin(list(entity_ids)))
    required: dict[str, str | None] = {}
    if vertical:
        required["vertical"] = vertical
    if require_activation:
        required["activation_date"] = None
    wanted_fields = [n for n in SNAPSHOT_PATHS if n != "delivery_address_id"] if fields is None else list(fields)
    wanted_fields += [n for n in required if n not in wanted_fields]
    rows = parse_json(
        log.select(
            F.col("id").alias("state_transition_id"),
            "entity_type",
            "entity_id",
            "from_state",
            "to_state",
            local_time("created_at").alias("transition_created_at"),
            "event_id",
            "snapshot",
        ),
        "snapshot",
        {n: SNAPSHOT_PATHS[n] for n in wanted_fields},
        required,
    )
    wanted = events.where(F.col("name").isin(list(event_names))).select(
        F.col("id").alias("event_id"), F.col("name").alias("event_name")
    )
    return rows.join(wanted, "event_id")


_STATE_FIELDS = (
    "renewal_overdue_cycle_start_date", "renewal_overdue_cycle_end_date", "tenure_start_date", "tenure_end_date",
    "pickup_date", "activation_date", "pre_tax_amount", "amount_paid",
)
_FINAL_FIELDS = (*_STATE_FIELDS, "tenure_in_months")


def state_event_history(
    state_transitions: DataFrame,
    events: DataFrame,
    *,
    event_names: Sequence[str] = STATE_EVENTS,
    vertical: str | None,
    entity_types: Sequence[str] | None = None,
    entity_ids: Sequence[int] | None = None,
    ordered: bool = False,
) -> DataFrame:
    """Named transitions of the entities; ``ordered`` sorts them by transition id."""
    rows = named_transitions(
        state_transitions,
        events,
        event_names,
        vertical=vertical,
        entity_types=entity_types,
        entity_ids=entity_ids,
        fields=_STATE_FIELDS,
    ).select(
        "state_transition_id",
        "entity_type",
        "entity_id",
        "from_state",
        "to_state",
        "renewal_overdue_cycle_start_date",
        "renewal_overdue_cycle_end_date",
        "tenure_start_date",
        "tenure_end_date",
        "pickup_date",
        "activation_date",
        "pre_tax_amount",
        "amount_paid",
        "transition_created_at",
        "event_id",
        "event_name",
    )
    return rows.orderBy("state_transition_id") if ordered else rows


def effective_tenure(transitions: DataFrame, *, overdue_price: bool = True) -> DataFrame:
    """Add the cycle a transition is really about: the overdue one if there is one.

    With ``overdue_price`` the amount of a ``RENEWAL_OVERDUE`` event is the base price, or the
    pre-tax amount of older snapshots that lack it.
    """
    amount = F.col("pre_tax_amount")
    if overdue_price:
        amount = F.when(
            F.col("event_name") == RENEWAL_OVERDUE, F.coalesce("base_price", "pre_tax_amount")
        ).otherwise(amount)
    return transitions.withColumns(
        {
            "effective_tenure_start": F.coalesce("renewal_overdue_cycle_start_date", "tenure_start_date"),
            "effective_tenure_end": F.coalesce("renewal_overdue_cycle_end_date", "tenure_end_date"),
            "pre_tax_amount": amount,
        }
    )


def export_columns(rows: DataFrame, addresses: DataFrame | None = None) -> DataFrame:
    """Transitions with their effective tenure in the columns of the history export, its city by the delivery address."""
    columns = [c.strip().split(" ") for c in HISTORY_EXPORT.split(",")]
    found = rows.withColumn("id", F.col("state_transition_id"))
    if "delivery_address_id" not in found.columns:
        found = found.withColumn("delivery_address_id", F.lit(None).cast("bigint"))
    if addresses is None:
        found = found.withColumn("city_id", F.lit(None).cast("int"))
    else:
        found = found.join(addresses.select(F.col("id").alias("delivery_address_id"), "city_id"), "delivery_address_id", "left")
    return found.select(*[F.col(name).cast(kind).alias(name) for name, kind in columns])


def _priority_and_id() -> Column:
    """(event priority, transition id) as one number of fixed width, in the same order; a NULL id is the least."""
    apart = F.lit(Decimal(2**64))
    number = F.coalesce(F.col("state_transition_id").cast("decimal(20,0)"), F.lit(Decimal(-(2**63) - 1)))
    return event_priority().cast("decimal(10,0)") * apart + number


def renewal_dedup(transitions: DataFrame, *, known: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """One renewal event per entity and effective cycle, applied before overdue; others pass.

    One aggregate instead of two branches and a union: a row that is no renewal adds its own id to
    the key and so stays alone in its group. ``known`` names columns of text with all their values (``event_name`` and the
    states, say): they are carried as codes, and if all texts that are read are known the aggregate is hashed, not sorted. A value
    that is not among them fails the query.
    """
    renewal = F.coalesce(F.col("event_name").isin(RENEWAL_APPLIED, RENEWAL_OVERDUE), F.lit(False))
    keyed = transitions.where(F.col("event_name").isNotNull()).withColumn(
        "_alone", F.when(~renewal, F.col("state_transition_id"))
    )
    keys = ["entity_type", "entity_id", "effective_tenure_start", "effective_tenure_end", "_alone"]
    if known is not None:
        return extreme_coded_row(keyed, keys, _priority_and_id(), known, latest=False).drop("_alone")
    order = F.struct(event_priority(), F.col("state_transition_id"))
    return extreme_row(keyed, keys, order, latest=False).drop("_alone")


def final_state_history(
    state_transitions: DataFrame,
    events: DataFrame,
    *,
    event_names: Sequence[str] = HISTORY_EVENTS,
    vertical: str | None,
    entity_types: Sequence[str] | None = None,
    entity_ids: Sequence[int] | None = None,
    states: Sequence[str] | None = None,
    ordered: bool = False,
) -> DataFrame:
    """History of activated entities with one renewal row per cycle; all entities at once.

    ``states`` asserts that transitions lead from and to these states only; the aggregate then has fixed-width buffers.
    """
    rows = named_transitions(
        state_transitions,
        events,
        event_names,
        vertical=vertical,
        entity_types=entity_types,
        entity_ids=entity_ids,
        require_activation=True,
        fields=_FINAL_FIELDS,
    )
    known = None if states is None else {"event_name": event_names, "from_state": states, "to_state": states}
    final = renewal_dedup(effective_tenure(rows, overdue_price=False), known=known).select(
        "state_transition_id",
        "entity_type",
        "entity_id",
        "from_state",
        "to_state",
        F.col("effective_tenure_start").alias("tenure_start_date"),
        F.col("effective_tenure_end").alias("tenure_end_date"),
        "tenure_in_months",
        "pickup_date",
        "activation_date",
        "pre_tax_amount",
        "amount_paid",
        "transition_created_at",
        "event_id",
        "event_name",
    )
    return final.orderBy("state_transition_id") if ordered else final
