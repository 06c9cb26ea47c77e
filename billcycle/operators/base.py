"""Holdings billed now, and the billing cycle before the current one."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billcycle.functions.dates import local_time, month_start, next_month, to_date
from billcycle.functions.jsonx import json_value
from billcycle.operators.history import effective_tenure, event_priority, named_transitions
from billcycle.schemas import (
    ATTACHMENT,
    BILLABLE_STATES,
    CANCELLED_STATE,
    HISTORY_EVENTS,
    ITEM,
    OVERDUE_STATE,
    PAYMENT_PATH,
    PRICE_PATH,
)


@dataclass(frozen=True)
class Holding:
    """Where the two kinds of holdings differ."""

    entity_type: str
    link_column: str
    price_column: str


ITEM_HOLDING = Holding(ITEM, "item_id", "current_pricing_details")
ATTACHMENT_HOLDING = Holding(ATTACHMENT, "attachment_id", "pricing_details")

_PLAIN = (
    "id", "name", "state", "activation_date", "tenure_start_date", "tenure_end_date", "user_id",
    "tenure_in_months", "renewal_overdue_cycle_start_date", "renewal_overdue_cycle_end_date", "vertical",
)


def purchases(links: DataFrame, purchase_orders: DataFrame, link_column: str, *, live_only: bool = True) -> DataFrame:
    """Every purchase link with the local time of its order; no time if that order is cancelled."""
    orders = purchase_orders
    if live_only:
        orders = orders.where(F.col("state") != CANCELLED_STATE)
    orders = orders.select(F.col("id").alias("order_id"), local_time("created_at").alias("purchased_at"))
    return links.select(
        F.col(link_column).alias("id"),
        F.col("id").alias("link_id"),
        F.col("rent_to_purchase_order_id").alias("order_id"),
    ).join(
        orders.withColumn("live_order_id", F.col("order_id")), "order_id", "left"
    ).drop("order_id")


def _billable(holdings: DataFrame, vertical: str | None) -> DataFrame:
    rows = holdings.where(F.col("state").isin(list(BILLABLE_STATES)))
    return rows.where(F.col("vertical") == vertical) if vertical else rows


def billable_next_month(
    items: DataFrame,
    links: DataFrame,
    purchase_orders: DataFrame,
    *,
    as_of: str | dt.date,
    vertical: str | None,
    holding: Holding = ITEM_HOLDING,
) -> DataFrame:
    """Holdings not picked up before next month, one row per purchase link, cancelled ones included.

    The links lead the first join, so that an item with very many links is split by the skew
    handling; items without a link come from the anti-join with the distinct linked ids.
    """
    bound = F.lit(next_month(as_of))
    rows = _billable(holdings=items, vertical=vertical).select(
        *_PLAIN, "pickup_date", json_value("payment_details", PAYMENT_PATH).alias("by_cash_pre_tax")
    )
    bought = purchases(links, purchase_orders, holding.link_column, live_only=False).select("id", "purchased_at")
    linked = bought.join(rows, "id")
    unlinked = rows.join(bought.select("id").distinct(), "id", "left_anti").withColumn(
        "purchased_at", F.lit(None).cast(bought.schema["purchased_at"].dataType)
    )
    pickup = F.coalesce("pickup_date", "purchased_at")
    return (
        linked.unionByName(unlinked)
        .where(pickup.isNull() | (pickup >= bound))
        .select(
            *[c for c in _PLAIN if c != "vertical"],
            pickup.alias("pickup_date"),
            "by_cash_pre_tax",
            F.lit(to_date(as_of)).alias("as_of_date"),
            bound.alias("next_month_start_date"),
            "vertical",
        )
    )


def current_base(
    items: DataFrame,
    links: DataFrame,
    purchase_orders: DataFrame,
    *,
    as_of: str | dt.date,
    keep_rule: str = "cycle_end",
    vertical: str | None,
    holding: Holding = ITEM_HOLDING,
    entity_ids: Sequence[int] | None = None,
    prefer_live: bool = False,
) -> DataFrame:
    """Holdings billed at ``as_of``, one row each, with their effective cycle and amount.

    A holding stays if it is not picked up, or by ``keep_rule``: ``"next_month"`` if picked up in
    the next month or later, ``"cycle_end"`` if its effective cycle ends in the current month or
    later. The rule is tested for every purchase link; of the links that pass, the latest gives the
    pickup time. What the rule needs to know of the links is aggregated first, so the join is one
    to one and a holding with many links costs one row per task. ``prefer_live`` lets a live order
    win over a later cancelled one.
    """
    if keep_rule not in ("next_month", "cycle_end"):
        raise ValueError(f"keep_rule: {keep_rule}")
    bound = F.lit(next_month(as_of))
    bought = purchases(links, purchase_orders, holding.link_column)
    open_link = F.col("purchased_at").isNull()
    passing = open_link | (F.col("purchased_at") >= bound) if keep_rule == "next_month" else F.lit(True)

    def latest(condition: Column) -> Column:
        return F.max_by("purchased_at", F.when(condition, F.col("link_id")))

    picked = latest(passing)
    if prefer_live:
        picked = F.coalesce(latest(passing & ~open_link), picked)
    per_holding = bought.groupBy("id").agg(
        picked.alias("_latest"),
        F.bool_or(passing).alias("_any_passing"),
        F.bool_or(open_link).alias("_any_open"),
    )

    rows = _billable(items, vertical)
    if entity_ids is not None:
        rows = rows.where(F.col("id").isin(list(entity_ids)))
    rows = rows.select(
        *_PLAIN,
        "pickup_date",
        F.when(F.col("state") == OVERDUE_STATE, json_value(holding.price_column, PRICE_PATH, "double"))
        .otherwise(json_value("payment_details", PAYMENT_PATH, "double"))
        .alias("pre_tax_amount"),
        F.coalesce("renewal_overdue_cycle_start_date", "tenure_start_date").alias("current_effective_start"),
        F.coalesce("renewal_overdue_cycle_end_date", "tenure_end_date").alias("current_effective_end"),
    ).join(per_holding, "id", "left")

    no_links = F.col("_any_passing").isNull()
    if keep_rule == "next_month":
        keep = F.when(F.col("pickup_date").isNotNull(), F.col("pickup_date") >= bound).otherwise(
            no_links | F.col("_any_passing")
        )
        pickup = F.coalesce("pickup_date", "_latest")
    else:
        runs_on = F.coalesce(F.col("current_effective_end") >= F.lit(month_start(as_of)), F.lit(False))
        keep = runs_on | (F.col("pickup_date").isNull() & (no_links | F.col("_any_open")))
        # a holding whose cycle is over stays only through a link without a live order
        pickup = F.coalesce("pickup_date", F.when(runs_on, F.col("_latest")))
    return rows.where(keep).select(
        *[c for c in _PLAIN if c != "vertical"],
        pickup.alias("pickup_date"),
        "pre_tax_amount",
        F.lit(to_date(as_of)).alias("as_of_date"),
        "vertical",
        "current_effective_start",
        "current_effective_end",
        F.lit(holding.entity_type).alias("entity_type"),
    )


def attachment_base(
    attachments: DataFrame, links: DataFrame, purchase_orders: DataFrame, **options
) -> DataFrame:
    """:func:`current_base` for attachments."""
    return current_base(attachments, links, purchase_orders, holding=ATTACHMENT_HOLDING, **options)


def all_base(item_base: DataFrame, attachments: DataFrame) -> DataFrame:
    return item_base.unionByName(attachments)


def billing_transitions(
    state_transitions: DataFrame,
    events: DataFrame,
    *,
    vertical: str | None,
    entity_types: Sequence[str] = (ITEM, ATTACHMENT),
    entity_ids: Sequence[int] | None = None,
) -> DataFrame:
    """Transitions of activated entities with one of the history events."""
    return named_transitions(
        state_transitions,
        events,
        HISTORY_EVENTS,
        vertical=vertical,
        entity_types=entity_types,
        entity_ids=entity_ids,
        require_activation=True,
    )


def state_transitions_for_base(
    state_transitions: DataFrame,
    events: DataFrame,
    base: DataFrame,
    *,
    vertical: str | None,
    entity_types: Sequence[str] = (ITEM, ATTACHMENT),
) -> DataFrame:
    """Transitions with one of the history events, of entities in the base."""
    return of_base(billing_transitions(state_transitions, events, vertical=vertical, entity_types=entity_types), base)


def of_base(transitions: DataFrame, base: DataFrame) -> DataFrame:
    """Transitions of entities in the base, before anything is reduced."""
    wanted = base.select("entity_type", F.col("id").alias("entity_id"))
    return transitions.join(wanted, ["entity_type", "entity_id"], "left_semi")


_ENTITY = ("entity_type", "entity_id")


def previous_scan(transitions: DataFrame, base: DataFrame, told: Sequence[str], held: Sequence[Column]) -> DataFrame:
    """entity_type, id, ``_current`` (``held`` of the base's row) and ``_previous`` (columns ``told`` of the transition that tells the cycle before).

    Cycle ends and the base's rows are stacked, and one ordered scan for each holding carries the last end before the
    current start along: the as-of join without a join, with the base planned once. Of the transitions of one end the best is kept
    first (by event priority, then the newest time, then the highest id), in each task before the shuffle, so a holding with very many leaves
    a row for each end.
    """
    cycles = effective_tenure(transitions).where(F.col("effective_tenure_end").isNotNull() & F.col("entity_id").isNotNull())
    best_first = Window.partitionBy(*_ENTITY, "effective_tenure_end").orderBy(
        event_priority(), F.desc("transition_created_at"), F.desc("state_transition_id")
    )
    columns = list(dict.fromkeys([*_ENTITY, "effective_tenure_end", *told]))
    ends = cycles.withColumn("_rank", F.row_number().over(best_first)).where("_rank = 1").select(*columns)
    current = base.select(
        "entity_type", "id", F.col("current_effective_start").alias("_at"), F.lit(0).alias("_side"), F.struct(*held).alias("_current")
    )
    ended = ends.select(
        "entity_type",
        F.col("entity_id").alias("id"),
        F.col("effective_tenure_end").alias("_at"),
        F.lit(1).alias("_side"),  # a cycle that ends on the current start is not before it
        F.struct(*told).alias("_previous"),
    )
    so_far = (
        Window.partitionBy("entity_type", "id")
        .orderBy("_at", "_side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    stacked = current.unionByName(ended, allowMissingColumns=True)
    scanned = stacked.withColumn("_previous", F.last("_previous", ignorenulls=True).over(so_far))
    return scanned.where("_current is not null").select("entity_type", "id", "_current", "_previous")


def previous_cycle(transitions: DataFrame, base: DataFrame) -> DataFrame:
    """Of the cycles that ended before the current one starts, the transition telling the latest."""
    told = effective_tenure(transitions).columns
    found = previous_scan(transitions, base, told, [F.col("id")])
    return found.where("_previous is not null").select("_previous.*")


_CURRENT = {
    "name": "name",
    "state": "state",
    "activation_date": "activation_date",
    "user_id": "user_id",
    "vertical": "vertical",
    "current_effective_start": "current_tenure_start",
    "current_effective_end": "current_tenure_end",
    "tenure_in_months": "current_tenure_months",
    "pre_tax_amount": "pre_tax_amount",
}
_PREVIOUS = {
    "effective_tenure_start": "prev_tenure_start",
    "effective_tenure_end": "prev_tenure_end",
    "tenure_in_months": "prev_tenure_months",
    "pre_tax_amount": "prev_pre_tax_amount",
    "entity_state": "entity_state",
}


def _renamed(columns: dict[str, str]) -> list[Column]:
    return [F.col(c).alias(name) for c, name in columns.items()]


def current_vs_previous(base: DataFrame, previous: DataFrame, *, ordered: bool = False) -> DataFrame:
    """Every holding of the base beside the cycle before its current one."""
    before = previous.select("entity_type", F.col("entity_id").alias("id"), *_renamed(_PREVIOUS))
    rows = base.select("id", "entity_type", *_renamed(_CURRENT)).join(before, ["entity_type", "id"], "left")
    rows = rows.select("id", "entity_type", *_CURRENT.values(), *_PREVIOUS.values())
    return rows.orderBy("id", "entity_type") if ordered else rows


def base_with_previous(base: DataFrame, transitions: DataFrame, *, ordered: bool = False) -> DataFrame:
    """``current_vs_previous`` straight from the transitions, in one scan of cycle ends and holdings."""
    found = previous_scan(transitions, base, list(_PREVIOUS), _renamed(_CURRENT))
    rows = found.select("id", "entity_type", "_current.*", *[F.col(f"_previous.{c}").alias(name) for c, name in _PREVIOUS.items()])
    return rows.orderBy("id", "entity_type") if ordered else rows
