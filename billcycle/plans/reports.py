"""The reports a user runs: tables in, one DataFrame out."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from billcycle.functions.dates import next_month
from billcycle.operators import base, compare, cycles, rca

Month = str | dt.date


@dataclass(frozen=True)
class LogTables:
    state_transitions: DataFrame
    events: DataFrame
    addresses: DataFrame | None = None


@dataclass(frozen=True)
class HoldingTables:
    items: DataFrame
    item_links: DataFrame
    purchase_orders: DataFrame
    attachments: DataFrame | None = None
    attachment_links: DataFrame | None = None


def city_cycles(
    log: LogTables, month: Month, city_id: int | None, *, vertical: str | None, renumber: bool = False
) -> DataFrame:
    """A month's billing cycles of one city, straight from the log."""
    snapshots = cycles.snapshot_extract(
        log.state_transitions,
        log.addresses if city_id is not None else None,
        log.events,
        city_id=city_id,
        vertical=vertical,
        named=False,
    )
    return cycles.with_event_name(cycles.month_snapshot(snapshots, month, renumber=renumber), log.events)


def snapshots_of_months(
    log: LogTables, months: Sequence[Month], city_id: int | None = None, *, vertical: str | None
) -> DataFrame:
    """Cycles with realised revenue, tagged by month: what the snapshot table is filled with."""
    snapshots = cycles.snapshot_extract(
        log.state_transitions,
        log.addresses if city_id is not None else None,
        city_id=city_id,
        vertical=vertical,
    )
    return cycles.with_realised_revenue(cycles.month_snapshots(cycles.billing_timeline(snapshots), months))


def current_against_previous(
    log: LogTables,
    holdings: HoldingTables,
    as_of: Month,
    *,
    keep_rule: str = "cycle_end",
    vertical: str | None,
    entity_ids: Sequence[int] | None = None,
    ordered: bool = False,
) -> DataFrame:
    """Items, and attachments where given, beside the billing cycle before the current one."""
    options = {"as_of": as_of, "keep_rule": keep_rule, "vertical": vertical, "entity_ids": entity_ids}
    billed = base.current_base(holdings.items, holdings.item_links, holdings.purchase_orders, **options)
    kinds = [base.ITEM_HOLDING.entity_type]
    if holdings.attachments is not None:
        billed = base.all_base(
            billed,
            base.attachment_base(
                holdings.attachments, holdings.attachment_links, holdings.purchase_orders, **options
            ),
        )
        kinds.append(base.ATTACHMENT_HOLDING.entity_type)
    transitions = base.billing_transitions(
        log.state_transitions, log.events, vertical=vertical, entity_types=kinds, entity_ids=entity_ids
    )
    return base.base_with_previous(billed, transitions, ordered=ordered)


def bridge_report(a: DataFrame, b: DataFrame, **sides) -> DataFrame:
    """Change drivers of two snapshots with counts, amounts and shares."""
    return compare.bridge_detail(compare.classify_changes(compare.entity_pair(a, b, **sides), **sides), **sides)


def rca_report(
    a: DataFrame,
    b: DataFrame,
    holdings: HoldingTables,
    first_month: Month,
    *,
    every_link: bool = False,
    **sides,
) -> DataFrame:
    """Root-cause summary of two consecutive months' snapshots."""
    reasons = rca.rca_reason(
        rca.rca_presence(a, b, **sides),
        holdings.items,
        holdings.item_links,
        holdings.purchase_orders,
        second_month=next_month(first_month),
        every_link=every_link,
        **sides,
    )
    return rca.rca_summary(reasons)
