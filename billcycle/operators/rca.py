"""Root-cause classes: why an entity is in one month's snapshot, the other's, or both."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billcycle.functions.dates import month_start
from billcycle.functions.money import as_amount, money, money_sum
from billcycle.operators.base import purchases
from billcycle.operators.compare import stack_sides, unmatched
from billcycle.schemas import CANCELLED_STATE, PICKED_UP_STATE

BOTH = "BOTH"
_COLUMNS = ("entity_id", "activation_date", "cycle_amount", "period_end")


def rca_side_aggregate(snapshot: DataFrame, prefix: str) -> DataFrame:
    """Per entity: latest activation, number of cycles, amount, last period end."""
    return snapshot.groupBy("entity_id").agg(
        F.max("activation_date").alias("activation_date"),
        F.count(F.lit(1)).alias(f"{prefix}_cycles"),
        money_sum("cycle_amount").alias(f"{prefix}_amount"),
        F.max("period_end").alias(f"{prefix}_max_end"),
    )


def rca_presence(
    a: DataFrame,
    b: DataFrame,
    *,
    left: str = "feb",
    right: str = "mar",
    labels: tuple[str, str] = ("Feb", "March"),
) -> DataFrame:
    """Both sides' aggregates in one row per entity, with the side(s) it is present on.

    One aggregate over the stacked snapshots in place of a full outer join of two.
    """
    aggregates = []
    for prefix, side in ((left, ~F.col("_in_b")), (right, F.col("_in_b"))):
        aggregates += [
            F.bool_or(side).alias(f"_in_{prefix}"),
            F.max(F.when(side, F.col("activation_date"))).alias(f"_activation_{prefix}"),
            F.count(F.when(side, F.lit(1))).alias(f"{prefix}_cycles"),
            money_sum("cycle_amount", side).alias(f"{prefix}_amount"),
            F.max(F.when(side, F.col("period_end"))).alias(f"{prefix}_max_end"),
        ]
    rows = stack_sides(a, b, _COLUMNS).groupBy("entity_id", unmatched()).agg(*aggregates)
    in_a, in_b = F.col(f"_in_{left}"), F.col(f"_in_{right}")
    return rows.select(
        "entity_id",
        F.when(in_a & in_b, BOTH)
        .when(in_a, f"{labels[0].upper()}_ONLY")
        .otherwise(f"{labels[1].upper()}_ONLY")
        .alias("presence"),
        F.coalesce(f"_activation_{left}", f"_activation_{right}").alias("activation_date"),
        *[
            c
            for p, present in ((left, in_a), (right, in_b))
            for c in (
                F.when(present, F.col(f"{p}_cycles")).alias(f"{p}_cycles"),
                F.col(f"{p}_amount"),
                F.col(f"{p}_max_end"),
            )
        ],
    )


def rca_reason(
    presence: DataFrame,
    items: DataFrame,
    links: DataFrame,
    purchase_orders: DataFrame,
    *,
    second_month: str | dt.date,
    left: str = "feb",
    right: str = "mar",
    labels: tuple[str, str] = ("Feb", "March"),
    every_link: bool = False,
) -> DataFrame:
    """Put every entity in the first class that fits.

    Purchase links are reduced to the latest live one per item, so an entity is classified once.
    ``every_link`` counts it once per link, as a plain join would. All links of an item that agree
    in what the classes ask (live order or not, before the second month or not) stay one row, with
    their number in ``link_rows``; at most three rows come out of any item.
    """
    second = F.lit(month_start(second_month))
    first = F.add_months(second, -1)
    bought = purchases(links, purchase_orders, "item_id")
    live = F.col("live_order_id").isNotNull()
    if every_link:
        group = ["id", live.alias("_live"), (F.col("purchased_at") < second).alias("_early")]
        kept = bought.groupBy(*group).agg(
            F.max("purchased_at").alias("_purchased_at"),
            F.max("live_order_id").alias("rto_order_id"),
            F.count(F.lit(1)).alias("link_rows"),
        ).drop("_live", "_early")
    else:
        kept = bought.where(live).groupBy("id").agg(
            F.max_by("purchased_at", "link_id").alias("_purchased_at"),
            F.max_by("live_order_id", "link_id").alias("rto_order_id"),
            F.lit(1).cast("bigint").alias("link_rows"),
        )
    holding = items.select(
        F.col("id").alias("entity_id"), F.col("state").alias("item_state"), F.col("pickup_date").alias("_pickup")
    )
    rows = (
        presence.join(holding, "entity_id", "left")
        .join(kept.withColumnRenamed("id", "entity_id"), "entity_id", "left")
        .withColumns(
            {
                "actual_pickup_dt": F.coalesce("_pickup", "_purchased_at"),
                "link_rows": F.coalesce("link_rows", F.lit(1)),
            }
        )
        .drop("_pickup", "_purchased_at")
    )

    a_name, b_name = labels
    only_a = F.col("presence") == f"{a_name.upper()}_ONLY"
    only_b = F.col("presence") == f"{b_name.upper()}_ONLY"
    both = F.col("presence") == BOTH
    picked_up = F.col("item_state") == PICKED_UP_STATE
    pickup, activation = F.col("actual_pickup_dt"), F.col("activation_date")
    last_end = F.col(f"{left}_max_end")
    a_cycles, b_cycles = F.col(f"{left}_cycles"), F.col(f"{right}_cycles")
    a_amount = F.round(F.coalesce(f"{left}_amount", F.lit(0)), 2)
    b_amount = F.round(F.coalesce(f"{right}_amount", F.lit(0)), 2)
    # fixed values: the class names of the report, with the month names filled in
    reasons = [
        (only_a & picked_up & (pickup < second), f"1A. Picked Up Before {b_name}"),
        (only_a & picked_up & (pickup >= second), f"1B. Picked Up In/After {b_name}"),
        (only_a & F.col("rto_order_id").isNotNull(), "1C. RTP Converted"),
        (only_a & (last_end < second), f"1D. All Cycles Ended Before {b_name}"),
        (only_a & (F.col("item_state") == CANCELLED_STATE), "1E. Cancelled"),
        (only_a & (last_end >= second), f"1F. ⚠ Should Be in {b_name} (Needs Investigation)"),
        (only_a, f"1G. Other ({a_name} Only)"),
        (only_b & (activation >= second), f"2A. New Activation in {b_name}"),
        (only_b & (activation >= first), f"2B. Activated in {a_name} (Missing from {a_name} Snapshot)"),
        (only_b & (activation < first), f"2C. Old Item Re-appeared in {b_name}"),
        (only_b, f"2D. Other ({b_name} Only)"),
        (both & (a_cycles == b_cycles) & (a_amount == b_amount), "3A. No Material Change"),
        (both & (b_cycles > a_cycles), f"3D. More Cycles in {b_name} (Renewed/Extended)"),
        (both & (b_cycles < a_cycles), f"3E. Fewer Cycles in {b_name}"),
        (both & (b_amount != a_amount), "3F. Amount Changed (Same Cycle Count)"),
        (both, "3G. Other Change"),
    ]
    reason = F.lit("9. Unclassified")
    for condition, text in reversed(reasons):
        reason = F.when(condition, F.lit(text)).otherwise(reason)
    return rows.withColumn("rca_reason", reason)


def rca_summary(reasons: DataFrame, *, left: str = "feb", right: str = "mar") -> DataFrame:
    """Entities, amounts and cycles per presence and reason."""
    weight = F.col("link_rows")

    def amount(side: str):
        # both factors keep their scale: Spark would take digits off a wider product
        value = F.coalesce(money(f"{side}_amount"), F.lit(0)).cast("decimal(27,6)")
        return F.sum(value * weight.cast("decimal(10,0)"))

    totals = reasons.groupBy("presence", "rca_reason").agg(
        F.sum(weight).alias("item_count"),
        amount(left).alias("_a"),
        amount(right).alias("_b"),
        F.sum(F.col(f"{left}_cycles") * weight).alias(f"{left}_total_cycles"),
        F.sum(F.col(f"{right}_cycles") * weight).alias(f"{right}_total_cycles"),
    )
    return totals.select(
        "presence",
        "rca_reason",
        "item_count",
        as_amount(F.col("_a")).alias(f"{left}_total_amount"),
        as_amount(F.col("_b")).alias(f"{right}_total_amount"),
        as_amount(F.col("_b") - F.col("_a")).alias("delta_amount"),
        f"{left}_total_cycles",
        f"{right}_total_cycles",
    ).orderBy("rca_reason", "presence")
