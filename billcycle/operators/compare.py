"""Two month snapshots against each other: presence, revenue bridge, change drivers.

Everything at entity level comes from one table, :func:`entity_pair`: both snapshots are stacked
with a side flag and aggregated once per entity. A full outer join of two aggregates would give
the same rows for twice the shuffles, and an entity with very many cycles is reduced to one row
per task before anything is shuffled.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billcycle.functions.dates import month_start
from billcycle.functions.money import as_amount, money_sum

# fixed values: the change drivers, and the difference up to which a bridge counts as balanced
CHURNED = "churned"
NEW_ACTIVATION = "new_activation"
STABLE = "stable"
RATE_CHANGE = "rate_change"
PERIOD_TYPE_SHIFT = "period_type_shift"
PARTIAL_PERIOD = "partial_period"
REALISED_ONLY_CHANGE = "realised_only_change"
OTHER = "other"
TOTAL = "TOTAL"
BALANCE_TOLERANCE = 1.0

_MEASURES = (
    "entity_id", "realised_revenue", "cycle_amount", "cycle_num", "days", "period_type",
    "activation_date", "pickup_date",
)


def stack_sides(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of both snapshots, ``_in_b`` telling the side."""
    return a.select(*columns, F.lit(False).alias("_in_b")).unionByName(
        b.select(*columns, F.lit(True).alias("_in_b"))
    )


def unmatched() -> Column:
    """Part of the key of stacked sides: a NULL id equals no id of the other side, so its rows stay apart by side."""
    return F.when(F.col("entity_id").isNull(), F.col("_in_b")).alias("_unmatched")


def presence_summary(a: DataFrame, b: DataFrame, *, left: str = "feb", right: str = "mar") -> DataFrame:
    """One row: distinct entities in a, in b, in both, only in a, only in b."""
    sides = stack_sides(a, b, ["entity_id"]).where(F.col("entity_id").isNotNull())
    seen = sides.groupBy("entity_id").agg(
        F.bool_or(~F.col("_in_b")).alias("a"), F.bool_or(F.col("_in_b")).alias("b")
    )
    in_a, in_b = F.col("a"), F.col("b")
    return seen.agg(
        F.count_if(in_a).alias(f"{left}_total"),
        F.count_if(in_b).alias(f"{right}_total"),
        F.count_if(in_a & in_b).alias("common_both"),
        F.count_if(in_a & ~in_b).alias(f"{left}_only"),
        F.count_if(in_b & ~in_a).alias(f"{right}_only"),
    )


def only_in_a(a: DataFrame, b: DataFrame, key: str = "entity_id", *, ordered: bool = False) -> DataFrame:
    """All rows of ``a`` whose key ``b`` does not hold (churned)."""
    # no distinct below the join: it is not needed, and Spark splits a hot key only between plain shuffles
    rows = a.join(b.select(key), key, "left_anti")
    return rows.orderBy(key) if ordered else rows


def only_in_b(a: DataFrame, b: DataFrame, key: str = "entity_id", *, ordered: bool = False) -> DataFrame:
    """All rows of ``b`` whose key ``a`` does not hold (new)."""
    return only_in_a(b, a, key, ordered=ordered)


CYCLE_KEY = ("entity_id", "period_start", "period_end")


def common_side_by_side(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str] = CYCLE_KEY,
    *,
    left: str = "feb",
    right: str = "mar",
    ordered: bool = False,
) -> DataFrame:
    """Inner join with every other column prefixed.

    By default a cycle meets only itself in the other month and the result is as long as the input.
    With ``("entity_id",)`` the result is what the comparison sheet lists, each of an entity's cycles in a
    beside each of its cycles in b: m x n rows for an entity of m and n cycles, so ask for it
    only where entities have few.
    """

    def prefixed(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(*keys, *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c not in keys])

    rows = prefixed(a, left).join(prefixed(b, right), list(keys))
    return rows.orderBy(*keys) if ordered else rows


def _measures(side: Column | None, period_types: Sequence[str] | None) -> dict[str, Column]:
    def on_side(column: str) -> Column:
        return F.col(column) if side is None else F.when(side, F.col(column))

    if period_types is None:
        types = F.sort_array(F.collect_set(on_side("period_type")))
    else:
        # flags of fixed width; a type that has none fails the query
        strange = F.bool_or(~on_side("period_type").isin(list(period_types)))
        known = F.array_compact(
            F.array(
                *[F.when(F.bool_or(on_side("period_type") == t), F.lit(t)) for t in sorted(period_types)]
            )
        )
        refused = F.raise_error(F.lit(f"a period type other than {', '.join(period_types)}")).cast("array<string>")
        types = F.when(strange, refused).otherwise(known)
    return {
        "realised_total": money_sum("realised_revenue", side),
        "cycle_amount": as_amount(money_sum("cycle_amount", side)),
        "cycle_count": F.count(F.lit(1) if side is None else F.when(side, F.lit(1))),
        "max_cycle_num": F.max(on_side("cycle_num")),
        "total_days": F.sum(on_side("days")),
        "period_types": types,
        "activation_date": F.min(on_side("activation_date")),
        "pickup_date": F.max(on_side("pickup_date")),
    }


def entity_aggregate(snapshot: DataFrame, period_types: Sequence[str] | None = None) -> DataFrame:
    """One row per entity of a snapshot, with whatever period types it has.

    ``period_types`` asserts that there are no others; the aggregate then has fixed-width buffers only.
    """
    found = _measures(None, period_types)
    realised = as_amount(found.pop("realised_total")).alias("realised_revenue")
    return snapshot.groupBy("entity_id").agg(realised, *[c.alias(n) for n, c in found.items()])


_PAIR_NAMES = {
    "cycle_amount": "cycle_amount",
    "cycle_count": "cycle_count",
    "max_cycle_num": "max_cycle_num",
    "total_days": "days",
    "period_types": "period_types",
    "activation_date": "activation_date",
    "pickup_date": "pickup_date",
}


def entity_pair(
    a: DataFrame,
    b: DataFrame,
    *,
    left: str = "feb",
    right: str = "mar",
    period_types: Sequence[str] | None = None,
) -> DataFrame:
    """One row per entity of either snapshot with the aggregates of both sides.

    ``in_<side>`` tells presence; ``<side>_realised_total`` is the exact sum behind the rounded
    ``<side>_realised``.
    """
    return _pair_of(stack_sides(a, b, _MEASURES), left, right, period_types)


def entity_pair_of_months(
    snapshots: DataFrame,
    first: str | dt.date,
    second: str | dt.date,
    *,
    left: str = "feb",
    right: str = "mar",
    period_types: Sequence[str] | None = None,
) -> DataFrame:
    """:func:`entity_pair` of two months of one snapshot table, which is then read once."""
    months = [F.lit(month_start(m)) for m in (first, second)]
    sides = snapshots.where(F.col("snapshot_month").isin(months)).select(
        *_MEASURES, (F.col("snapshot_month") == months[1]).alias("_in_b")
    )
    return _pair_of(sides, left, right, period_types)


def _pair_of(sides: DataFrame, left: str, right: str, period_types: Sequence[str] | None) -> DataFrame:
    aggregates: list[Column] = []
    for prefix, side in ((left, ~F.col("_in_b")), (right, F.col("_in_b"))):
        found = _measures(side, period_types)
        aggregates.append(F.bool_or(side).alias(f"in_{prefix}"))
        aggregates.append(found["realised_total"].alias(f"{prefix}_realised_total"))
        aggregates += [found[n].alias(f"{prefix}_{short}") for n, short in _PAIR_NAMES.items()]
    return (
        sides.groupBy("entity_id", unmatched())
        .agg(*aggregates)
        .drop("_unmatched")
        .withColumns(
            {f"{p}_realised": as_amount(F.col(f"{p}_realised_total")) for p in (left, right)}
        )
    )


def revenue_bridge(
    pair: DataFrame, *, left: str = "feb", right: str = "mar", labels: tuple[str, str] = ("Feb", "Mar")
) -> DataFrame:
    """Eight rows: totals, delta, the three components, what they explain, the residual."""
    a, b = F.col(f"{left}_realised"), F.col(f"{right}_realised")
    in_a, in_b = F.col(f"in_{left}"), F.col(f"in_{right}")

    def amount(total: Column) -> Column:
        return F.coalesce(as_amount(total), F.lit(0.0))

    sums = pair.agg(
        amount(F.sum(f"{left}_realised_total")).alias("a_total"),
        amount(F.sum(f"{right}_realised_total")).alias("b_total"),
        amount(money_sum(a, in_a & ~in_b)).alias("churned"),
        amount(money_sum(b, in_b & ~in_a)).alias("new"),
        amount(money_sum(a, in_a & in_b)).alias("a_common"),
        amount(money_sum(b, in_a & in_b)).alias("b_common"),
    )
    sums = sums.withColumns(
        {
            "total_delta": F.round(F.col("b_total") - F.col("a_total"), 2),
            "common_delta": F.round(F.col("b_common") - F.col("a_common"), 2),
        }
    )
    sums = sums.withColumn("explained", F.round(F.col("new") - F.col("churned") + F.col("common_delta"), 2))
    residual = F.round(F.col("total_delta") - F.col("explained"), 2)
    nothing, zero = F.lit(None).cast("double"), F.lit(0.0)

    def line(text: str, delta: Column, on_a: Column = nothing, on_b: Column = nothing) -> Column:
        return F.struct(
            F.lit(text).alias("category"),
            delta.alias("delta_realised"),
            on_a.alias(f"{left}_realised"),
            on_b.alias(f"{right}_realised"),
        )

    first, second = labels
    # fixed values: the lines of the bridge, with the month names filled in
    return sums.select(
        F.inline(
            F.array(
                line(f"{first} total realised revenue", F.col("a_total")),
                line(f"{second} total realised revenue", F.col("b_total")),
                line(f"Total delta ({second} - {first})", F.col("total_delta")),
                line(f"Component 1: Churned ({left}-only)", zero - F.col("churned"), F.col("churned"), zero),
                line("Component 2: New activations", F.col("new"), zero, F.col("new")),
                line(
                    "Component 3: Common entity delta",
                    F.col("common_delta"), F.col("a_common"), F.col("b_common"),
                ),
                line("Explained delta (sum of components)", F.col("explained")),
                line("Residual (should be 0)", residual),
            )
        )
    )


def classify_changes(pair: DataFrame, *, left: str = "feb", right: str = "mar") -> DataFrame:
    """Every entity of the pair with deltas, ``change_driver`` and ``change_detail``."""
    in_a, in_b = F.col(f"in_{left}"), F.col(f"in_{right}")
    common = in_a & in_b

    def of(prefix: str, name: str) -> Column:
        return F.col(f"{prefix}_{name}")

    realised_a = F.when(in_a, of(left, "realised")).otherwise(F.lit(0.0))
    realised_b = F.when(in_b, of(right, "realised")).otherwise(F.lit(0.0))
    rows = pair.withColumns({f"{left}_realised": realised_a, f"{right}_realised": realised_b})
    rows = rows.withColumns(
        {
            "delta_realised": F.round(of(right, "realised") - of(left, "realised"), 2),
            "delta_cycle_amount": F.when(
                common, F.round(of(right, "cycle_amount") - of(left, "cycle_amount"), 2)
            ),
            "delta_days": F.when(common, of(right, "days") - of(left, "days")),
            "cycle_count_changed": F.when(common, of(right, "cycle_count") != of(left, "cycle_count")),
            "period_type_shifted": F.when(common, of(right, "period_types") != of(left, "period_types")),
        }
    )
    delta = F.col("delta_realised")
    driver = (
        F.when(in_a & ~in_b, CHURNED)
        .when(in_b & ~in_a, NEW_ACTIVATION)
        .when(delta == 0, STABLE)
        .when(F.col("delta_cycle_amount") != 0, RATE_CHANGE)
        .when(F.col("period_type_shifted"), PERIOD_TYPE_SHIFT)
        .when(F.col("cycle_count_changed") | (F.col("delta_days") != 0), PARTIAL_PERIOD)
        .when(delta != 0, REALISED_ONLY_CHANGE)
        .otherwise(OTHER)
    )
    return change_detail(rows.withColumn("change_driver", driver), left=left, right=right)


def change_detail(classified: DataFrame, *, left: str = "feb", right: str = "mar") -> DataFrame:
    """Add the direction of a rate change and the types on both sides of a type shift."""
    shift = F.concat(
        F.array_join(f"{left}_period_types", "+"), F.lit(" -> "), F.array_join(f"{right}_period_types", "+")
    )
    driver = F.col("change_driver")
    return classified.withColumn(
        "change_detail",
        F.when(
            driver == RATE_CHANGE, F.when(F.col("delta_cycle_amount") > 0, "upgrade").otherwise("downgrade")
        ).when(driver == PERIOD_TYPE_SHIFT, shift),
    )


def change_driver(pair: DataFrame, *, left: str = "feb", right: str = "mar", ordered: bool = False) -> DataFrame:
    """The entities present on both sides, classified."""
    rows = classify_changes(pair.where(F.col(f"in_{left}") & F.col(f"in_{right}")), left=left, right=right)
    rows = rows.drop(f"in_{left}", f"in_{right}", f"{left}_realised_total", f"{right}_realised_total")
    return rows.orderBy("change_driver", "entity_id") if ordered else rows


def bridge_detail(classified: DataFrame, *, left: str = "feb", right: str = "mar") -> DataFrame:
    """Counts and amounts per driver and detail, share of the total delta, and a TOTAL row.

    Totals come with the groups, by grouping sets over them, and not from another pass over the entities. Churned and new
    appear even when empty.
    """
    a, b = f"{left}_realised", f"{right}_realised"
    always = classified.sparkSession.range(0, 1, 1, 1).select(
        F.explode(F.array(F.lit(CHURNED), F.lit(NEW_ACTIVATION))).alias("change_driver")
    )
    needed = classified.select(
        "entity_id", "change_driver", "change_detail", a, b, "delta_realised",
        f"{left}_realised_total", f"{right}_realised_total",
    )
    groups = (
        needed.unionByName(always, allowMissingColumns=True)
        .groupBy("change_driver", "change_detail")
        .agg(
            F.count("entity_id").alias("entity_count"),
            as_amount(money_sum(a)).alias(a),
            as_amount(money_sum(b)).alias(b),
            as_amount(money_sum("delta_realised")).alias("delta_realised"),
            F.sum(f"{left}_realised_total").alias("_a"),
            F.sum(f"{right}_realised_total").alias("_b"),
        )
    )
    one_sided = F.col("change_driver").isin(CHURNED, NEW_ACTIVATION)
    groups = groups.withColumns(
        {c: F.when(one_sided, F.coalesce(c, F.lit(0.0))).otherwise(F.col(c)) for c in (a, b, "delta_realised")}
    )
    # each group alone, and all of them: the few groups are grouped again, not the entities
    keys = ["change_driver", "change_detail"]
    lines = groups.groupingSets([keys, []], *keys).agg(
        F.grouping("change_driver").alias("_is_total"),
        F.sum("entity_count").alias("entity_count"),
        *[F.sum(c).alias(c) for c in (a, b, "delta_realised")],
        F.coalesce(as_amount(F.sum("_a")), F.lit(0.0)).alias("_total_a"),
        F.coalesce(as_amount(F.sum("_b")), F.lit(0.0)).alias("_total_b"),
    )
    is_total = F.col("_is_total") == 1
    of_total = {
        "change_driver": F.lit(TOTAL),
        "entity_count": F.lit(None).cast("bigint"),
        a: F.col("_total_a"),
        b: F.col("_total_b"),
        "delta_realised": F.round(F.col("_total_b") - F.col("_total_a"), 2),
    }
    lines = lines.withColumns({c: F.when(is_total, value).otherwise(F.col(c)) for c, value in of_total.items()})
    total_delta = F.max(F.when(is_total, F.col("delta_realised"))).over(Window.partitionBy())
    share = F.round(F.try_divide(F.col("delta_realised"), total_delta) * 100, 1)
    lines = lines.withColumn("pct_of_total_delta", F.when(is_total, F.lit(100.0)).otherwise(share)).select(
        *keys, "entity_count", a, b, "delta_realised", "pct_of_total_delta"
    )
    return lines.orderBy(
        F.col("change_driver") == TOTAL, F.abs("delta_realised").desc(), "change_driver", "change_detail"
    )


def bridge_balance(detail: DataFrame) -> DataFrame:
    """One row: total delta, sum of the bridge rows, residual, whether it is within one unit."""
    is_total = F.col("change_driver") == TOTAL
    sums = detail.agg(
        F.max(F.when(is_total, F.col("delta_realised"))).alias("total_delta"),
        as_amount(money_sum("delta_realised", ~is_total)).alias("bridge_sum"),
    )
    residual = F.round(F.col("total_delta") - F.col("bridge_sum"), 2)
    return sums.withColumns({"residual": residual, "balanced": F.abs(residual) < BALANCE_TOLERANCE})


def drilldown(
    classified: DataFrame, driver: str | None = None, *, left: str = "feb", right: str = "mar", ordered: bool = False
) -> DataFrame:
    """The entities behind one driver with the columns that matter for it.

    Without ``driver`` all of them but the stable ones, with every column. ``ordered`` sorts by the
    delta, new activations from the largest, the others from the smallest.
    """
    deltas = ["entity_id", f"{left}_realised", f"{right}_realised", "delta_realised"]
    if driver in (CHURNED, NEW_ACTIVATION):
        side = left if driver == CHURNED else right
        columns = deltas + [
            f"{side}_{c}" for c in ("cycle_amount", "days", "period_types", "activation_date", "pickup_date")
        ]
    else:
        columns = deltas + [f"{left}_cycle_amount", f"{right}_cycle_amount", "delta_cycle_amount"]
        columns += [f"{left}_days", f"{right}_days", "delta_days"]
        columns += [
            f"{side}_{c}"
            for c in ("period_types", "max_cycle_num", "activation_date", "pickup_date")
            for side in (left, right)
        ]
        columns.append("change_detail")
    if driver is None:
        rows = classified.where(F.col("change_driver") != STABLE).select("change_driver", *columns)
    else:
        rows = classified.where(F.col("change_driver") == driver).select(*columns)
    if not ordered:
        return rows
    delta = F.col("delta_realised")
    if driver is None:
        direction = F.when(F.col("change_driver") == NEW_ACTIVATION, -delta).otherwise(delta)
        return rows.orderBy("change_driver", direction, "entity_id")
    return rows.orderBy(delta.desc() if driver == NEW_ACTIVATION else delta.asc(), "entity_id")
