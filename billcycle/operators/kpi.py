"""Monthly KPIs: recurring revenue, active subscriptions, churn, billed revenue.

Months are arguments, and any number of them is answered by one pass over a table: sums and flags
are kept per month, first per customer (hot customers shrink inside the tasks), then overall. For a long run of months
:func:`kpi_series` counts the changes from month to month instead of a flag for each.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billcycle.functions.dates import month_bounds
from billcycle.functions.jsonx import parse_json
from billcycle.functions.money import as_amount, money
from billcycle.schemas import (
    BILLED_STATES,
    DISPLAY_ID_PATH,
    KPI_EXCLUDED_STATES,
    PICKED_UP_STATE,
    RECOGNISED_STATES,
    TAXABLE_AMOUNT_PATH,
)

Month = str | dt.date
ALL, NEW, RETURNING = "All", "New", "Returning"
METRICS = ("mrr", "active_subscriptions", "churned_customers", "revenue_billed")
LOWER_IS_BETTER = ("churned_customers",)


@dataclass(frozen=True)
class KpiTables:
    items: DataFrame
    orders: DataFrame
    revenue_recognitions: DataFrame
    invoice_cycles: DataFrame
    invoiceable_groups: DataFrame


@dataclass(frozen=True)
class KpiFilters:
    """Empty means no filter. Tenure and plan restrict items, so the two revenue KPIs ignore them."""

    city_ids: Sequence[int] = field(default_factory=tuple)
    verticals: Sequence[str] = field(default_factory=tuple)
    customer_type: str = ALL
    tenure_range: tuple[int | None, int | None] | None = None
    plan_months: int | None = None

    def __post_init__(self):
        if self.customer_type not in (ALL, NEW, RETURNING):
            raise ValueError(f"customer_type: {self.customer_type}")


# ---- filters ----------------------------------------------------------------------------------


def _one_of(column: str, values: Sequence) -> Column:
    return F.col(column).isin(list(values)) if values else F.lit(True)


def _in_bucket(tenure_range: tuple[int | None, int | None] | None, column: str) -> Column:
    lo, hi = tenure_range or (None, None)
    above = F.lit(True) if lo is None else F.col(column) >= lo
    return above if hi is None else above & (F.col(column) < hi)


def _on_plan(plan_months: int | None, column: str) -> Column:
    return F.lit(True) if plan_months is None else F.col(column) == plan_months


def filter_city_direct(facts: DataFrame, city_ids: Sequence[int], column: str = "city_id") -> DataFrame:
    """Facts of the given cities; no city means all."""
    return facts.where(_one_of(column, city_ids))


def filter_vertical(facts: DataFrame, verticals: Sequence[str], column: str = "vertical") -> DataFrame:
    return facts.where(_one_of(column, verticals))


def filter_tenure_bucket(
    items: DataFrame, tenure_range: tuple[int | None, int | None] | None, column: str = "tenure_in_months"
) -> DataFrame:
    """Items with a tenure in the half-open range; either end may be open."""
    return items.where(_in_bucket(tenure_range, column))


def filter_plan(items: DataFrame, plan_months: int | None, column: str = "tenure_in_months") -> DataFrame:
    return items.where(_on_plan(plan_months, column))


def filter_city_customers(
    rows: DataFrame, groups: DataFrame, city_ids: Sequence[int], customer: str = "customer_identifier"
) -> DataFrame:
    """Rows of customers that have an invoice group in one of the cities."""
    if not city_ids:
        return rows
    # no distinct below the join: it is not needed, and Spark splits a hot key only between plain shuffles
    located = filter_city_direct(groups, city_ids).select(F.col("customer_identifier").alias(customer))
    return rows.join(located, customer, "left_semi")


def customer_items(items: DataFrame, orders: DataFrame, vertical: str | None) -> DataFrame:
    """Items of a vertical (None: of all) with the customer and the vertical of their order."""
    order = parse_json(
        orders.select(F.col("id").alias("order_id"), F.col("vertical").alias("order_vertical"), "user_details"),
        "user_details",
        {"customer_identifier": (DISPLAY_ID_PATH, "string")},
    )
    rows = items if vertical is None else items.where(F.col("vertical") == vertical)
    return rows.join(order, "order_id")


def customer_rows(items: DataFrame, orders: DataFrame, vertical: str | None) -> DataFrame:
    """Per customer the number of items and the day of the first activation, in one pass."""
    return (
        customer_items(items, orders, vertical)
        .groupBy("customer_identifier")
        .agg(F.count(F.lit(1)).alias("row_count"), F.min("activation_date").alias("first_activation_date"))
    )


def first_activation(items: DataFrame, orders: DataFrame, vertical: str | None) -> DataFrame:
    """Per customer the day the first rental item was activated."""
    return (
        customer_items(items, orders, vertical)
        .groupBy("customer_identifier")
        .agg(F.min("activation_date").alias("first_activation_date"))
    )


def _of_type(customer_type: str, start: dt.date, end: dt.date, column: str = "first_activation_date") -> Column:
    day = F.col(column)
    if customer_type == NEW:
        return (day >= F.lit(start)) & (day < F.lit(end))
    if customer_type == RETURNING:
        return day < F.lit(start)
    return F.lit(True)


def customer_type(month: Month) -> Column:
    """New (first activated in the month), Returning (before it) or NULL, of rows with ``first_activation_date``."""
    start, end, _ = month_bounds(month)
    return F.when(_of_type(NEW, start, end), NEW).when(_of_type(RETURNING, start, end), RETURNING)


def filter_new_returning(
    rows: DataFrame,
    activations: DataFrame | None,
    customer_type: str,
    month: Month,
    customer: str = "customer_identifier",
) -> DataFrame:
    """Rows of customers first activated in the month (New) or before it (Returning).

    ``activations`` has a row for each customer; rows that a customer may have very many of are better reduced per customer
    first, with ``first_activation_date`` among them, and filtered without a join (``activations=None``).
    """
    if customer_type == ALL:
        return rows
    start, end, _ = month_bounds(month)
    if activations is None:
        return rows.where(_of_type(customer_type, start, end))
    chosen = activations.where(_of_type(customer_type, start, end)).select(
        F.col("customer_identifier").alias(customer)
    )
    return rows.join(chosen, customer, "left_semi")


# ---- sums of facts ----------------------------------------------------------------------------


def _amounts(
    facts: DataFrame, date_column: str, states: Sequence[str], months: Sequence[Month], filters: KpiFilters
) -> DataFrame:
    """Live facts of the months: customer, amount, a flag per month. The bounds reach the scan."""
    day = F.col(date_column)
    inside = [(day >= F.lit(start)) & (day < F.lit(end)) for start, end, _ in map(month_bounds, months)]
    live = facts.where(F.col("deleted_at").isNull() & F.col("state").isin(list(states)))
    live = live.where(reduce(lambda x, y: x | y, inside))
    live = filter_vertical(filter_city_direct(live, filters.city_ids), filters.verticals)
    kept = live.select(
        "customer_identifier", "monetary_components", *[c.alias(f"_in{i}") for i, c in enumerate(inside)]
    )
    amounts = parse_json(kept, "monetary_components", {"_amount": (TAXABLE_AMOUNT_PATH, "double")})
    return amounts.withColumn("_amount", money("_amount"))


def _recognised(tables: KpiTables, months: Sequence[Month], filters: KpiFilters) -> DataFrame:
    return _amounts(tables.revenue_recognitions, "to_be_recognised_on", RECOGNISED_STATES, months, filters)


def _billed(tables: KpiTables, months: Sequence[Month], filters: KpiFilters) -> DataFrame:
    return _amounts(tables.invoice_cycles, "created_at", BILLED_STATES, months, filters)


def _total(total: Column) -> Column:
    """No facts and no amounts count as 0."""
    return F.coalesce(as_amount(total), F.lit(0.0))


def _sums(
    amounts: DataFrame, name: str, months: Sequence[Month], tables: KpiTables, filters: KpiFilters, vertical: str | None
) -> DataFrame:
    """One row, a column ``<name><i>`` per month."""
    per_month = {
        f"{name}{i}": F.sum(F.when(F.col(f"_in{i}"), F.col("_amount"))) for i in range(len(months))
    }
    if filters.customer_type == ALL:
        return amounts.agg(*[_total(total).alias(c) for c, total in per_month.items()])
    per_customer = amounts.groupBy("customer_identifier").agg(*[t.alias(c) for c, t in per_month.items()])
    activated = first_activation(tables.items, tables.orders, vertical)
    return per_customer.join(activated, "customer_identifier").agg(
        *[
            _total(F.sum(F.when(_of_type(filters.customer_type, start, end), F.col(c)))).alias(c)
            for c, (start, end, _) in zip(per_month, map(month_bounds, months))
        ]
    )


# ---- counts of customers ----------------------------------------------------------------------


def customer_activity(
    tables: KpiTables,
    months: Sequence[Month],
    filters: KpiFilters = KpiFilters(),
    *,
    vertical: str | None,
    metrics: Sequence[str] | None = None,
) -> DataFrame:
    """Per customer: first activation, ``active<i>`` and ``churned<i>`` for every month.

    Without a customer type only customers with a flag come out, and of ``metrics`` (``active``, ``churned``) only those
    named need be right. Made for a few months; :func:`kpi_series` is for many.

    Distinct counts become flags per customer: one aggregate answers both KPIs for every month,
    and the first activation that tells new from returning customers falls out of it as well.
    Vertical, tenure and plan restrict the items that set a flag, not those that activate.
    """
    allowed = (
        _one_of("order_vertical", filters.verticals)
        & _in_bucket(filters.tenure_range, "tenure_in_months")
        & _on_plan(filters.plan_months, "tenure_in_months")
    )
    pickup = F.col("pickup_date")
    not_excluded = ~F.col("state").isin(list(KPI_EXCLUDED_STATES))
    flags: dict[str, Column] = {}
    for i, (start, end, last) in enumerate(map(month_bounds, months)):
        flags[f"active{i}"] = (
            not_excluded & (F.col("activation_date") <= F.lit(last)) & (pickup.isNull() | (pickup > F.lit(last)))
        )
        flags[f"churned{i}"] = (
            (F.col("state") == PICKED_UP_STATE) & (pickup >= F.lit(start)) & (pickup < F.lit(end))
        )
    items = tables.items
    if filters.customer_type == ALL:
        # first activations are not asked for, so only items that set a flag are read and joined
        wanted = [c for name, c in flags.items() if metrics is None or name.startswith(tuple(metrics))]
        on_items = _in_bucket(filters.tenure_range, "tenure_in_months") & _on_plan(filters.plan_months, "tenure_in_months")
        items = items.where(reduce(lambda x, y: x | y, wanted) & on_items)
    return (
        customer_items(items, tables.orders, vertical)
        .where(F.col("customer_identifier").isNotNull())
        .groupBy("customer_identifier")
        .agg(
            F.min("activation_date").alias("first_activation_date"),
            *[F.bool_or(allowed & c).alias(name) for name, c in flags.items()],
        )
    )


def _counts(months: Sequence[Month], filters: KpiFilters, legacy_bound: bool, counted: Column) -> list[Column]:
    """Count columns over ``customer_activity``.

    ``legacy_bound`` treats the last day of the month as not new in the active count.
    """
    columns = []
    for i, (start, end, last) in enumerate(map(month_bounds, months)):
        active_type = _of_type(filters.customer_type, start, last if legacy_bound else end)
        churned_type = _of_type(filters.customer_type, start, end)
        columns.append(F.count_if(counted & F.col(f"active{i}") & active_type).alias(f"active{i}"))
        columns.append(F.count_if(counted & F.col(f"churned{i}") & churned_type).alias(f"churned{i}"))
    return columns


def customers_by_month(
    tables: KpiTables,
    months: Sequence[Month],
    filters: KpiFilters = KpiFilters(),
    *,
    vertical: str | None,
    legacy_bound: bool = False,
    metrics: Sequence[str] | None = None,
) -> DataFrame:
    """Active and churned customers of the months, one row, columns ``active<i>``, ``churned<i>``."""
    activity = customer_activity(tables, months, filters, vertical=vertical, metrics=metrics)
    located = filter_city_customers(activity, tables.invoiceable_groups, filters.city_ids)
    return located.agg(*_counts(months, filters, legacy_bound, F.lit(True)))


# ---- one KPI of one month ---------------------------------------------------------------------


def kpi_mrr(
    tables: KpiTables, month: Month, filters: KpiFilters = KpiFilters(), *, vertical: str | None
) -> DataFrame:
    """Recognised revenue of the month."""
    sums = _sums(_recognised(tables, [month], filters), "mrr", [month], tables, filters, vertical)
    return sums.select(F.col("mrr0").alias("mrr"))


def kpi_revenue_billed(
    tables: KpiTables, month: Month, filters: KpiFilters = KpiFilters(), *, vertical: str | None
) -> DataFrame:
    """Revenue of the billing cycles created in the month."""
    sums = _sums(_billed(tables, [month], filters), "billed", [month], tables, filters, vertical)
    return sums.select(F.col("billed0").alias("revenue_billed"))


def kpi_active_subscriptions(
    tables: KpiTables, month: Month, filters: KpiFilters = KpiFilters(), **options
) -> DataFrame:
    """Customers with a rental item active at the end of the month."""
    counts = customers_by_month(tables, [month], filters, metrics=["active"], **options)
    return counts.select(F.col("active0").alias("active_subscriptions"))


def kpi_churned_customers(
    tables: KpiTables, month: Month, filters: KpiFilters = KpiFilters(), **options
) -> DataFrame:
    """Customers with a rental item picked up in the month."""
    counts = customers_by_month(tables, [month], filters, metrics=["churned"], **options)
    return counts.select(F.col("churned0").alias("churned_customers"))


# ---- all KPIs ---------------------------------------------------------------------------------


_PREFIXES = {
    "mrr": "mrr",
    "active_subscriptions": "active",
    "churned_customers": "churned",
    "revenue_billed": "billed",
}


def _metric_rows(row: DataFrame, metrics: Sequence[str], n_months: int) -> DataFrame:
    """The one-row ``row`` as a row per metric with a column ``m<i>`` per month."""
    return row.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(metric).alias("metric"),
                        *[F.col(f"{_PREFIXES[metric]}{i}").cast("double").alias(f"m{i}") for i in range(n_months)],
                    )
                    for metric in metrics
                ]
            )
        )
    )


def kpi_by_month(
    tables: KpiTables,
    months: Sequence[Month],
    filters: KpiFilters = KpiFilters(),
    *,
    vertical: str | None,
    legacy_bound: bool = False,
) -> DataFrame:
    """One row per metric, a column ``m<i>`` per month; every table is read once.

    Without a customer type the sums need no customer. With one, both sums are taken per customer
    and meet the customer's first activation in the one join that all four metrics share.
    """
    n = len(months)
    if filters.customer_type == ALL:
        return (
            _metric_rows(_sums(_recognised(tables, months, filters), "mrr", months, tables, filters, vertical), ["mrr"], n)
            .unionByName(
                _metric_rows(
                    customers_by_month(tables, months, filters, vertical=vertical),
                    ["active_subscriptions", "churned_customers"],
                    n,
                )
            )
            .unionByName(
                _metric_rows(
                    _sums(_billed(tables, months, filters), "billed", months, tables, filters, vertical),
                    ["revenue_billed"],
                    n,
                )
            )
        )

    amounts = (
        _recognised(tables, months, filters)
        .withColumn("_metric", F.lit("mrr"))
        .unionByName(_billed(tables, months, filters).withColumn("_metric", F.lit("billed")))
    )
    names = [(metric, i) for metric in ("mrr", "billed") for i in range(n)]
    per_customer = amounts.groupBy("customer_identifier").agg(
        *[
            F.sum(F.when((F.col("_metric") == metric) & F.col(f"_in{i}"), F.col("_amount"))).alias(f"{metric}{i}")
            for metric, i in names
        ]
    )
    customers = customer_activity(tables, months, filters, vertical=vertical)
    counted = F.lit(True)
    if filters.city_ids:
        located = filter_city_direct(tables.invoiceable_groups, filters.city_ids).select("customer_identifier")
        customers = customers.join(
            located.distinct().withColumn("_located", F.lit(True)), "customer_identifier", "left"
        )
        counted = F.col("_located").isNotNull()
    bounds = [month_bounds(m) for m in months]
    row = customers.join(per_customer, "customer_identifier", "left").agg(
        *[
            _total(F.sum(F.when(_of_type(filters.customer_type, *bounds[i][:2]), F.col(f"{metric}{i}")))).alias(
                f"{metric}{i}"
            )
            for metric, i in names
        ],
        *_counts(months, filters, legacy_bound, counted),
    )
    return _metric_rows(row, METRICS, n)


# ---- a series of months -----------------------------------------------------------------------


def _month_number(day: str | Column) -> Column:
    return F.year(day) * 12 + F.month(day) - 1


def _monthly_amounts(
    facts: DataFrame, date_column: str, states: Sequence[str], bounds: tuple[dt.date, dt.date], filters: KpiFilters
) -> DataFrame:
    """Live facts within the bounds, which reach the scan: customer, month number, amount."""
    day = F.col(date_column)
    live = facts.where(F.col("deleted_at").isNull() & F.col("state").isin(list(states)))
    live = live.where((day >= F.lit(bounds[0])) & (day < F.lit(bounds[1])))
    live = filter_vertical(filter_city_direct(live, filters.city_ids), filters.verticals)
    kept = live.select("customer_identifier", "monetary_components", _month_number(day).alias("_month"))
    amounts = parse_json(kept, "monetary_components", {"_amount": (TAXABLE_AMOUNT_PATH, "double")})
    return amounts.withColumn("_amount", money("_amount"))


def _amount_of_type(amounts: DataFrame, tables: KpiTables, filters: KpiFilters, vertical: str | None) -> DataFrame:
    """Month number and the sum of the amounts of customers of the type, first summed per customer and month."""
    if filters.customer_type == ALL:
        return amounts.groupBy("_month").agg(F.sum("_amount").alias("_amount"))
    sums = amounts.groupBy("customer_identifier", "_month").agg(F.sum("_amount").alias("_amount"))
    first = _month_number("first_activation_date")
    of_type = first == F.col("_month") if filters.customer_type == NEW else first < F.col("_month")
    activated = first_activation(tables.items, tables.orders, vertical)
    return sums.join(activated, "customer_identifier").where(of_type).groupBy("_month").agg(F.sum("_amount").alias("_amount"))


def customer_events(
    tables: KpiTables,
    first_month: Month,
    last_month: Month,
    filters: KpiFilters = KpiFilters(),
    *,
    vertical: str | None,
    legacy_bound: bool = False,
) -> DataFrame:
    """Month number with the change of active customers from the month before, and the customers churned in it.

    An item is active from the month of its activation up to the month before its pickup, an interval that adds one to its
    customer at its first month and takes it away after its last. Summed per customer and month (a row for each month at
    most, however many items), a running sum tells where the customer is active at all, and those stretches are events again.
    Cost goes with the items and not with the months.
    """
    start, end = month_bounds(first_month)[0], month_bounds(last_month)[1]
    low, high = start.year * 12 + start.month - 1, end.year * 12 + end.month - 1  # the latter is the month after the last
    typed = filters.customer_type != ALL
    allowed = (
        _one_of("order_vertical", filters.verticals)
        & _in_bucket(filters.tenure_range, "tenure_in_months")
        & _on_plan(filters.plan_months, "tenure_in_months")
    )
    pickup = F.col("pickup_date")
    running = ~F.col("state").isin(list(KPI_EXCLUDED_STATES)) & (F.col("activation_date") < F.lit(end))
    running = running & (pickup.isNull() | (pickup >= F.lit(start)))
    churned = (F.col("state") == PICKED_UP_STATE) & (pickup >= F.lit(start)) & (pickup < F.lit(end))
    items = tables.items if typed else tables.items.where(running | churned)
    since = F.greatest(_month_number("activation_date"), F.lit(low))
    until = F.least(F.coalesce(_month_number(pickup), F.lit(high)), F.lit(high))
    is_active = running & allowed & (since < until)

    def event(when: Column, month: Column, change: int, churn: int, activated: Column | None = None) -> Column:
        day = F.lit(None).cast("date") if activated is None else activated
        fields = (F.when(when, month).alias("_month"), F.lit(change).alias("_change"), F.lit(churn).alias("_churned"))
        return F.struct(*fields, day.alias("_activated"))

    events = [
        event(is_active, since, 1, 0),
        event(is_active, until, -1, 0),
        event(churned & allowed, _month_number(pickup), 0, 1),
    ]
    if typed:  # what activates a customer need not pass the filters
        events.append(event(F.col("activation_date") < F.lit(end), since, 0, 0, F.col("activation_date")))
    per_month = (
        customer_items(items, tables.orders, vertical)
        .where(F.col("customer_identifier").isNotNull())
        .select("customer_identifier", F.inline(F.array(*events)))
        .where(F.col("_month").isNotNull())
        .groupBy("customer_identifier", "_month")
        .agg(F.sum("_change").alias("_change"), F.max("_churned").alias("_churned"), F.min("_activated").alias("_activated"))
    )
    of_customer = Window.partitionBy("customer_identifier")
    in_order = of_customer.orderBy("_month")
    found = per_month.select(
        "customer_identifier",
        "_month",
        "_churned",
        (F.sum("_change").over(in_order) > 0).alias("_active"),
        F.lead("_month", 1, high).over(in_order).alias("_next"),
        F.min("_activated").over(of_customer).alias("_activated"),
    )
    found = filter_city_customers(found, tables.invoiceable_groups, filters.city_ids)
    first, month = _month_number("_activated"), F.col("_month")
    begin, stop, of_type = month, F.col("_next"), F.lit(True)
    if filters.customer_type == NEW:
        on_last_day = F.col("_activated") == F.last_day("_activated")
        begin, stop, of_type = F.greatest(month, first), F.least(stop, first + 1), first == month
        stop = F.when(on_last_day, begin).otherwise(stop) if legacy_bound else stop
    elif filters.customer_type == RETURNING:
        begin, of_type = F.greatest(month, first + 1), first < month
    stretch = F.col("_active") & F.col("_activated").isNotNull() if typed else F.col("_active")
    stretch = stretch & (begin < stop)
    changes = F.array(
        F.struct(F.when(stretch, begin).alias("_month"), F.lit(1).alias("_change"), F.lit(0).alias("_churned")),
        F.struct(F.when(stretch, stop).alias("_month"), F.lit(-1).alias("_change"), F.lit(0).alias("_churned")),
        F.struct(F.when(of_type & (F.col("_churned") == 1), month).alias("_month"), F.lit(0).alias("_change"), F.lit(1).alias("_churned")),
    )
    summed = found.select(F.inline(changes)).where((F.col("_month") >= low) & (F.col("_month") < high))
    return summed.groupBy("_month").agg(F.sum("_change").alias("_change"), F.sum("_churned").alias("_churned"))


def kpi_series(
    tables: KpiTables,
    first_month: Month,
    last_month: Month,
    filters: KpiFilters = KpiFilters(),
    *,
    vertical: str | None,
    legacy_bound: bool = False,
) -> DataFrame:
    """The four KPIs of every month from the first to the last, a row each; as in the functions for one month.

    The plan is the same for one month and for a hundred. Only the rows of the months, one each, come together in one task.
    """
    start, end = month_bounds(first_month)[0], month_bounds(last_month)[1]
    if start >= end:
        raise ValueError("the last month is before the first")
    low, high = start.year * 12 + start.month - 1, end.year * 12 + end.month - 1
    parts = [tables.items.sparkSession.range(low, high, 1, 1).select(F.col("id").cast("int").alias("_month"))]
    for name, facts, date_column, states in (
        ("_mrr", tables.revenue_recognitions, "to_be_recognised_on", RECOGNISED_STATES),
        ("_billed", tables.invoice_cycles, "created_at", BILLED_STATES),
    ):
        amounts = _monthly_amounts(facts, date_column, states, (start, end), filters)
        parts.append(_amount_of_type(amounts, tables, filters, vertical).withColumnRenamed("_amount", name))
    parts.append(customer_events(tables, first_month, last_month, filters, vertical=vertical, legacy_bound=legacy_bound))
    stacked = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    months = stacked.groupBy("_month").agg(*[F.sum(c).alias(c) for c in ("_mrr", "_change", "_churned", "_billed")])
    so_far = Window.orderBy("_month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return months.select(
        F.make_date(F.floor(F.col("_month") / 12).cast("int"), F.col("_month") % 12 + 1, F.lit(1)).alias("month"),
        _total(F.col("_mrr")).alias("mrr"),
        F.coalesce(F.sum("_change").over(so_far), F.lit(0)).alias("active_subscriptions"),
        F.coalesce("_churned", F.lit(0)).alias("churned_customers"),
        _total(F.col("_billed")).alias("revenue_billed"),
    )


def month_over_month(values: DataFrame) -> DataFrame:
    """Difference, relative change, direction and whether it is good, for rows ``metric, m0, m1``."""
    m1, m2 = F.coalesce("m0", F.lit(0.0)), F.coalesce("m1", F.lit(0.0))
    diff = m2 - m1
    direction = F.when(diff > 0, "up").when(diff < 0, "down").otherwise("flat")
    lower_is_better = F.col("metric").isin(list(LOWER_IS_BETTER))
    return values.select(
        "metric",
        m1.alias("m1"),
        m2.alias("m2"),
        diff.alias("abs_diff"),
        (F.try_divide(diff, m1) * 100).alias("pct_change"),
        direction.alias("direction"),
        F.when(diff == 0, "flat")
        .when((diff > 0) != lower_is_better, "good")
        .otherwise("bad")
        .alias("trend"),
    )


def kpi_month_compare(
    tables: KpiTables,
    month_1: Month,
    month_2: Month,
    filters: KpiFilters = KpiFilters(),
    *,
    vertical: str | None,
    legacy_bound: bool = False,
) -> DataFrame:
    """The four KPIs of two months beside each other."""
    return month_over_month(
        kpi_by_month(tables, [month_1, month_2], filters, vertical=vertical, legacy_bound=legacy_bound)
    )
