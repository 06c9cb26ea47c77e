from __future__ import annotations

import dataclasses
import datetime as dt
import json
import random

import pytest

from billcycle import schemas
from billcycle.operators import kpi
from tests.samples import as_tuples, day

FEB, MAR = "2024-02", "2024-03"


def item(id_, order, state="ACTIVE", activation="2023-05-01", pickup=None, months=3, vertical="RENTAL"):
    row = [None] * 15
    row[0], row[2], row[3], row[4], row[5], row[8], row[14] = (
        id_, state, vertical, day(activation), day(pickup), months, order,
    )
    return tuple(row)


def order(id_, customer, vertical="RENTAL"):
    return (id_, json.dumps({"displayId": customer}), vertical)


def fact(customer, when, amount, state, city=6, vertical="RENTAL", deleted=None):
    text = json.dumps({"taxableAmount": amount}) if amount != "none" else "{}"
    return (customer, city, vertical, state, deleted, when, text)


ITEMS = [
    item(1, 1), item(2, 1),  # two items, one customer
    item(3, 2, "PICKED_UP", "2023-01-01", "2024-02-29"),
    item(4, 3, activation="2024-02-29"),  # the last day of the month counts
    item(5, 4, activation="2024-03-01"),
    item(6, 5, "CANCELLED"),
    item(7, 6, "PICKED_UP", "2023-01-01", "2024-03-01"),
    item(8, 7, vertical="FURNITURE"),
    item(9, 8, activation=None),
    item(10, 9, months=12, activation="2024-02-01"),
    item(11, 99),  # its order is missing
]
ORDERS = [order(i, f"C{i}", "RENTAL" if i != 3 else "APPLIANCES") for i in range(1, 10)] + [(50, "{broken", "RENTAL")]
STAMP = dt.datetime(2024, 1, 1)
RECOGNITIONS = [
    fact("C1", day("2024-02-01"), 10.0, "PROCESSED"),
    fact("C1", day("2024-02-29"), "5.5", "FUTURE"),
    fact("C3", day("2024-02-10"), 7.0, "PROCESSED", city=1),
    fact("C3", day("2024-02-10"), 1000.0, "CANCELLED"),
    fact("C1", day("2024-02-10"), 1000.0, "PROCESSED", deleted=STAMP),
    fact("C9", day("2024-02-10"), "none", "PROCESSED"),
    fact("C9", day("2024-02-10"), "", "PROCESSED"),
    fact("stranger", day("2024-02-10"), 3.0, "PROCESSED"),
    fact("C1", day("2024-03-01"), 20.0, "PROCESSED", vertical="FURNITURE"),
]
INVOICES = [
    fact("C1", dt.datetime(2024, 2, 29, 23, 59), 8.0, "INVOICED"),
    fact("C4", dt.datetime(2024, 3, 1), 9.0, "READY_TO_BE_INVOICED"),
    fact("C4", dt.datetime(2024, 3, 1), 9.0, "DRAFT"),
]
GROUPS = [(f"C{i}", 6 if i % 2 else 1) for i in range(1, 10)] + [("C1", 6), ("C1", 2)]


@pytest.fixture(scope="module")
def tables(spark):
    return kpi.KpiTables(
        spark.createDataFrame(ITEMS, schemas.ITEMS),
        spark.createDataFrame(ORDERS, schemas.ORDERS),
        spark.createDataFrame(RECOGNITIONS, schemas.REVENUE_RECOGNITIONS),
        spark.createDataFrame(INVOICES, schemas.INVOICE_CYCLES),
        spark.createDataFrame(GROUPS, schemas.INVOICEABLE_GROUPS),
    )


def value(df):
    return df.first()[0]


def test_revenue(tables):
    assert value(kpi.kpi_mrr(tables, FEB, vertical="RENTAL")) == 25.5
    assert value(kpi.kpi_mrr(tables, FEB, kpi.KpiFilters(city_ids=[1]), vertical="RENTAL")) == 7.0
    assert value(kpi.kpi_mrr(tables, MAR, kpi.KpiFilters(verticals=["RENTAL"]), vertical="RENTAL")) == 0.0
    assert value(kpi.kpi_revenue_billed(tables, FEB, vertical="RENTAL")) == 8.0
    assert value(kpi.kpi_revenue_billed(tables, MAR, vertical="RENTAL")) == 9.0
    assert value(kpi.kpi_mrr(tables, "2020-01", vertical="RENTAL")) == 0.0


def test_customer_type_of_revenue(tables):
    # C3 and C9 are new in February; customers without any activation drop out
    assert value(kpi.kpi_mrr(tables, FEB, kpi.KpiFilters(customer_type="New"), vertical="RENTAL")) == 7.0
    assert value(kpi.kpi_mrr(tables, FEB, kpi.KpiFilters(customer_type="Returning"), vertical="RENTAL")) == 15.5
    # tenure and plan do not touch revenue
    assert value(kpi.kpi_mrr(tables, FEB, kpi.KpiFilters(plan_months=12, tenure_range=(12, None)), vertical="RENTAL")) == 25.5


def test_active_customers(tables):
    assert value(kpi.kpi_active_subscriptions(tables, FEB, vertical="RENTAL")) == 4  # C1, C3, C6 (picked up later), C9
    assert value(kpi.kpi_active_subscriptions(tables, FEB, kpi.KpiFilters(city_ids=[1]), vertical="RENTAL")) == 1  # C6
    assert value(kpi.kpi_active_subscriptions(tables, FEB, kpi.KpiFilters(verticals=["APPLIANCES"]), vertical="RENTAL")) == 1
    assert value(kpi.kpi_active_subscriptions(tables, FEB, kpi.KpiFilters(tenure_range=(6, None)), vertical="RENTAL")) == 1
    assert value(kpi.kpi_active_subscriptions(tables, FEB, kpi.KpiFilters(plan_months=3), vertical="RENTAL")) == 3
    new = kpi.KpiFilters(customer_type="New")
    assert value(kpi.kpi_active_subscriptions(tables, FEB, new, vertical="RENTAL")) == 2
    assert value(kpi.kpi_active_subscriptions(tables, FEB, new, legacy_bound=True, vertical="RENTAL")) == 1  # C3 starts on the last day


def test_churn(tables):
    assert value(kpi.kpi_churned_customers(tables, FEB, vertical="RENTAL")) == 1
    assert value(kpi.kpi_churned_customers(tables, MAR, vertical="RENTAL")) == 1
    assert value(kpi.kpi_churned_customers(tables, FEB, kpi.KpiFilters(customer_type="New"), vertical="RENTAL")) == 0


@pytest.mark.parametrize(
    "filters",
    [
        kpi.KpiFilters(),
        kpi.KpiFilters(city_ids=[6]),
        kpi.KpiFilters(customer_type="New"),
        kpi.KpiFilters(city_ids=[1, 6], customer_type="Returning", verticals=["RENTAL"], tenure_range=(0, 12)),
    ],
)
def test_months_together_equal_months_alone(tables, filters):
    months = [FEB, MAR, "2023-05"]
    together = {r.metric: (r.m0, r.m1, r.m2) for r in kpi.kpi_by_month(tables, months, filters, vertical="RENTAL").collect()}
    alone = {
        "mrr": kpi.kpi_mrr,
        "active_subscriptions": kpi.kpi_active_subscriptions,
        "churned_customers": kpi.kpi_churned_customers,
        "revenue_billed": kpi.kpi_revenue_billed,
    }
    for metric, one in alone.items():
        assert together[metric] == tuple(float(value(one(tables, m, filters, vertical="RENTAL"))) for m in months), metric


@pytest.mark.parametrize("legacy", [False, True])
@pytest.mark.parametrize(
    "filters",
    [
        kpi.KpiFilters(),
        kpi.KpiFilters(city_ids=[6]),
        kpi.KpiFilters(customer_type="New"),
        kpi.KpiFilters(city_ids=[1, 6], customer_type="Returning", verticals=["RENTAL"], tenure_range=(0, 12)),
    ],
)
def test_a_series_equals_single_months(tables, filters, legacy):
    options = {"vertical": "RENTAL", "legacy_bound": legacy}
    rows = {str(r.month)[:7]: r for r in kpi.kpi_series(tables, "2023-12", "2024-04", filters, **options).collect()}
    assert sorted(rows) == ["2023-12", "2024-01", FEB, MAR, "2024-04"]
    for month, row in rows.items():
        assert row.mrr == value(kpi.kpi_mrr(tables, month, filters, vertical="RENTAL"))
        assert row.revenue_billed == value(kpi.kpi_revenue_billed(tables, month, filters, vertical="RENTAL"))
        assert row.active_subscriptions == value(kpi.kpi_active_subscriptions(tables, month, filters, **options)), month
        assert row.churned_customers == value(kpi.kpi_churned_customers(tables, month, filters, **options)), month


def brute_series(items, orders, filters, months):
    """Customers active and churned in each month, item by item."""
    customer_of = {o[0]: json.loads(o[1])["displayId"] for o in orders}
    first = {}
    for i in items:
        if i[14] in customer_of and i[4]:
            c = customer_of[i[14]]
            first[c] = min(first.get(c, i[4]), i[4])
    found = []
    for start, end, last in map(kpi.month_bounds, months):
        active, churned = set(), set()
        for i in items:
            c = customer_of.get(i[14])
            if c is None or (filters.plan_months and i[8] != filters.plan_months):
                continue
            since = first.get(c)
            if filters.customer_type == "New" and not (since and start <= since < end):
                continue
            if filters.customer_type == "Returning" and not (since and since < start):
                continue
            if i[2] != "CANCELLED" and i[4] and i[4] <= last and (i[5] is None or i[5] > last):
                active.add(c)
            if i[2] == "PICKED_UP" and i[5] and start <= i[5] < end:
                churned.add(c)
        found.append((start, len(active), len(churned)))
    return found


@pytest.mark.parametrize("kind", ["All", "New", "Returning"])
def test_a_series_of_random_items(spark, tables, kind):
    """A third of the items under one customer; intervals that overlap, touch, are empty, open, or end before they begin."""
    pick = random.Random(kind)
    days = [str(dt.date(2021, 1, 1) + dt.timedelta(days=pick.choice((0, 30, 31, 58, 59, 89))) * pick.randint(0, 12)) for _ in range(40)]
    orders = [order(i, f"C{0 if i % 3 == 0 else i % 17}") for i in range(1, 91)]
    items = [
        item(i, pick.randint(1, 92), pick.choice(["ACTIVE", "PICKED_UP", "CANCELLED"]), pick.choice([*days, None]),
             pick.choice([*days, None, None]), pick.choice([3, 12]))
        for i in range(200)
    ]
    random_tables = kpi.KpiTables(
        spark.createDataFrame(items, schemas.ITEMS), spark.createDataFrame(orders, schemas.ORDERS),
        tables.revenue_recognitions, tables.invoice_cycles, tables.invoiceable_groups,
    )
    months = [f"{2020 + i // 12}-{i % 12 + 1:02d}" for i in range(6, 6 + 48)]
    for filters in (kpi.KpiFilters(customer_type=kind), kpi.KpiFilters(customer_type=kind, plan_months=12)):
        found = kpi.kpi_series(random_tables, months[0], months[-1], filters, vertical="RENTAL")
        rows = sorted(as_tuples(found, "month", "active_subscriptions", "churned_customers"))
        assert rows == brute_series(items, orders, filters, months)


def test_a_series_of_empty_tables_and_its_plan(spark, tables):
    empty = kpi.KpiTables(*[getattr(tables, f.name).limit(0) for f in dataclasses.fields(kpi.KpiTables)])
    rows = kpi.kpi_series(empty, "2024-01", "2024-02", vertical="RENTAL").collect()
    assert sorted(map(tuple, rows)) == [(day("2024-01-01"), 0.0, 0, 0, 0.0), (day("2024-02-01"), 0.0, 0, 0, 0.0)]
    with pytest.raises(ValueError):
        kpi.kpi_series(tables, "2024-02", "2024-01", vertical="RENTAL")

    def size(last):
        return len(kpi.kpi_series(tables, "2015-01", last, vertical="RENTAL")._jdf.queryExecution().optimizedPlan().toString().splitlines())

    assert size("2015-01") == size("2024-12")  # 120 months are one plan like that of one month


def test_month_compare(tables):
    rows = {r.metric: r for r in kpi.kpi_month_compare(tables, FEB, MAR, vertical="RENTAL").collect()}
    assert list(sorted(rows)) == sorted(kpi.METRICS)
    mrr = rows["mrr"]
    assert (mrr.m1, mrr.m2, mrr.abs_diff, mrr.direction, mrr.trend) == (25.5, 20.0, -5.5, "down", "bad")
    assert mrr.pct_change == (20.0 - 25.5) / 25.5 * 100
    churn = rows["churned_customers"]
    assert (churn.direction, churn.trend, churn.pct_change) == ("flat", "flat", 0.0)


def test_churn_is_better_when_lower(spark):
    values = spark.createDataFrame(
        [("churned_customers", 2.0, 3.0), ("mrr", 0.0, 3.0), ("revenue_billed", None, None)], "metric string, m0 double, m1 double"
    )
    rows = {r.metric: (r.direction, r.trend, r.pct_change) for r in kpi.month_over_month(values).collect()}
    assert rows == {
        "churned_customers": ("up", "bad", 50.0), "mrr": ("up", "good", None), "revenue_billed": ("flat", "flat", None),
    }


def test_filters(tables):
    rows = kpi.customer_items(tables.items, tables.orders, vertical="RENTAL")
    assert kpi.filter_tenure_bucket(rows, None).count() == rows.count()
    assert as_tuples(kpi.filter_tenure_bucket(rows, schemas.TENURE_BUCKETS["12+ months"]), "customer_identifier") == [("C9",)]
    assert kpi.filter_tenure_bucket(rows, (None, 3)).count() == 0
    assert kpi.filter_plan(rows, None).count() == rows.count()
    assert kpi.filter_city_customers(rows, tables.invoiceable_groups, [2]).count() == 2  # both items of C1, once
    assert kpi.filter_city_customers(rows, tables.invoiceable_groups, []).count() == rows.count()
    activations = kpi.first_activation(tables.items, tables.orders, vertical="RENTAL")
    assert kpi.filter_new_returning(rows, activations, "All", FEB).count() == rows.count()
    new = kpi.filter_new_returning(rows, activations, "New", FEB)
    assert sorted(as_tuples(new, "customer_identifier")) == [("C3",), ("C9",)]
    with pytest.raises(ValueError):
        kpi.KpiFilters(customer_type="Unknown")
