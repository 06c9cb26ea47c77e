from __future__ import annotations

import datetime as dt

from billcycle import schemas
from billcycle.operators import rca
from billcycle.plans import reports
from tests.samples import day

FIRST, SECOND = "2026-02", "2026-03"


def cycle(entity, end, amount=100.0, activation="2025-01-01", num=1):
    return (entity, num, day("2026-01-01"), day(end), day(activation), None, 1, amount, "TENURE", num, num, 30, amount)


A = [
    cycle(1, "2026-02-10"), cycle(2, "2026-02-10"), cycle(3, "2026-02-10"), cycle(4, "2026-02-10"),
    cycle(5, "2026-03-10"), cycle(6, "2026-03-10"), cycle(7, None),
    cycle(8, "2026-02-10"),
    cycle(20, "2026-04-01"), cycle(21, "2026-04-01"), cycle(22, "2026-04-01"), cycle(22, "2026-04-02", num=2),
    cycle(23, "2026-04-01"), cycle(24, "2026-04-01", amount=None),
]
B = [
    cycle(10, "2026-04-01", activation="2026-03-01"), cycle(11, "2026-04-01", activation="2026-02-28"),
    cycle(12, "2026-04-01", activation="2026-01-31"), cycle(13, "2026-04-01", activation=None),
    cycle(20, "2026-04-01", amount=100.001), cycle(21, "2026-04-01"), cycle(21, "2026-04-02", num=2),
    cycle(22, "2026-04-01"), cycle(23, "2026-04-01", amount=120.0), cycle(24, "2026-04-01", amount=0.0),
]
ITEMS = [
    (1, "PICKED_UP", "2026-02-28"), (2, "PICKED_UP", None), (3, "PURCHASED", None), (5, "CANCELLED", None),
    (4, "PICKED_UP", None), (6, "ACTIVE", None), (7, "ACTIVE", None), (20, "ACTIVE", None), (8, "ACTIVE", None),
]
# the order of item 2 is bought at midnight local time of the first of March
ORDERS = [
    (100, "SUCCESS", dt.datetime(2026, 2, 28, 18, 30)),
    (101, "SUCCESS", dt.datetime(2026, 1, 5)),
    (102, "CANCELLED", dt.datetime(2026, 1, 5)),
    (103, "SUCCESS", dt.datetime(2026, 1, 6)),
]
LINKS = [(1, 2, 100), (2, 3, 101), (3, 3, 102), (4, 8, 102), (5, 3, 103), (6, 20, 101), (7, 20, 102)]
REASONS = {
    1: "1A. Picked Up Before March",
    2: "1B. Picked Up In/After March",
    3: "1C. RTP Converted",
    4: "1D. All Cycles Ended Before March",
    5: "1E. Cancelled",
    6: "1F. ⚠ Should Be in March (Needs Investigation)",
    7: "1G. Other (Feb Only)",
    8: "1D. All Cycles Ended Before March",
    10: "2A. New Activation in March",
    11: "2B. Activated in Feb (Missing from Feb Snapshot)",
    12: "2C. Old Item Re-appeared in March",
    13: "2D. Other (March Only)",
    20: "3A. No Material Change",
    21: "3D. More Cycles in March (Renewed/Extended)",
    22: "3E. Fewer Cycles in March",
    23: "3F. Amount Changed (Same Cycle Count)",
    24: "3A. No Material Change",
}


def tables(spark):
    blank = [None] * 15
    items = []
    for id_, state, pickup in ITEMS:
        row = list(blank)
        row[0], row[2], row[5] = id_, state, day(pickup)
        items.append(tuple(row))
    return reports.HoldingTables(
        spark.createDataFrame(items, schemas.ITEMS),
        spark.createDataFrame(LINKS, schemas.RENT_TO_PURCHASE_ITEMS),
        spark.createDataFrame(ORDERS, schemas.RENT_TO_PURCHASE_ORDERS),
    )


def sides(spark):
    return spark.createDataFrame(A, schemas.MONTH_SNAPSHOT), spark.createDataFrame(B, schemas.MONTH_SNAPSHOT)


def reasons(spark, **options):
    t = tables(spark)
    return rca.rca_reason(
        rca.rca_presence(*sides(spark)), t.items, t.item_links, t.purchase_orders, second_month=SECOND, **options
    )


def test_every_class(spark):
    rows = reasons(spark).collect()
    assert {r.entity_id: r.rca_reason for r in rows} == REASONS
    assert len(rows) == len(REASONS)
    bought = {r.entity_id: (r.rto_order_id, r.actual_pickup_dt) for r in rows}
    assert bought[3] == (103, dt.datetime(2026, 1, 6, 5, 30))  # the latest live link
    assert bought[2] == (100, dt.datetime(2026, 3, 1))
    assert bought[8] == (None, None)


def test_presence_equals_full_outer_join(spark):
    a, b = sides(spark)
    f, m = rca.rca_side_aggregate(a, "feb"), rca.rca_side_aggregate(b, "mar")
    joined = f.withColumnRenamed("activation_date", "x").join(
        m.withColumnRenamed("activation_date", "y"), "entity_id", "full_outer"
    )
    columns = ["entity_id", "feb_cycles", "feb_amount", "feb_max_end", "mar_cycles", "mar_amount", "mar_max_end"]
    found = rca.rca_presence(a, b).select(*columns).orderBy("entity_id").collect()
    assert found == joined.select(*columns).orderBy("entity_id").collect()


def test_every_link_counts_like_a_plain_join(spark):
    rows = reasons(spark, every_link=True).collect()
    weights = {}
    for r in rows:
        weights[r.entity_id] = weights.get(r.entity_id, 0) + r.link_rows
    assert weights[3] == 3 and weights[20] == 2 and weights[1] == 1
    # the cancelled link of item 3 is classified by the cycle end, the live ones as purchases
    assert sorted((r.rca_reason[:2], r.link_rows) for r in rows if r.entity_id == 3) == [("1C", 2), ("1D", 1)]


def test_summary_totals(spark):
    summary = rca.rca_summary(reasons(spark)).collect()
    assert [r.rca_reason for r in summary] == sorted(set(REASONS.values()))
    assert sum(r.item_count for r in summary) == len(REASONS)
    no_change = next(r for r in summary if r.rca_reason.startswith("3A"))
    assert (no_change.feb_total_amount, no_change.mar_total_amount) == (100.0, 100.0)
    ended = next(r for r in summary if r.rca_reason.startswith("1D"))
    assert (ended.feb_total_cycles, ended.mar_total_cycles, ended.delta_amount) == (2, None, -200.0)
    report = reports.rca_report(*sides(spark), tables(spark), FIRST).collect()
    assert report == summary
