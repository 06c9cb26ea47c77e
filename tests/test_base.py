from __future__ import annotations

import datetime as dt
import json
import random

import pytest

from billcycle import schemas
from billcycle.operators import base
from billcycle.plans import reports
from tests.samples import ITEM_ID, as_tuples, day, history_events, history_log, log, snapshot, transition

AS_OF = "2024-03-10"
MONTH, NEXT = dt.datetime(2024, 3, 1), dt.datetime(2024, 4, 1)
SHIFT = dt.timedelta(minutes=330)


def item(id_, state="ACTIVE", pickup=None, end="2024-03-20", ro=(None, None), vertical="RENTAL", start="2024-02-20"):
    payment = json.dumps({"payableAfterPaymentOffers": {"byCashPreTax": id_ + 0.5}})
    price = json.dumps({"basePrice": "99"})
    return (
        id_, f"item {id_}", state, vertical, day("2023-01-01"), pickup, day(start), day(end), 1, id_,
        day(ro[0]), day(ro[1]), payment, price, id_,
    )


def holdings(spark, items, links, orders):
    return (
        spark.createDataFrame(items, schemas.ITEMS),
        spark.createDataFrame(links, schemas.RENT_TO_PURCHASE_ITEMS),
        spark.createDataFrame(orders, schemas.RENT_TO_PURCHASE_ORDERS),
    )


def brute_base(items, links, orders, keep_rule):
    """Outer joins, filter per link row, latest link: the definition read literally."""
    live = {i: at for i, state, at in orders if state != "CANCELLED"}
    kept = {}
    for it in items:
        if it[3] != "RENTAL" or it[2] not in schemas.BILLABLE_STATES:
            continue
        for link_id, order_id in [(l, o) for l, i, o in links if i == it[0]] or [(None, None)]:
            bought = live.get(order_id)
            pickup = dt.datetime.combine(it[5], dt.time()) if it[5] else bought and bought + SHIFT
            end = it[11] or it[7]
            if keep_rule == "next_month":
                ok = pickup is None or pickup >= NEXT
            else:
                ok = pickup is None or (end is not None and end >= MONTH.date())
            if ok:
                rank = -1 if link_id is None else link_id
                if it[0] not in kept or kept[it[0]][0] < rank:
                    kept[it[0]] = (rank, pickup)
    return sorted((i, pickup) for i, (_, pickup) in kept.items())


def random_holdings(seed, hot_share=1 / 3):
    rnd = random.Random(seed)
    states = ["ACTIVE", "RENEWAL_OVERDUE", "PICKED_UP", "CANCELLED", "PURCHASED"]
    items = []
    for i in range(1, 61):
        pickup = dt.date(2024, rnd.randrange(2, 6), 1) if rnd.random() < 0.3 else None
        end = rnd.choice(["2024-02-28", "2024-03-01", "2024-05-01", None])
        items.append(item(i, rnd.choice(states), pickup, end, vertical="RENTAL" if rnd.random() < 0.9 else "OTHER"))
    orders = [
        (o, rnd.choice(["CANCELLED", "SUCCESS"]), dt.datetime(2024, rnd.randrange(2, 6), 1) - SHIFT * rnd.randrange(2))
        for o in range(80)
    ]
    links = [
        (l, 7 if rnd.random() < hot_share else rnd.randrange(1, 50), rnd.randrange(90)) for l in range(150)
    ]
    return items, links, orders


@pytest.mark.parametrize("keep_rule", ["next_month", "cycle_end"])
def test_current_base_against_brute_force(spark, keep_rule):
    for seed in (1, 2):
        rows = random_holdings(seed)
        found = base.current_base(*holdings(spark, *rows), as_of=AS_OF, keep_rule=keep_rule, vertical="RENTAL")
        assert sorted(as_tuples(found, "id", "pickup_date"), key=lambda r: r[0]) == brute_base(*rows, keep_rule)


def test_latest_link_hides_an_older_live_one_unless_preferred(spark):
    rows = (
        [item(1)],
        [(10, 1, 100), (11, 1, 101)],
        [(100, "SUCCESS", dt.datetime(2024, 5, 1)), (101, "CANCELLED", dt.datetime(2024, 5, 2))],
    )
    tables = holdings(spark, *rows)
    assert as_tuples(base.current_base(*tables, as_of=AS_OF, vertical="RENTAL"), "pickup_date") == [(None,)]
    preferred = base.current_base(*tables, as_of=AS_OF, prefer_live=True, vertical="RENTAL")
    assert as_tuples(preferred, "pickup_date") == [(dt.datetime(2024, 5, 1) + SHIFT,)]


def test_amount_and_effective_cycle(spark):
    items = [item(1), item(2, "RENEWAL_OVERDUE", ro=("2024-03-21", "2024-04-20"))]
    found = base.current_base(*holdings(spark, items, [(1, 9, 9)], [(9, "SUCCESS", MONTH)]), as_of=AS_OF, vertical="RENTAL")
    assert sorted(
        as_tuples(found, "id", "pre_tax_amount", "current_effective_start", "current_effective_end", "entity_type")
    ) == [
        (1, 1.5, day("2024-02-20"), day("2024-03-20"), "ITEM"),
        (2, 99.0, day("2024-03-21"), day("2024-04-20"), "ITEM"),
    ]


def test_billable_next_month_keeps_every_link(spark):
    items, links, orders = random_holdings(4)
    found = base.billable_next_month(*holdings(spark, items, links, orders), as_of=AS_OF, vertical="RENTAL")
    created = {i: at for i, _, at in orders}
    wanted = []
    for it in items:
        if it[3] == "RENTAL" and it[2] in schemas.BILLABLE_STATES:
            for order in [o for _, i, o in links if i == it[0]] or [None]:
                bought = created.get(order)
                pickup = dt.datetime.combine(it[5], dt.time()) if it[5] else bought and bought + SHIFT
                if pickup is None or pickup >= NEXT:
                    wanted.append((it[0], str(pickup)))
    assert sorted((r.id, str(r.pickup_date)) for r in found.collect()) == sorted(wanted)
    assert {(str(r.as_of_date), str(r.next_month_start_date)) for r in found.collect()} == {(AS_OF, "2024-04-01")}


def current(spark, rows):
    return spark.createDataFrame(
        rows, "entity_type string, id long, current_effective_start date"
    )


def test_previous_cycle_of_the_sample(spark):
    transitions = base.billing_transitions(history_log(spark), history_events(spark), vertical="RENTAL")
    found = base.previous_cycle(transitions, current(spark, [("ITEM", ITEM_ID, day("2026-04-12"))]))
    assert as_tuples(
        found, "effective_tenure_start", "effective_tenure_end", "event_name", "pre_tax_amount", "state_transition_id"
    ) == [(day("2026-01-12"), day("2026-04-11"), "RENEWAL_APPLIED", 1152.9, 89044299)]


def test_previous_cycle_order_and_shared_ids(spark):
    def rows_of(kind, first_id, names):
        rows, events = [], []
        for n, (name, start, end, at) in enumerate(names):
            rows.append(transition(first_id + n, 1, snapshot(start, end), kind=kind, at=at))
            events.append((first_id + n, name))
        return rows, events

    jan, feb = ("2024-01-01", "2024-01-31"), ("2024-02-01", "2024-02-29")
    rows, events = rows_of("ITEM", 10, [
        ("RENEWAL_OVERDUE", *feb, "2024-03-09 00:00:00"),
        ("ORDER_SHIPMENT_DELIVERED", *feb, "2024-03-03 00:00:00"),
        ("RENEWAL_APPLIED", *feb, "2024-03-01 00:00:00"),
        ("RENEWAL_APPLIED", *feb, "2024-03-02 00:00:00"),
        ("RENEWAL_APPLIED", *feb, "2024-03-02 00:00:00"),
        ("RENEWAL_APPLIED", "2024-03-01", "2024-03-31", "2024-03-05 00:00:00"),
        ("RENEWAL_APPLIED", *jan, "2024-03-08 00:00:00"),
    ])
    more, more_events = rows_of("ATTACHMENT", 30, [
        ("OUTSTANDING_PAYMENT_RECEIVED", *jan, "2024-01-01 00:00:00"),
        ("ORDER_FULFILLMENT_FULFILLED", *jan, "2024-01-02 00:00:00"),
        ("ORDER_SHIPMENT_DELIVERED", *jan, "2024-01-01 00:00:00"),
    ])
    transitions = base.billing_transitions(
        log(spark, rows + more), spark.createDataFrame(events + more_events, schemas.EVENTS), vertical="RENTAL")
    now = current(spark, [("ITEM", 1, day("2024-03-31")), ("ATTACHMENT", 1, day("2024-03-01")), ("ITEM", 2, day("2024-03-01"))])
    found = base.previous_cycle(transitions, now)
    # the cycle ending on the current start is not before it; equal times go to the higher id;
    # both delivery events rank the same, so the newer one wins
    assert sorted(as_tuples(found, "entity_type", "entity_id", "state_transition_id")) == [
        ("ATTACHMENT", 1, 31), ("ITEM", 1, 14),
    ]


def test_fused_report_equals_the_composed_one(spark):
    items, links, orders = random_holdings(9)
    tables = holdings(spark, items, links, orders)
    rnd = random.Random(1)
    rows, events = [], []
    for i in range(300):
        kind = rnd.choice(["ITEM", "ITEM", "ATTACHMENT"])
        entity = 7 if rnd.random() < 1 / 3 else rnd.randrange(1, 60)
        month = rnd.randrange(1, 4)
        rows.append(transition(i, entity, snapshot(f"2024-0{month}-01", f"2024-0{month}-28", month), kind=kind))
        events.append((i, rnd.choice(schemas.HISTORY_EVENTS)))
    events_table = spark.createDataFrame(events, schemas.EVENTS)
    attachments = tables[0].drop("order_id").withColumnRenamed("current_pricing_details", "pricing_details")
    attachment_links = tables[1].withColumnRenamed("item_id", "attachment_id")
    billed = base.all_base(
        base.current_base(*tables, as_of=AS_OF, vertical="RENTAL"),
        base.attachment_base(attachments, attachment_links, tables[2], as_of=AS_OF, vertical="RENTAL"),
    )
    chosen = base.state_transitions_for_base(log(spark, rows), events_table, billed, vertical="RENTAL")
    composed = base.current_vs_previous(billed, base.previous_cycle(chosen, billed), ordered=True)
    fused = reports.current_against_previous(
        reports.LogTables(log(spark, rows), events_table),
        reports.HoldingTables(*tables, attachments, attachment_links),
        AS_OF,
        ordered=True, vertical="RENTAL")
    assert fused.columns == composed.columns
    mine, theirs = [tuple(r) for r in fused.collect()], [tuple(r) for r in composed.collect()]
    assert mine == theirs
    assert any(r[-1] is not None for r in mine) and any(r[-1] is None for r in mine)
    for r in mine:
        assert r[12] is None or r[12] < r[7]  # the previous cycle ended before the current one began


def test_previous_cycle_of_ties_and_missing_dates(spark):
    """Equal priorities and times go to the higher id; a holding without a start, or without an id, has no cycle before."""
    jan = ("2024-01-01", "2024-01-31")
    rows = [transition(n, 1 if n < 40 else None, snapshot(*jan), at="2024-02-01 00:00:00") for n in range(10, 50)]
    events = spark.createDataFrame([(n, "RENEWAL_APPLIED") for n in range(10, 50)], schemas.EVENTS)
    transitions = base.billing_transitions(log(spark, rows), events, vertical="RENTAL")
    now = current(spark, [("ITEM", 1, day("2024-02-01")), ("ITEM", None, day("2024-02-01")), ("ATTACHMENT", 1, day("2024-02-01"))])
    assert as_tuples(base.previous_cycle(transitions, now), "entity_id", "state_transition_id") == [(1, 39)]
    assert base.previous_cycle(transitions, current(spark, [("ITEM", 1, None)])).count() == 0
    assert base.previous_cycle(transitions, now.limit(0)).count() == 0 and base.previous_cycle(transitions.limit(0), now).count() == 0
