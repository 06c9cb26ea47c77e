from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

from billcycle import schemas
from billcycle.operators import cycles
from tests.samples import (
    GOLDEN_CYCLES, HISTORY, ITEM_ID, as_tuples, day, history_events, history_log, log, snapshot, transition,
)

SHOWN = ("cycle_num", "period_start", "period_end", "months", "cycle_amount", "period_type", "state_transition_id", "days")


def expected(rows):
    return [(n, day(s), day(e), *rest) for n, s, e, *rest in rows]


def timeline_of(spark, rows):
    return cycles.billing_timeline(cycles.snapshot_extract(log(spark, rows), vertical="RENTAL"))


def test_golden_history(spark):
    timeline = cycles.billing_timeline(cycles.snapshot_extract(history_log(spark), events=history_events(spark), vertical="RENTAL"))
    assert sorted(as_tuples(timeline, *SHOWN)) == expected(GOLDEN_CYCLES)
    assert {r.entity_id for r in timeline.collect()} == {ITEM_ID}


def test_month_numbering_variants(spark):
    snapshots = cycles.snapshot_extract(history_log(spark), vertical="RENTAL")
    for month in ("2026-02", "2026-03"):
        whole = cycles.month_snapshot(snapshots, month)
        within = cycles.month_snapshot(snapshots, month, renumber=True)
        assert sorted(as_tuples(whole, *SHOWN)) == expected(GOLDEN_CYCLES[-2:])
        assert sorted(r.cycle_num for r in within.collect()) == [1, 2]
    bounded = cycles.month_snapshot(snapshots, "2026-03", bounded=True)
    assert [r.cycle_num for r in bounded.collect()] == [15]


def test_month_snapshots_equal_single_months(spark):
    timeline = cycles.billing_timeline(cycles.snapshot_extract(history_log(spark), vertical="RENTAL"))
    both = cycles.month_snapshots(timeline, ["2025-12", "2026-03"])
    for month in ("2025-12", "2026-03"):
        single = cycles.in_month(timeline, month)
        tagged = both.where(F.col("snapshot_month") == F.lit(f"{month}-01").cast("date")).drop("snapshot_month")
        assert sorted(as_tuples(tagged, *SHOWN)) == sorted(as_tuples(single, *SHOWN))


def test_extract_filters_and_casts(spark):
    rows = [
        transition(1, 1, snapshot("2024-01-01", "2024-01-31", amount="12.5")),
        transition(2, 1, "{not json"),
        transition(3, 1, None),
        transition(4, 1, snapshot(None, "2024-01-31")),
        transition(5, 1, snapshot("2024-02-01", "2024-02-29", vertical="FURNITURE")),
        transition(6, 1, snapshot("2024-03-01", "not a date", amount="x")),
        transition(7, 1, snapshot("2024-04-01", "2024-04-30", deliveryAddressId="9")),
        transition(8, 1, snapshot("2024-05-01", "2024-05-31"), kind="ATTACHMENT"),
        transition(9, 1, snapshot("no date", "2024-06-30", ro_start="2024-07-01", ro_end="2024-07-31")),
    ]
    plain = cycles.snapshot_extract(log(spark, rows), vertical="RENTAL")
    assert sorted(as_tuples(plain, "state_transition_id", "tsd", "ted", "pre_tax_amount")) == [
        (1, day("2024-01-01"), day("2024-01-31"), 12.5),
        (6, day("2024-03-01"), None, None),
        (7, day("2024-04-01"), day("2024-04-30"), 100.0),
        (9, None, day("2024-06-30"), 100.0),
    ]
    addresses = spark.createDataFrame([(1, 6), (9, 2)], schemas.DELIVERY_ADDRESSES)
    in_city = cycles.snapshot_extract(log(spark, rows), addresses, city_id=6, vertical="RENTAL")
    assert sorted(r.state_transition_id for r in in_city.collect()) == [1, 6, 9]
    events = spark.createDataFrame([(1, "RENEWAL_APPLIED"), (7, "OTHER")], schemas.EVENTS)
    named = cycles.snapshot_extract(log(spark, rows), events=events, vertical="RENTAL")
    assert sorted(as_tuples(named, "state_transition_id", "event_name")) == [(1, "RENEWAL_APPLIED"), (7, "OTHER")]


def test_overdue_absorbed_by_start_whatever_its_end(spark):
    rows = [
        transition(1, 1, snapshot("2024-01-01", "2024-01-31", ro_start="2024-02-01", ro_end="2024-02-29")),
        transition(2, 1, snapshot("2024-02-01", "2024-04-30", 3)),
        transition(3, 1, snapshot("2024-02-01", "2024-04-30", 3, ro_start="2024-05-01", ro_end="2024-05-31")),
        transition(4, 2, snapshot("2024-05-01", "2024-05-31")),
    ]
    found = as_tuples(timeline_of(spark, rows), "entity_id", "period_start", "period_type", "state_transition_id")
    assert sorted(found) == [
        (1, day("2024-01-01"), "TENURE", 1),
        (1, day("2024-02-01"), "TENURE", 2),
        (1, day("2024-05-01"), "PURE_OVERDUE", 3),
        (2, day("2024-05-01"), "TENURE", 4),
    ]


def random_rows(n, hot_share, seed):
    """A log in which one entity holds ``hot_share`` of the rows."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        entity = 7 if rnd.random() < hot_share else rnd.randrange(1, 12)
        month, length = rnd.randrange(1, 10), rnd.randrange(1, 3)
        start, end = f"2024-{month:02d}-01", f"2024-{month + length:02d}-01"
        late = rnd.random() < 0.4
        later = f"2024-{rnd.randrange(1, 12):02d}-01"
        rows.append(
            transition(
                i, entity,
                snapshot(start, end, length, later if late else None, "2025-01-01" if late else None,
                         amount=round(rnd.random() * 100, 2), base=round(rnd.random() * 100, 2)),
            )
        )
    return rows


def brute_timeline(rows):
    """The definition, read literally, in plain Python."""
    import json

    tenures, overdues = {}, {}
    for id_, _, entity, _, _, _, text, _ in sorted(rows):
        s = json.loads(text)
        price = s["currentPricingDetails"]["basePrice"]
        paid = s["paymentDetails"]["payableAfterPaymentOffers"]["byCashPreTax"]
        tenures.setdefault((entity, s["tenureStartDate"], s["tenureEndDate"]), (id_, paid))
        if s["renewalOverdueCycleStartDate"]:
            overdues.setdefault(
                (entity, s["renewalOverdueCycleStartDate"], s["renewalOverdueCycleEndDate"]), (id_, price)
            )
    starts = {(e, s) for e, s, _ in tenures}
    kept = [(e, s, i, end, a, "TENURE") for (e, s, end), (i, a) in tenures.items()]
    kept += [(e, s, i, end, a, "PURE_OVERDUE") for (e, s, end), (i, a) in overdues.items() if (e, s) not in starts]
    out, seen = [], {}
    for e, s, i, end, a, kind in sorted(kept):
        seen[e] = seen.get(e, 0) + 1
        out.append((e, seen[e], day(s), day(end), a, kind, i))
    return sorted(out)


def test_fused_timeline_equals_definition_and_composition(spark):
    rows = random_rows(600, 1 / 3, seed=3)
    snapshots = cycles.snapshot_extract(log(spark, rows), vertical="RENTAL")
    shown = ("entity_id", "cycle_num", "period_start", "period_end", "cycle_amount", "period_type", "state_transition_id")
    fused = sorted(as_tuples(cycles.billing_timeline(snapshots), *shown))
    tenures = cycles.tenure_cycles(snapshots)
    composed = cycles.union_timeline(tenures, cycles.pure_overdue(cycles.overdue_cycles(snapshots), tenures))
    assert fused == brute_timeline(rows)
    assert sorted(as_tuples(composed, *shown)) == fused


def test_timeline_properties(spark):
    rows = random_rows(400, 1 / 3, seed=5)
    found = timeline_of(spark, rows).collect()
    by_entity = {}
    for r in found:
        by_entity.setdefault(r.entity_id, []).append(r)
        assert r.days >= 1
    for group in by_entity.values():
        group.sort(key=lambda r: r.cycle_num)
        assert [r.cycle_num for r in group] == list(range(1, len(group) + 1))
        assert [r.period_start for r in group] == sorted(r.period_start for r in group)
        tenure_starts = {r.period_start for r in group if r.period_type == "TENURE"}
        assert not tenure_starts & {r.period_start for r in group if r.period_type == "PURE_OVERDUE"}


def test_realised_revenue_is_proportional(spark):
    rows = [
        transition(1, 1, snapshot("2024-01-16", "2024-02-14", amount=300.0)),  # 30 days, 14 of them in February
        transition(2, 1, snapshot("2024-03-01", "2024-03-31", amount=310.0)),  # later
        transition(3, 1, snapshot("2024-02-20", "2024-02-20", amount=6.55)),  # one day inside
    ]
    cut = cycles.in_month(timeline_of(spark, rows), "2024-02")
    realised = cycles.with_realised_revenue(cut, "2024-02")
    assert sorted(as_tuples(realised, "state_transition_id", "realised_revenue")) == [(1, 140.0), (2, 0.0), (3, 6.55)]


def test_history_has_25_transitions():
    assert len(HISTORY) == 25


def test_whole_numbers_may_have_a_point_and_unreadable_values_are_counted(spark):
    document = '{"vertical": "%s", "tenureStartDate": "%s", "tenureEndDate": "2024-01-31", "tenureInMonths": %s, "activationDate": "2024-01-01"}'
    texts = [("RENTAL", "2024-01-01", "3.0"), ("RENTAL", "2024-02-01", "2.5"), ("Rental", "01.03.2024", "3")]
    rows = [(i, "ITEM", 1, i, "A", "A", document % t, None) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, schemas.STATE_TRANSITIONS)
    found = cycles.snapshot_extract(table, vertical=None).orderBy("state_transition_id").collect()
    assert [r.months for r in found] == [3, None, 3]
    assert [r.tsd is None for r in found] == [False, False, True]
    assert cycles.snapshot_extract(table, vertical="RENTAL").count() == 2
    bad = {r.field: r.unreadable for r in cycles.unreadable_values(table, vertical=None).collect()}
    assert bad["tenure_start_date"] == 1 and bad["tenure_in_months"] == 1 and bad["tenure_end_date"] == 0
    with pytest.raises(TypeError):
        cycles.snapshot_extract(table)
