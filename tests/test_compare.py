from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from billcycle import schemas
from billcycle.functions.money import as_amount, money_sum
from billcycle.operators import compare, rca
from billcycle.plans import reports
from billcycle.schemas import PERIOD_TYPES
from tests.samples import as_tuples, day


def cycle(entity, realised=100.0, amount=100.0, days=30, kind="TENURE", num=1, start="2024-01-01"):
    return (entity, num, day(start), day("2024-03-31"), day("2023-01-01"), None, 1, amount, kind, num, num, days, realised)


def side(spark, rows):
    return spark.createDataFrame(rows, schemas.MONTH_SNAPSHOT)


def drivers(spark, a, b):
    classified = compare.classify_changes(compare.entity_pair(side(spark, a), side(spark, b)))
    return {r.entity_id: (r.change_driver, r.change_detail) for r in classified.collect()}


A = [
    cycle(1), cycle(2), cycle(3, amount=100.0), cycle(4, amount=200.0), cycle(5), cycle(5, kind="PURE_OVERDUE", num=2),
    cycle(6), cycle(7), cycle(8), cycle(9, realised=None), cycle(10, amount=90.0),
]
B = [
    cycle(1), cycle(20, realised=70.0), cycle(3, amount=150.0, realised=150.0), cycle(4, amount=150.0, realised=50.0),
    cycle(5, realised=150.0), cycle(5, num=2, realised=60.0),
    cycle(6, days=20, realised=60.0), cycle(7, amount=60.0, realised=60.0), cycle(7, num=2, amount=40.0, realised=60.0),
    cycle(8, realised=99.0), cycle(9, realised=5.0), cycle(10, amount=80.0),
]


def test_every_driver(spark):
    assert drivers(spark, A, B) == {
        1: ("stable", None),
        2: ("churned", None),
        20: ("new_activation", None),
        3: ("rate_change", "upgrade"),
        4: ("rate_change", "downgrade"),
        5: ("period_type_shift", "PURE_OVERDUE+TENURE -> TENURE"),
        6: ("partial_period", None),
        7: ("partial_period", None),
        8: ("realised_only_change", None),
        9: ("other", None),  # no realised revenue on one side: the delta is unknown
        10: ("stable", None),  # another rate with the same revenue is stable
    }


def test_presence(spark):
    summary = compare.presence_summary(side(spark, A), side(spark, B)).first()
    assert tuple(summary) == (10, 10, 9, 1, 1)
    assert sorted(r.entity_id for r in compare.only_in_a(side(spark, A), side(spark, B)).collect()) == [2]
    assert sorted(r.entity_id for r in compare.only_in_b(side(spark, A), side(spark, B)).collect()) == [20]


def test_side_by_side_keys(spark):
    a, b = side(spark, A), side(spark, B)
    by_entity = compare.common_side_by_side(a, b, ("entity_id",))
    assert len(by_entity.where("entity_id = 5").collect()) == 4
    assert by_entity.columns[:2] == ["entity_id", "feb_cycle_num"] and "mar_realised_revenue" in by_entity.columns
    by_cycle = compare.common_side_by_side(a, b, ("entity_id", "cycle_num"))
    assert len(by_cycle.where("entity_id = 5").collect()) == 2
    twice = side(spark, [cycle(1, num=1), cycle(1, num=2)]).withColumn("period_start", F.expr("date'2024-01-01' + int(cycle_num)"))
    twice = twice.withColumn("period_end", F.col("period_start"))
    assert compare.common_side_by_side(twice, twice).count() == 2


def test_unknown_period_types_are_kept(spark):
    a = side(spark, [cycle(1, kind="TRIAL"), cycle(1, kind="TENURE", num=2)])
    assert compare.entity_aggregate(a).first().period_types == ["TENURE", "TRIAL"]
    b = side(spark, [cycle(1, kind="EXTENSION"), cycle(1, kind="TENURE", num=2, realised=20.0)])
    changed = compare.change_driver(compare.entity_pair(a, b)).first()
    assert changed.period_type_shifted
    with pytest.raises(Exception, match="period type"):
        compare.entity_aggregate(a, period_types=PERIOD_TYPES).collect()


def test_null_ids_stay_apart(spark):
    a = side(spark, [cycle(1), cycle(2)]).withColumn("entity_id", F.expr("nullif(entity_id, 2)"))
    b = side(spark, [cycle(1), cycle(3)]).withColumn("entity_id", F.expr("nullif(entity_id, 3)"))
    drivers = sorted(r.change_driver for r in compare.classify_changes(compare.entity_pair(a, b)).collect())
    assert drivers == ["churned", "new_activation", "stable"]
    seen = compare.presence_summary(a, b).first()
    assert (seen.feb_total, seen.common_both, seen.feb_only) == (1, 1, 0)
    presence = rca.rca_presence(a.withColumn("period_end", F.lit(None).cast("date")), b.withColumn("period_end", F.lit(None).cast("date")))
    assert sorted(r.presence for r in presence.collect()) == ["BOTH", "FEB_ONLY", "MARCH_ONLY"]


def test_amounts_are_exact_or_refused(spark):
    def total(*amounts):
        rows = [(float(x),) for x in amounts]
        return spark.createDataFrame(rows, "x double").agg(as_amount(money_sum("x")).alias("t")).first().t

    assert total(1e15, 0.25) == 1e15 + 0.25
    assert total(*[0.00004] * 10_000) == 0.4
    for bad in ("nan", "inf", "1e40"):
        with pytest.raises(Exception, match="no amount of money"):
            total(1, bad)


def test_bridge_of_an_empty_side(spark):
    a, b = side(spark, []), side(spark, [cycle(1), cycle(2)])
    lines = {r.category: r.delta_realised for r in compare.revenue_bridge(compare.entity_pair(a, b)).collect()}
    assert lines["Feb total realised revenue"] == 0.0
    assert lines["Component 2: New activations"] == 200.0
    assert lines["Residual (should be 0)"] == 0.0
    detail = {r.change_driver: r for r in reports.bridge_report(a, b).collect()}
    assert (detail["churned"].entity_count, detail["churned"].delta_realised) == (0, 0.0)
    assert detail["new_activation"].pct_of_total_delta == 100.0
    nothing = reports.bridge_report(side(spark, []), side(spark, [])).collect()
    assert [r.change_driver for r in nothing] == ["churned", "new_activation", "TOTAL"]


def test_zero_total_delta_has_no_shares(spark):
    rows = reports.bridge_report(side(spark, [cycle(1)]), side(spark, [cycle(2)])).collect()
    assert {r.change_driver: r.pct_of_total_delta for r in rows} == {
        "churned": None, "new_activation": None, "TOTAL": 100.0,
    }


def test_sorting_of_the_reports(spark):
    rows = reports.bridge_report(side(spark, A), side(spark, B)).collect()
    assert rows[-1].change_driver == "TOTAL"
    sizes = [abs(r.delta_realised) for r in rows[:-1] if r.delta_realised is not None]
    assert sizes == sorted(sizes, reverse=True)
    classified = compare.classify_changes(compare.entity_pair(side(spark, A), side(spark, B)))
    rates = compare.drilldown(classified, "rate_change", ordered=True)
    assert [r.entity_id for r in rates.collect()] == [4, 3]
    assert "feb_cycle_amount" in rates.columns and "mar_cycle_amount" in rates.columns
    churned = compare.drilldown(classified, "churned")
    assert [c for c in churned.columns if c.startswith("mar_")] == ["mar_realised"]
    assert 1 not in {r.entity_id for r in compare.drilldown(classified, ordered=True).collect()}


def random_side(rnd, hot_share):
    rows = []
    for n in range(500):
        entity = 5 if rnd.random() < hot_share else rnd.randrange(100)
        rows.append(
            cycle(entity, round(rnd.random() * 50, 2), float(rnd.randrange(1, 4) * 50), rnd.randrange(1, 31),
                  rnd.choice(schemas.PERIOD_TYPES), n)
        )
    return rows


def test_bridge_properties_with_a_hot_entity(spark):
    rnd = random.Random(11)
    a, b = random_side(rnd, 1 / 3), random_side(rnd, 1 / 3)
    left, right = side(spark, a), side(spark, b)
    pair = compare.entity_pair(left, right)
    assert pair.count() == len({r[0] for r in a} | {r[0] for r in b})
    lines = {r.category: r.delta_realised for r in compare.revenue_bridge(pair).collect()}
    assert lines["Residual (should be 0)"] == 0.0
    assert lines["Feb total realised revenue"] == round(sum(r[-1] for r in a), 2)
    balance = compare.bridge_balance(reports.bridge_report(left, right)).first()
    assert balance.balanced and balance.residual == 0.0
    summary = compare.presence_summary(left, right).first()
    assert summary.feb_total == summary.common_both + summary.feb_only
    assert summary.mar_total == summary.common_both + summary.mar_only
    one = compare.entity_aggregate(left).where("entity_id = 5").first()
    hot = [r for r in a if r[0] == 5]
    assert one.cycle_count == len(hot) and one.total_days == sum(r[11] for r in hot)
    assert one.realised_revenue == round(sum(r[-1] for r in hot), 2)


def test_pair_of_months_equals_pair_of_tables(spark):
    import datetime as dt

    from pyspark.sql import functions as F

    a, b = side(spark, A), side(spark, B)
    tagged = a.withColumn("snapshot_month", F.lit(dt.date(2024, 2, 1))).unionByName(
        b.withColumn("snapshot_month", F.lit(dt.date(2024, 3, 1)))
    )
    one = compare.entity_pair_of_months(tagged, "2024-02", "2024-03").orderBy("entity_id")
    two = compare.entity_pair(a, b).orderBy("entity_id")
    assert [tuple(r) for r in one.collect()] == [tuple(r) for r in two.collect()]
    assert as_tuples(one, "entity_id")
