"""Properties of the physical plans that decide how the work scales."""

from __future__ import annotations

import re

import pytest

from billcycle.operators import base, compare, cycles, history, kpi
from billcycle.plans import reports
from billcycle.schemas import PERIOD_TYPES
from checks.driver_views import DriverViews
from checks.spark_queries import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture()
def large(spark):
    """Plans as for tables too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield DriverViews(spark, FOLDER)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def count(plan: str, pattern: str) -> int:
    return len(re.findall(pattern, plan))


LOG_QUERIES = ("month_snapshot", "month_snapshot_city_renumbered", "overdue_cycles", "pure_overdue", "billing_timeline")
WRITING = (
    "src_csv_export", "src_csv_history_export", "src_csv_side_effect_export", "sink_month_snapshot",
    "rca_summary_of_written_months", "revenue_bridge_of_bucketed_months", "billing_timeline_maintained", "month_snapshots_maintained",
)


@pytest.mark.parametrize("name", [n for n in queries() if n not in WRITING])
def test_no_cross_join_no_python(spark, large, name):
    plan = plan_of(queries()[name](spark, FOLDER))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert operator not in plan


def test_timeline_is_one_scan_one_parse_two_shuffles(large):
    plan = plan_of(cycles.billing_timeline(cycles.snapshot_extract(large.state_transitions, vertical="RENTAL")))
    assert count(plan, "FileScan") == 1
    assert count(plan, "from_json") == 1
    assert count(plan, "Exchange hashpartitioning") == 2
    # one row per cycle and task before the first shuffle
    assert plan.index("partial_min") > plan.index("Exchange hashpartitioning")


def test_document_is_parsed_once_below_its_filters(large):
    plan = plan_of(history.state_event_history(large.state_transitions, large.events, vertical="RENTAL"))
    assert count(plan, "from_json") == 1
    parse = plan.index("from_json")
    assert plan.index("vertical = RENTAL") < parse  # the filter sits above the parse


def test_plain_filters_reach_the_scan(spark, large, tmp_path):
    path = str(tmp_path / "log")
    large.state_transitions.write.parquet(path)
    plan = plan_of(cycles.snapshot_extract(spark.read.parquet(path), vertical="RENTAL"))
    assert "EqualTo(entity_type,ITEM)" in plan
    schema = re.search(r"ReadSchema: struct<(.*?)>", plan).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"id", "entity_type", "entity_id", "event_id", "snapshot"}


def test_pair_is_one_shuffle(spark, large, tmp_path):
    path = str(tmp_path / "snapshots")
    large.order_cycles.write.parquet(path)
    a = spark.read.parquet(path)
    plan = plan_of(compare.classify_changes(compare.entity_pair(a, a, period_types=PERIOD_TYPES)))
    assert count(plan, "Exchange hashpartitioning") == 1 and "Join" not in plan
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_bucketed_months_meet_without_a_shuffle(spark, large):
    plan = plan_of(queries()["revenue_bridge_of_bucketed_months"](spark, FOLDER))
    assert count(plan, "FileScan") == 1 and "Bucketed: true" in plan
    assert "Exchange hashpartitioning" not in plan and count(plan, "Exchange SinglePartition") == 1


def test_pair_of_months_reads_the_log_once(spark, large):
    """The totals come with the groups: no other pass, no subquery."""
    plan = plan_of(queries()["log_to_bridge"](spark, FOLDER))
    assert count(plan, "FileScan") == 1 and count(plan, "from_json") == 1 and "ubquery" not in plan


@pytest.mark.parametrize("name", ["renewal_dedup", "final_state_history"])
def test_dedup_of_known_texts_is_hashed(spark, large, name):
    plan = plan_of(queries()[name](spark, FOLDER))
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan and count(plan, "HashAggregate") == 2


@pytest.mark.parametrize("name", ["bridge_detail", "bridge_balance"])
def test_totals_of_the_bridge_need_no_other_scan(spark, large, name):
    plan = plan_of(queries()[name](spark, FOLDER))
    assert count(plan, "FileScan") == count(plan_of(queries()["drilldown"](spark, FOLDER)), "FileScan") == 2
    assert "ubquery" not in plan


def test_previous_cycle_reduces_before_it_shuffles(large):
    transitions = base.billing_transitions(large.state_transitions, large.events, vertical="RENTAL")
    plan = plan_of(base.base_with_previous(base.current_base(
        large.items, large.item_links, large.purchase_orders, as_of="2023-02-15", vertical="RENTAL"), transitions))
    # a row for each end and task, before and after the shuffle; no join with the base, which is planned once
    assert count(plan, "WindowGroupLimit") == 2 and "Partial" in plan
    assert count(plan, "from_json") <= 3 and count(plan, "Union") == 1


def test_links_are_aggregated_before_they_meet_the_holdings(large):
    plan = plan_of(
        base.current_base(large.items, large.item_links, large.purchase_orders, as_of="2023-02-15", vertical="RENTAL")
    )
    assert count(plan, "partial_bool_or|partial_max") >= 1 and "Window" not in plan


def pushed(plan: str) -> str:
    return " ".join(re.findall(r"PushedFilters: ([^\n]*), ReadSchema", plan))


@pytest.fixture()
def stored(spark, large, tmp_path):
    """The log and the KPI tables as Parquet files; plans show their filters in full."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    tables = {"log": large.state_transitions, "events": large.events, "items": large.kpi.items, "orders": large.kpi.orders}
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / name))
    yield {name: spark.read.parquet(str(tmp_path / name)) for name in tables}
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_entity_filters_reach_the_scan(stored):
    rows = history.final_state_history(
        stored["log"], stored["events"], entity_types=["item"], entity_ids=[13], vertical="RENTAL"
    )
    filters = pushed(plan_of(rows))
    assert "EqualTo(entity_type,ITEM)" in filters and "EqualTo(entity_id,13)" in filters


def test_churn_reads_only_picked_up_items(stored):
    tables = kpi.KpiTables(stored["items"], stored["orders"], None, None, None)
    plan = plan_of(kpi.kpi_churned_customers(tables, "1996-02", vertical="RENTAL"))
    assert "EqualTo(state,PICKED_UP)" in pushed(plan) and "GreaterThanOrEqual(pickup_date" in pushed(plan)
    assert count(plan, "from_json") == 1


@pytest.mark.parametrize("name", LOG_QUERIES)
def test_log_rows_stay_in_the_hash_aggregate(spark, large, name):
    assert "SortAggregate" not in plan_of(queries()[name](spark, FOLDER))


@pytest.mark.parametrize("name", ["previous_cycle", "current_vs_previous"])
def test_the_previous_cycle_is_one_scan_of_ends_and_holdings(spark, large, name):
    """The base (items, attachments) is planned once, the log parsed once: 8 scans and 12 shuffles, not 14 and 23."""
    plan = plan_of(queries()[name](spark, FOLDER))
    assert count(plan, "FileScan") <= 8 and count(plan, "Exchange hashpartitioning") <= 12
    assert "SortAggregate" not in plan and "WindowGroupLimit" in plan


def test_pure_overdue_and_types_are_one_pass(spark, large):
    assert count(plan_of(queries()["pure_overdue"](spark, FOLDER)), "FileScan") == 1
    assert count(plan_of(queries()["filter_new_returning"](spark, FOLDER)), "FileScan") == 2  # items and orders
