"""One key holds a third of the rows: same results, and the hot key does not end in one task."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from billcycle.functions.firstrow import extreme_row, first_by_id
from billcycle.operators import compare, cycles, history, kpi
from billcycle.operators.base import billing_transitions

ROWS = 60_000
HOT = 77


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A log in which one entity holds a third of the transitions and one event another third."""
    log = spark.range(0, ROWS, 1, 8).selectExpr(
        "id",
        "'ITEM' as entity_type",
        f"if(id % 3 = 0, {HOT}L, pmod(xxhash64(id), 2000)) as entity_id",
        "if(id % 3 = 1, 5L, id) as event_id",
        "'ACTIVE' as from_state",
        "'ACTIVE' as to_state",
        "add_months(date'2021-01-01', cast(pmod(xxhash64(id, 1), 24) as int)) as tsd",
    )
    log = log.selectExpr(
        "id", "entity_type", "entity_id", "event_id", "from_state", "to_state",
        """to_json(named_struct('vertical', 'RENTAL', 'state', 'ACTIVE', 'activationDate', '2021-01-01',
          'tenureStartDate', cast(tsd as string), 'tenureEndDate', cast(last_day(tsd) as string),
          'paymentDetails', named_struct('payableAfterPaymentOffers', named_struct('byCashPreTax', id))))
          as snapshot""",
        "timestamp_ntz'2024-01-01 00:00:00' as created_at",
    )
    folder = str(tmp_path_factory.mktemp("skew"))
    log.write.parquet(f"{folder}/log")
    spark.range(ROWS).selectExpr(
        "id", "if(id % 2 = 0, 'RENEWAL_APPLIED', 'RENEWAL_OVERDUE') as name"
    ).write.parquet(f"{folder}/events")
    return spark.read.parquet(f"{folder}/log"), spark.read.parquet(f"{folder}/events")


@pytest.fixture()
def large(spark):
    """Small thresholds, so that the run-time rules act on test data as they do on large data."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def shuffled_rows(df):
    """Rows written by each shuffle of the executed plan, and the final plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().finalPhysicalPlan()
    found, pending = [], [plan]
    while pending:
        node = pending.pop()
        name = node.nodeName()
        if name in ("ShuffleQueryStage", "ResultQueryStage", "AQEShuffleRead"):
            pending.append(node.child() if name == "AQEShuffleRead" else node.plan())
            continue
        if name == "Exchange":
            found.append(node.metrics().get("shuffleRecordsWritten").get().value())
        children = node.children()
        pending += [children.apply(i) for i in range(children.size())]
    return found, plan.toString()


def test_hot_cycles_shrink_before_the_shuffle(spark, tables, large):
    log, _ = tables
    rows = cycles.snapshot_extract(log, vertical="RENTAL").where(F.col("entity_id") == HOT)
    firsts = first_by_id(
        rows.selectExpr("entity_id", "tsd", "ted", "state_transition_id", "pre_tax_amount"),
        ["entity_id", "tsd", "ted"],
        "state_transition_id",
    )
    written, _ = shuffled_rows(firsts)
    tasks = log.rdd.getNumPartitions()
    assert firsts.count() == 24
    assert written and max(written) <= 24 * tasks < ROWS // 3


def test_hot_history_shrinks_before_the_shuffle(spark, tables, large):
    rows = history.effective_tenure(billing_transitions(*tables, vertical="RENTAL")).where(F.col("entity_id") == HOT)
    kept = history.renewal_dedup(rows)
    assert kept.count() == 24
    assert {r.event_name for r in kept.collect()} == {"RENEWAL_APPLIED"}


def test_hot_event_is_split_by_the_join(spark, tables, large):
    joined = billing_transitions(*tables, vertical="RENTAL")
    _, plan = shuffled_rows(joined)
    assert "SortMergeJoin(skew=true)" in plan
    assert joined.count() == ROWS


def test_timeline_of_a_hot_entity(spark, tables, large):
    timeline = cycles.billing_timeline(cycles.snapshot_extract(tables[0], vertical="RENTAL"))
    hot = sorted((r.cycle_num, str(r.period_start)) for r in timeline.where(F.col("entity_id") == HOT).collect())
    assert [n for n, _ in hot] == list(range(1, 25))
    assert [s for _, s in hot] == sorted(s for _, s in hot)
    everyone = tables[0].selectExpr("entity_id", "get_json_object(snapshot, '$.tenureStartDate') as s").distinct()
    assert timeline.count() == everyone.count()


def test_extreme_row_matches_row_number(spark):
    rows = spark.range(0, 5000).selectExpr(
        "if(id % 3 = 0, 1L, id % 50) as k", "pmod(xxhash64(id), 97) as o", "id", "concat('x', id) as text"
    )
    found = extreme_row(rows, ["k"], F.struct("o", "id"))
    wanted = rows.selectExpr("*", "row_number() over (partition by k order by o desc, id desc) as n").where("n = 1")
    assert sorted(map(tuple, found.collect())) == sorted(tuple(r)[:4] for r in wanted.collect())


@pytest.mark.parametrize("kind", ["only_in_a", "filter_city_customers"])
def test_hot_key_of_an_existence_join_is_split(spark, tmp_path, large, kind):
    rows = spark.range(0, 200_000, 1, 8).selectExpr("if(id % 3 = 0, 7L, id) as entity_id", "id as payload")
    other = spark.range(0, 200_000, 1, 8).selectExpr("id * 3 as entity_id", "1 as city_id")
    rows.write.parquet(str(tmp_path / "rows"))
    other.write.parquet(str(tmp_path / "other"))
    rows, other = (spark.read.parquet(str(tmp_path / n)) for n in ("rows", "other"))
    if kind == "only_in_a":
        found = compare.only_in_a(rows, other)
    else:
        groups = other.selectExpr("entity_id as customer_identifier", "city_id")
        found = kpi.filter_city_customers(rows.withColumnRenamed("entity_id", "customer_identifier"), groups, [1])
    _, plan = shuffled_rows(found)
    assert "skew=true" in plan


def test_types_of_a_hot_customer_are_reduced_before_the_shuffle(spark, tmp_path, large):
    spark.range(0, 60_000, 1, 8).selectExpr(
        "id as order_id", "id", "'RENTAL' as vertical", "date_add(date'1995-06-01', cast(id % 400 as int)) as activation_date"
    ).write.parquet(str(tmp_path / "items"))
    spark.range(0, 60_000, 1, 8).selectExpr(
        "id", "'RENTAL' as vertical", "to_json(named_struct('displayId', if(id % 3 = 0, 'hot', cast(id as string)))) as user_details"
    ).write.parquet(str(tmp_path / "orders"))
    items, orders = (spark.read.parquet(str(tmp_path / n)) for n in ("items", "orders"))
    customers = kpi.customer_rows(items, orders, "RENTAL")
    written, _ = shuffled_rows(customers.where("customer_identifier = 'hot'"))
    assert min(written) <= 16 * 8
    assert customers.where("customer_identifier = 'hot'").first().row_count == 20_000
