"""One query per operator, over the given tables. ``oracle.oracle_sql`` holds the SQL of each."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billcycle import schemas
from billcycle.functions.money import as_amount, money_sum
from billcycle.operators import base, compare, cycles, history, kpi, rca
from billcycle.plans import maintained, reports
from billcycle.sources import dimensions, tables
from checks.driver_views import CITY, FIRST_MONTH, SECOND_MONTH, STATES, VERTICAL, DriverViews

AS_OF = "2023-02-15"
LOG_MONTH = "2022-02"
CUT_MONTHS = ("2022-02", "2022-03")
KPI_MONTH_1, KPI_MONTH_2 = "1998-02", "1998-03"
SERIES = ("1995-07", "1997-06")

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _query(name: str):
    def register(build: Callable[[DriverViews], DataFrame]):
        _QUERIES[name] = lambda spark, folder: build(DriverViews(spark, folder))
        return build

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _joined_types(df: DataFrame) -> DataFrame:
    """Arrays as ``+``-joined text."""
    return df.withColumns({c: F.array_join(c, "+") for c, t in df.dtypes if t.startswith("array")})


def _doubles(df: DataFrame) -> DataFrame:
    """Exact amounts as doubles."""
    return df.withColumns({c: F.col(c).cast("double") for c, t in df.dtypes if t.startswith("decimal")})


def _folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for what a sink query writes, below the cluster's shared one; a local master may do without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


# ---- sources, sinks, dimensions ---------------------------------------------------------------


@_query("src_table")
def _(v: DriverViews) -> DataFrame:
    return (
        tables.load(v.spark, f"{v.folder}/orders.parquet")
        .groupBy("o_orderstatus", "o_orderpriority")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            as_amount(money_sum("o_totalprice")).alias("total_price"),
            F.max("o_orderdate").alias("last_order"),
        )
    )


def _snapshot_totals(df: DataFrame) -> DataFrame:
    return df.groupBy("period_type").agg(
        F.count(F.lit(1)).alias("cycles"),
        F.count("pickup_date").alias("with_pickup"),
        F.count_distinct("entity_id").alias("entities"),
        F.sum("days").alias("days"),
        F.min("period_start").alias("first_start"),
        as_amount(money_sum("cycle_amount")).alias("cycle_amount"),
    )


@_query("src_csv_export")
def _(v: DriverViews) -> DataFrame:
    path = _folder(v.spark, "csv-export")
    v.order_cycles.write.option("header", True).option("nullValue", "null").csv(path)
    return _snapshot_totals(
        tables.read_csv_export(v.spark, path, v.order_cycles.schema, null_text="null")
    )


@_query("src_csv_history_export")
def _(v: DriverViews) -> DataFrame:
    """The event history in the columns of its export, written with NULL as a word and read by the export's schema."""
    path = _folder(v.spark, "csv-history")
    rows = history.effective_tenure(
        base.billing_transitions(v.state_transitions, v.events, vertical=VERTICAL), overdue_price=False
    )
    history.export_columns(rows).write.option("header", True).option("nullValue", "null").csv(path)
    read = tables.read_csv_export(v.spark, path, schemas.HISTORY_EXPORT, null_text="null")
    return read.select(
        "id", "entity_type", "entity_id", "event_name", "tenure_start_date", "effective_tenure_end", "pre_tax_amount", "city_id"
    )


@_query("src_csv_side_effect_export")
def _(v: DriverViews) -> DataFrame:
    """An export with a line for each side effect, NULL left empty: lines and named effects of each event and cycle."""
    path = _folder(v.spark, "csv-side-effects")
    rows = history.state_event_history(v.state_transitions, v.events, entity_types=["item"], vertical=VERTICAL)
    effects = F.when(F.col("to_state") == "RENEWAL_OVERDUE", F.array(F.lit("NOTICE"), F.lit("LATE_FEE"))).otherwise(
        F.array(F.lit(None).cast("string"))
    )
    lines = rows.select(
        "event_name",
        "from_state",
        "to_state",
        F.col("tenure_start_date").alias("tsd"),
        F.col("tenure_end_date").alias("ted"),
        F.col("tenure_end_date").alias("ctd"),
        F.col("renewal_overdue_cycle_start_date").alias("ro_start_date"),
        F.col("renewal_overdue_cycle_end_date").alias("ro_end_date"),
        F.explode(effects).alias("se_name"),
    )
    lines.write.option("header", True).option("nullValue", "").csv(path)
    read = tables.read_csv_export(v.spark, path, schemas.SIDE_EFFECT_EXPORT)
    return read.groupBy(*[c for c in read.columns if c != "se_name"]).agg(
        F.count(F.lit(1)).alias("lines"), F.count("se_name").alias("named"), F.max("se_name").alias("last_name")
    )


@_query("sink_month_snapshot")
def _(v: DriverViews) -> DataFrame:
    path = _folder(v.spark, "month-snapshots")
    months = ("1996-02", "1996-03", "1996-04")
    tables.write_month_snapshots(cycles.month_snapshots(v.order_cycles, months), path)
    written = tables.load(v.spark, path)
    return (
        written.groupBy("snapshot_month")
        .agg(
            F.count(F.lit(1)).alias("cycles"),
            F.count_distinct("entity_id").alias("entities"),
            as_amount(money_sum("cycle_amount")).alias("cycle_amount"),
        )
    )


@_query("dim_city")
def _(v: DriverViews) -> DataFrame:
    named = dimensions.with_city_name(v.addresses)
    wanted = dimensions.dim_city(v.spark, ["Noida", "Mumbai", "Delhi"]).select("city_name")
    return named.join(F.broadcast(wanted), "city_name").groupBy("city_name").agg(
        F.count(F.lit(1)).alias("addresses")
    )


@_query("month_spine")
def _(v: DriverViews) -> DataFrame:
    spine = dimensions.month_spine(v.spark, "1998-03-15", 18)
    monthly = v.table("orders").groupBy(F.trunc("o_orderdate", "MM").alias("month_start")).agg(
        F.count(F.lit(1)).alias("orders")
    )
    return monthly.join(F.broadcast(spine), "month_start")


# ---- billing cycles ---------------------------------------------------------------------------


def _snapshots(v: DriverViews) -> DataFrame:
    return cycles.snapshot_extract(v.state_transitions, vertical=VERTICAL)


@_query("snapshot_extract")
def _(v: DriverViews) -> DataFrame:
    return cycles.snapshot_extract(v.state_transitions, v.addresses, v.events, city_id=CITY, vertical=VERTICAL)


@_query("tenure_cycles")
def _(v: DriverViews) -> DataFrame:
    return cycles.tenure_cycles(_snapshots(v))


@_query("overdue_cycles")
def _(v: DriverViews) -> DataFrame:
    snapshots = cycles.snapshot_extract(v.state_transitions, events=v.events, vertical=VERTICAL, named=False)
    return cycles.with_event_name(cycles.overdue_cycles(snapshots), v.events)


@_query("pure_overdue")
def _(v: DriverViews) -> DataFrame:
    return cycles.pure_overdue_cycles(_snapshots(v))


@_query("billing_timeline")
def _(v: DriverViews) -> DataFrame:
    return cycles.billing_timeline(_snapshots(v))


@_query("month_snapshot")
def _(v: DriverViews) -> DataFrame:
    return reports.city_cycles(v.log, LOG_MONTH, CITY, vertical=VERTICAL)


@_query("month_snapshot_renumbered")
def _(v: DriverViews) -> DataFrame:
    return cycles.month_snapshot(_snapshots(v), LOG_MONTH, renumber=True)


@_query("month_snapshot_city_renumbered")
def _(v: DriverViews) -> DataFrame:
    return reports.city_cycles(v.log, LOG_MONTH, CITY, vertical=VERTICAL, renumber=True)


@_query("realised_revenue")
def _(v: DriverViews) -> DataFrame:
    return reports.snapshots_of_months(v.log, CUT_MONTHS, vertical=VERTICAL)


def _maintained(v: DriverViews, **options) -> str:
    """Tables kept up to date in two runs: the transitions of the lower half of the ids, and then the others."""
    path = _folder(v.spark, "maintained")
    log = v.state_transitions
    half = (log.agg(F.max("id")).first()[0] or 0) // 2
    maintained.update_timeline(v.spark, log.where(F.col("id") <= half), path, vertical=VERTICAL, **options)
    maintained.update_timeline(v.spark, log, path, vertical=VERTICAL, **options)
    return path


@_query("billing_timeline_maintained")
def _(v: DriverViews) -> DataFrame:
    return maintained.read_timeline(v.spark, _maintained(v))


@_query("month_snapshots_maintained")
def _(v: DriverViews) -> DataFrame:
    return maintained.read_months(v.spark, _maintained(v, months=CUT_MONTHS, bounded=True))


# ---- state history ----------------------------------------------------------------------------


@_query("state_event_history")
def _(v: DriverViews) -> DataFrame:
    return history.state_event_history(v.state_transitions, v.events, entity_types=["item"], vertical=VERTICAL)


@_query("effective_tenure")
def _(v: DriverViews) -> DataFrame:
    return history.effective_tenure(base.billing_transitions(v.state_transitions, v.events, vertical=VERTICAL)).select(
        "state_transition_id", "event_name", "effective_tenure_start", "effective_tenure_end", "pre_tax_amount"
    )


@_query("renewal_dedup")
def _(v: DriverViews) -> DataFrame:
    rows = history.effective_tenure(base.billing_transitions(v.state_transitions, v.events, vertical=VERTICAL))
    return history.renewal_dedup(rows, known={"event_name": schemas.HISTORY_EVENTS}).select(
        "state_transition_id", "entity_type", "entity_id", "event_name", "effective_tenure_start"
    )


@_query("final_state_history")
def _(v: DriverViews) -> DataFrame:
    return history.final_state_history(
        v.state_transitions, v.events, entity_types=["item", "attachment"], states=STATES, vertical=VERTICAL
    )


ONE_ENTITY = (13, 18)


@_query("final_state_history_of_entities")
def _(v: DriverViews) -> DataFrame:
    """The history of named entities; the ids reach the scan."""
    return history.final_state_history(
        v.state_transitions, v.events, entity_types=["item"], entity_ids=ONE_ENTITY, vertical=VERTICAL
    )


@_query("state_event_history_of_entities")
def _(v: DriverViews) -> DataFrame:
    return history.state_event_history(
        v.state_transitions, v.events, entity_types=["item"], entity_ids=ONE_ENTITY, vertical=VERTICAL
    )


# ---- current base and previous cycle ----------------------------------------------------------


def _item_base(v: DriverViews, **options) -> DataFrame:
    return base.current_base(v.items, v.item_links, v.purchase_orders, as_of=AS_OF, vertical=VERTICAL, **options)


def _attachment_base(v: DriverViews) -> DataFrame:
    return base.attachment_base(v.attachments, v.attachment_links, v.purchase_orders, as_of=AS_OF, vertical=VERTICAL)


def _all_base(v: DriverViews) -> DataFrame:
    return base.all_base(_item_base(v), _attachment_base(v))


@_query("billable_next_month")
def _(v: DriverViews) -> DataFrame:
    return base.billable_next_month(v.items, v.item_links, v.purchase_orders, as_of=AS_OF, vertical=VERTICAL)


@_query("current_base")
def _(v: DriverViews) -> DataFrame:
    return _item_base(v)


@_query("current_base_next_month")
def _(v: DriverViews) -> DataFrame:
    return _item_base(v, keep_rule="next_month")


@_query("attachment_base")
def _(v: DriverViews) -> DataFrame:
    return _attachment_base(v)


@_query("all_base")
def _(v: DriverViews) -> DataFrame:
    return _all_base(v)


@_query("state_transitions_for_base")
def _(v: DriverViews) -> DataFrame:
    return base.state_transitions_for_base(v.state_transitions, v.events, _all_base(v), vertical=VERTICAL)


@_query("previous_cycle")
def _(v: DriverViews) -> DataFrame:
    transitions = base.billing_transitions(v.state_transitions, v.events, vertical=VERTICAL)
    return base.previous_cycle(transitions, _all_base(v)).select(
        "entity_type",
        "entity_id",
        "state_transition_id",
        "event_name",
        "effective_tenure_start",
        "effective_tenure_end",
        "tenure_in_months",
        "pre_tax_amount",
        "entity_state",
    )


@_query("current_vs_previous")
def _(v: DriverViews) -> DataFrame:
    return reports.current_against_previous(v.log, v.holdings, AS_OF, vertical=VERTICAL)


@_query("current_vs_previous_items")
def _(v: DriverViews) -> DataFrame:
    """Items only, under the other keep rule."""
    only_items = reports.HoldingTables(v.items, v.item_links, v.purchase_orders)
    return reports.current_against_previous(v.log, only_items, AS_OF, keep_rule="next_month", vertical=VERTICAL)


# ---- two snapshots ----------------------------------------------------------------------------


def _pair(v: DriverViews) -> DataFrame:
    return compare.entity_pair(v.a, v.b)


def _classified(v: DriverViews) -> DataFrame:
    return compare.classify_changes(_pair(v))


@_query("presence_summary")
def _(v: DriverViews) -> DataFrame:
    return compare.presence_summary(v.a, v.b)


@_query("presence_and_null_ids")
def _(v: DriverViews) -> DataFrame:
    """Orders of a fifth of the customers lose their id: on either side they are one entity that the other lacks."""
    lost = F.when(F.col("entity_id") % 5 != 0, F.col("entity_id"))
    a, b = v.a.withColumn("entity_id", lost), v.b.withColumn("entity_id", lost)
    return compare.classify_changes(compare.entity_pair(a, b)).groupBy("in_feb", "in_mar").agg(
        F.count(F.lit(1)).alias("entities"),
        F.count("entity_id").alias("with_id"),
        as_amount(money_sum("feb_realised")).alias("feb_realised"),
        as_amount(money_sum("mar_realised")).alias("mar_realised"),
    )


@_query("only_in_a")
def _(v: DriverViews) -> DataFrame:
    return compare.only_in_a(v.a, v.b)


@_query("only_in_b")
def _(v: DriverViews) -> DataFrame:
    return compare.only_in_b(v.a, v.b)


@_query("common_side_by_side")
def _(v: DriverViews) -> DataFrame:
    return compare.common_side_by_side(v.a, v.b, ("entity_id",))


@_query("common_side_by_side_by_cycle")
def _(v: DriverViews) -> DataFrame:
    return compare.common_side_by_side(v.a, v.b, ("entity_id", "period_start", "state_transition_id"))


@_query("common_side_by_side_by_period")
def _(v: DriverViews) -> DataFrame:
    """The default key: a cycle beside itself in the other month."""
    return compare.common_side_by_side(v.a, v.b)


@_query("entity_aggregate")
def _(v: DriverViews) -> DataFrame:
    return _joined_types(compare.entity_aggregate(v.a))


@_query("revenue_bridge")
def _(v: DriverViews) -> DataFrame:
    return compare.revenue_bridge(_pair(v))


@_query("revenue_bridge_of_bucketed_months")
def _(v: DriverViews) -> DataFrame:
    """Both months written to a table bucketed by entity and compared without another shuffle of their rows."""
    path = _folder(v.spark, "bucketed-months")
    name = f"months_{uuid.uuid4().hex}"
    tables.create_month_table(v.spark, name, path, v.a.schema, buckets=16)
    for month, snapshot in ((FIRST_MONTH, v.a), (SECOND_MONTH, v.b)):
        tables.write_month(snapshot, name, month)
    return compare.revenue_bridge(compare.entity_pair_of_months(v.spark.table(name), FIRST_MONTH, SECOND_MONTH))


@_query("change_driver")
def _(v: DriverViews) -> DataFrame:
    return _joined_types(compare.change_driver(_pair(v)).drop("change_detail"))


@_query("change_detail")
def _(v: DriverViews) -> DataFrame:
    return compare.change_driver(_pair(v)).select("entity_id", "change_driver", "change_detail")


@_query("bridge_detail")
def _(v: DriverViews) -> DataFrame:
    return reports.bridge_report(v.a, v.b)


@_query("drilldown")
def _(v: DriverViews) -> DataFrame:
    return _joined_types(compare.drilldown(_classified(v)))


@_query("drilldown_churned")
def _(v: DriverViews) -> DataFrame:
    return _joined_types(compare.drilldown(_classified(v), compare.CHURNED, ordered=True))


@_query("drilldown_new_activation")
def _(v: DriverViews) -> DataFrame:
    return _joined_types(compare.drilldown(_classified(v), compare.NEW_ACTIVATION, ordered=True))


@_query("drilldown_rate_change")
def _(v: DriverViews) -> DataFrame:
    return _joined_types(compare.drilldown(_classified(v), compare.RATE_CHANGE, ordered=True))


@_query("bridge_balance")
def _(v: DriverViews) -> DataFrame:
    return compare.bridge_balance(reports.bridge_report(v.a, v.b))


@_query("log_to_bridge")
def _(v: DriverViews) -> DataFrame:
    """From the transition log to the bridge: extract, timeline, two months, drivers."""
    both = reports.snapshots_of_months(v.log, CUT_MONTHS, vertical=VERTICAL)
    return compare.bridge_detail(compare.classify_changes(compare.entity_pair_of_months(both, *CUT_MONTHS)))


# ---- root causes ------------------------------------------------------------------------------


@_query("rca_side_aggregate")
def _(v: DriverViews) -> DataFrame:
    return _doubles(rca.rca_side_aggregate(v.a, "feb"))


@_query("rca_presence")
def _(v: DriverViews) -> DataFrame:
    return _doubles(rca.rca_presence(v.a, v.b))


def _reasons(v: DriverViews, every_link: bool = False, sides: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    return rca.rca_reason(
        rca.rca_presence(*(sides or (v.a, v.b))),
        v.rca_items,
        v.item_links,
        v.rca_purchase_orders,
        second_month=SECOND_MONTH,
        every_link=every_link,
    )


@_query("rca_reason")
def _(v: DriverViews) -> DataFrame:
    return _doubles(_reasons(v))


@_query("rca_summary")
def _(v: DriverViews) -> DataFrame:
    return rca.rca_summary(_reasons(v))


@_query("rca_summary_of_written_months")
def _(v: DriverViews) -> DataFrame:
    """Both months read back from the snapshot table, each from its own folder."""
    path = _folder(v.spark, "rca-months")
    tables.write_month_snapshots(cycles.month_snapshots(v.order_cycles, (FIRST_MONTH, SECOND_MONTH)), path)
    sides = tuple(tables.read_month_snapshot(v.spark, path, m) for m in (FIRST_MONTH, SECOND_MONTH))
    return rca.rca_summary(_reasons(v, sides=sides))


@_query("rca_summary_every_link")
def _(v: DriverViews) -> DataFrame:
    return rca.rca_summary(_reasons(v, every_link=True))


@_query("log_to_rca")
def _(v: DriverViews) -> DataFrame:
    """From the transition log to the root causes of two months."""
    both = reports.snapshots_of_months(v.log, CUT_MONTHS, vertical=VERTICAL)
    a, b = (both.where(F.col("snapshot_month") == F.lit(f"{m}-01").cast("date")) for m in CUT_MONTHS)
    return reports.rca_report(a, b, v.holdings, CUT_MONTHS[0])


# ---- KPIs -------------------------------------------------------------------------------------


def _customer_count(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("customer_identifier").alias("customers")
    )


@_query("filter_city_direct")
def _(v: DriverViews) -> DataFrame:
    return _customer_count(kpi.filter_city_direct(v.kpi.revenue_recognitions, [1, 2, 6]), "city_id")


@_query("filter_city_customers")
def _(v: DriverViews) -> DataFrame:
    t = v.kpi
    rows = kpi.filter_city_customers(kpi.customer_items(t.items, t.orders, VERTICAL), t.invoiceable_groups, [1, 6])
    return _customer_count(rows, "state")


@_query("filter_vertical")
def _(v: DriverViews) -> DataFrame:
    return _customer_count(kpi.filter_vertical(v.kpi.invoice_cycles, ["RENTAL", "APPLIANCES"]), "vertical")


@_query("filter_tenure_bucket")
def _(v: DriverViews) -> DataFrame:
    t = v.kpi
    rows = kpi.customer_items(t.items, t.orders, VERTICAL)
    middle = kpi.filter_tenure_bucket(rows, (6, 12)).withColumn("bucket", F.lit("6-12 months"))
    long = kpi.filter_tenure_bucket(rows, (12, None)).withColumn("bucket", F.lit("12+ months"))
    return _customer_count(middle.unionByName(long), "bucket")


@_query("filter_plan")
def _(v: DriverViews) -> DataFrame:
    t = v.kpi
    return _customer_count(kpi.filter_plan(kpi.customer_items(t.items, t.orders, VERTICAL), 3), "state")


@_query("filter_new_returning")
def _(v: DriverViews) -> DataFrame:
    customers = kpi.customer_rows(v.kpi.items, v.kpi.orders, VERTICAL)
    typed = customers.withColumn("customer_type", kpi.customer_type("1996-01")).where("customer_type is not null")
    return typed.groupBy("customer_type").agg(
        F.sum("row_count").alias("row_count"), F.count("customer_identifier").alias("customers")
    )


@_query("first_activation")
def _(v: DriverViews) -> DataFrame:
    return kpi.first_activation(v.kpi.items, v.kpi.orders, VERTICAL)


_CITY_AND_NEW = kpi.KpiFilters(city_ids=(1, 6), customer_type=kpi.NEW)
_RETURNING = kpi.KpiFilters(
    city_ids=(1, 6), verticals=("RENTAL", "APPLIANCES"), customer_type=kpi.RETURNING, tenure_range=(3, None)
)


@_query("kpi_mrr")
def _(v: DriverViews) -> DataFrame:
    return kpi.kpi_mrr(v.kpi, KPI_MONTH_1, vertical=VERTICAL)


@_query("kpi_mrr_new_customers")
def _(v: DriverViews) -> DataFrame:
    return kpi.kpi_mrr(v.kpi, "1996-01", _CITY_AND_NEW, vertical=VERTICAL)


@_query("kpi_active_subscriptions")
def _(v: DriverViews) -> DataFrame:
    return kpi.kpi_active_subscriptions(v.kpi, KPI_MONTH_1, vertical=VERTICAL)


@_query("kpi_active_subscriptions_new")
def _(v: DriverViews) -> DataFrame:
    return kpi.kpi_active_subscriptions(v.kpi, "1996-01", _CITY_AND_NEW, legacy_bound=True, vertical=VERTICAL)


@_query("kpi_churned_customers")
def _(v: DriverViews) -> DataFrame:
    return kpi.kpi_churned_customers(v.kpi, KPI_MONTH_1, kpi.KpiFilters(city_ids=(1, 6)), vertical=VERTICAL)


@_query("kpi_revenue_billed")
def _(v: DriverViews) -> DataFrame:
    return kpi.kpi_revenue_billed(v.kpi, KPI_MONTH_1, vertical=VERTICAL)


@_query("kpi_month_compare")
def _(v: DriverViews) -> DataFrame:
    return kpi.kpi_month_compare(v.kpi, KPI_MONTH_1, KPI_MONTH_2, vertical=VERTICAL)


@_query("kpi_month_compare_filtered")
def _(v: DriverViews) -> DataFrame:
    return kpi.kpi_month_compare(v.kpi, KPI_MONTH_1, KPI_MONTH_2, _RETURNING, vertical=VERTICAL)


_NEW_ON_PLAN = kpi.KpiFilters(customer_type=kpi.NEW, plan_months=3)


@_query("kpi_month_compare_new_on_plan")
def _(v: DriverViews) -> DataFrame:
    return kpi.kpi_month_compare(v.kpi, "1996-01", "1996-02", _NEW_ON_PLAN, vertical=VERTICAL)


@_query("kpi_by_month")
def _(v: DriverViews) -> DataFrame:
    return kpi.kpi_by_month(v.kpi, ["1997-01", "1997-04", "1997-07", "1997-10"], vertical=VERTICAL)


@_query("kpi_series")
def _(v: DriverViews) -> DataFrame:
    return kpi.kpi_series(v.kpi, *SERIES, vertical=VERTICAL)


@_query("kpi_series_returning")
def _(v: DriverViews) -> DataFrame:
    return kpi.kpi_series(v.kpi, *SERIES, _RETURNING, vertical=VERTICAL)


@_query("kpi_series_new")
def _(v: DriverViews) -> DataFrame:
    return kpi.kpi_series(v.kpi, *SERIES, _CITY_AND_NEW, legacy_bound=True, vertical=VERTICAL)
