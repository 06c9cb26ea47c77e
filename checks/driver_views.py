"""The given tables in the shapes of the rental data, row for row (nothing is dropped or sampled).

``events`` becomes the transition log with JSON after-images, ``customer`` the items, ``part`` the
attachments, ``orders`` the purchase links and the customers' orders, ``lineitem`` the revenue
facts. ``oracle.VIEWS`` states the same mapping in the other SQL dialect.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billcycle.operators.cycles import in_month
from billcycle.operators.kpi import KpiTables
from billcycle.plans.reports import HoldingTables, LogTables
from billcycle.sources.tables import load

CITY = 6
VERTICAL = "RENTAL"
STATES = ("ACTIVE", "RENEWAL_OVERDUE")
FIRST_MONTH, SECOND_MONTH = "1998-02", "1998-03"
_CITY_OF_NATION = f"cast(element_at(array({CITY}, 1, 2, 4), c_nationkey % 4 + 1) as int) as city_id"


def _payment(amount: str) -> str:
    return f"""to_json(named_struct('payableAfterPaymentOffers', named_struct('byCashPreTax', {amount})))
      as payment_details"""


def _tenure(origin: str, days: str, late: str) -> list[str]:
    """Tenure of 30 days from ``origin + days`` and, if late, the overdue cycle after it."""

    def day(offset: int) -> str:
        return f"date_add(date'{origin}', cast({days} + {offset} as int))"

    return [
        f"{day(0)} as tenure_start_date",
        f"{day(29)} as tenure_end_date",
        f"case when {late} then {day(30)} end as renewal_overdue_cycle_start_date",
        f"case when {late} then {day(59)} end as renewal_overdue_cycle_end_date",
    ]


class DriverViews:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return load(self.spark, f"{self.folder}/{name}.parquet")

    # ---- transition log -----------------------------------------------------------------------

    @cached_property
    def state_transitions(self) -> DataFrame:
        keyed = self.table("events").selectExpr(
            "*",
            "cast(get_json_object(props, '$.k') as int) as k",
            "date_add(date'2021-01-01', 30 * (dayofmonth(ts) - 1)) as tsd",
            "case when event_type = 'error' then 'RENEWAL_OVERDUE' else 'ACTIVE' end as new_state",
        )
        return keyed.selectExpr("*", "date_add(tsd, 30 * (1 + k % 3) - 1) as ted").selectExpr(
            "event_id as id",
            "case when (k div 4) % 5 = 0 then 'ATTACHMENT' else 'ITEM' end as entity_type",
            "user_id * 4 + k % 4 as entity_id",
            "event_id",
            "'ACTIVE' as from_state",
            "new_state as to_state",
            """to_json(named_struct(
              'vertical', case when k < 95 then 'RENTAL' else 'FURNITURE' end,
              'state', new_state,
              'deliveryAddressId', cast(user_id as string),
              'tenureStartDate', case when event_type <> 'signup' or k >= 10 then cast(tsd as string) end,
              'tenureEndDate', cast(ted as string),
              'tenureInMonths', 1 + k % 3,
              'renewalOverdueCycleStartDate', case when event_type = 'error' then cast(date_add(ted, 1) as string) end,
              'renewalOverdueCycleEndDate', case when event_type = 'error' then cast(date_add(ted, 30) as string) end,
              'activationDate', case when value >= 0.5
                then cast(date_add(date'2021-01-01', cast(user_id % 30 * 30 as int)) as string) end,
              'pickupDate', case when k >= 90 then cast(date_add(tsd, 15) as string) end,
              'paymentDetails', named_struct('payableAfterPaymentOffers',
                named_struct('byCashPreTax', value, 'byCashPostTax', value + k)),
              'currentPricingDetails', named_struct('basePrice', case when k % 10 <> 0 then k * 10 + 0.5D end)
            )) as snapshot""",
            "ts as created_at",
        )

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id as id",
            """case event_type when 'purchase' then 'RENEWAL_APPLIED' when 'error' then 'RENEWAL_OVERDUE'
              when 'signup' then 'ORDER_SHIPMENT_DELIVERED' when 'view' then 'ORDER_FULFILLMENT_FULFILLED'
              else 'PRICE_UPDATED' end as name""",
        )

    @cached_property
    def addresses(self) -> DataFrame:
        return self.table("customer").selectExpr("c_custkey as id", _CITY_OF_NATION)

    @property
    def log(self) -> LogTables:
        return LogTables(self.state_transitions, self.events, self.addresses)

    # ---- holdings -----------------------------------------------------------------------------

    @cached_property
    def items(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "c_custkey as id",
            "c_name as name",
            """case c_mktsegment when 'BUILDING' then 'ACTIVE' when 'AUTOMOBILE' then 'RENEWAL_OVERDUE'
              when 'MACHINERY' then 'CANCELLED' when 'HOUSEHOLD' then 'PICKED_UP' else 'PURCHASED' end as state""",
            "case when c_nationkey = 24 then 'FURNITURE' else 'RENTAL' end as vertical",
            "date_add(date'2021-01-01', cast(c_custkey * 7 % 600 as int)) as activation_date",
            """case when c_mktsegment = 'HOUSEHOLD' then date_add(date'2023-01-15', cast(c_custkey * 7 % 90 as int))
              end as pickup_date""",
            *_tenure("2022-06-01", "c_custkey % 300", "c_mktsegment = 'AUTOMOBILE' and c_custkey % 3 = 0"),
            "cast(1 + c_custkey % 12 as int) as tenure_in_months",
            "c_custkey as user_id",
            _payment("c_acctbal"),
            "to_json(named_struct('basePrice', c_nationkey * 10 + 0.5D)) as current_pricing_details",
        )

    @cached_property
    def attachments(self) -> DataFrame:
        return self.table("part").selectExpr(
            "p_partkey as id",
            "p_name as name",
            """case p_size % 4 when 0 then 'ACTIVE' when 1 then 'RENEWAL_OVERDUE' when 2 then 'PICKED_UP'
              else 'CANCELLED' end as state""",
            "'RENTAL' as vertical",
            "date_add(date'2021-01-01', cast(p_partkey * 3 % 600 as int)) as activation_date",
            """case when p_size % 4 = 2 then date_add(date'2023-01-15', cast(p_partkey * 7 % 90 as int))
              end as pickup_date""",
            *_tenure("2022-07-01", "p_partkey % 280", "p_size % 4 = 1"),
            "cast(1 + p_partkey % 12 as int) as tenure_in_months",
            "p_partkey as user_id",
            _payment("p_retailprice"),
            "to_json(named_struct('basePrice', p_size * 10 + 0.5D)) as pricing_details",
        )

    def _links(self, column: str, offset: int) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_orderkey as id", f"o_custkey + {offset} as {column}", "o_orderkey as rent_to_purchase_order_id"
        )

    @cached_property
    def item_links(self) -> DataFrame:
        return self._links("item_id", 0)

    @cached_property
    def attachment_links(self) -> DataFrame:
        return self._links("attachment_id", 1)

    def _purchase_orders(self, created_at: str) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_orderkey as id",
            """case when o_orderstatus = 'F' or o_orderpriority not in ('1-URGENT', '2-HIGH') then 'CANCELLED'
              else 'SUCCESS' end as state""",
            f"{created_at} as created_at",
        )

    @cached_property
    def purchase_orders(self) -> DataFrame:
        return self._purchase_orders("o_orderdate + interval 8035 days")

    @property
    def holdings(self) -> HoldingTables:
        return HoldingTables(
            self.items, self.item_links, self.purchase_orders, self.attachments, self.attachment_links
        )

    # ---- month snapshots ----------------------------------------------------------------------

    @cached_property
    def order_cycles(self) -> DataFrame:
        """Every order as a billing cycle of its customer, who is activated on a day given by the key."""
        return self.table("orders").selectExpr(
            "o_custkey as entity_id",
            "o_orderkey % 12 + 1 as cycle_num",
            "cast(o_orderdate as date) as period_start",
            "date_add(o_orderdate, cast(28 + 31 * (o_orderkey % 3) as int)) as period_end",
            "date_add(date'1993-01-01', cast(o_custkey * 13 % 1900 as int)) as activation_date",
            "case when o_orderkey % 5 = 0 then date_add(o_orderdate, 20) end as pickup_date",
            "cast((1 + floor(o_totalprice / 250000)) * 100 as double) as cycle_amount",
            "case when o_orderstatus = 'F' then 'PURE_OVERDUE' else 'TENURE' end as period_type",
            "o_orderkey as state_transition_id",
            "29 + 31 * (o_orderkey % 3) as days",
            """cast((1 + floor(o_totalprice / 250000)) * 100 as double) * (1 + o_orderkey % 2) / 2
              as realised_revenue""",
        )

    @cached_property
    def a(self) -> DataFrame:
        return in_month(self.order_cycles, FIRST_MONTH)

    @cached_property
    def b(self) -> DataFrame:
        return in_month(self.order_cycles, SECOND_MONTH)

    @cached_property
    def rca_items(self) -> DataFrame:
        """Customers as the items behind ``order_cycles``."""
        return self.table("customer").selectExpr(
            "c_custkey as id",
            """case c_mktsegment when 'HOUSEHOLD' then 'PICKED_UP' when 'MACHINERY' then 'CANCELLED'
              else 'ACTIVE' end as state""",
            """case when c_mktsegment = 'HOUSEHOLD' then date_add(date'1998-01-15', cast(c_custkey * 7 % 90 as int))
              end as pickup_date""",
        )

    @cached_property
    def rca_purchase_orders(self) -> DataFrame:
        return self._purchase_orders("o_orderdate")

    # ---- KPI tables ---------------------------------------------------------------------------

    @cached_property
    def kpi(self) -> KpiTables:
        orders, line = self.table("orders"), self.table("lineitem")
        rental_orders = orders.selectExpr(
            "o_orderkey as id",
            "to_json(named_struct('displayId', concat('C', o_custkey))) as user_details",
            """case o_orderpriority when '1-URGENT' then 'FURNITURE' when '2-HIGH' then 'APPLIANCES'
              else 'RENTAL' end as vertical""",
        )
        items = orders.selectExpr(
            "o_orderkey as id",
            "o_orderkey as order_id",
            """case o_orderstatus when 'F' then 'PICKED_UP' when 'O' then 'ACTIVE' else
              element_at(array('ACTIVE', 'CANCELLED', 'SWAPPED', 'PURCHASED'), cast(o_orderkey % 4 + 1 as int))
              end as state""",
            "case when o_orderpriority = '5-LOW' then 'FURNITURE' else 'RENTAL' end as vertical",
            "cast(o_orderdate as date) as activation_date",
            "case when o_orderstatus = 'F' then date_add(o_orderdate, cast(o_orderkey % 400 as int)) end as pickup_date",
            "cast(o_orderkey % 15 as int) as tenure_in_months",
        )
        groups = self.table("customer").selectExpr("concat('C', c_custkey) as customer_identifier", _CITY_OF_NATION)
        fact = [
            "concat('C', l_partkey) as customer_identifier",
            "l_linenumber as city_id",
            "case l_returnflag when 'R' then 'RENTAL' when 'A' then 'FURNITURE' else 'APPLIANCES' end as vertical",
            "case when l_discount = 0 then l_shipdate end as deleted_at",
        ]
        recognitions = line.selectExpr(
            *fact,
            """case when l_linestatus = 'F' then 'PROCESSED' when l_tax >= 0.04 then 'FUTURE' else 'CANCELLED'
              end as state""",
            "cast(l_shipdate as date) as to_be_recognised_on",
            """to_json(named_struct('taxableAmount', case when l_quantity <> 1 then l_extendedprice end))
              as monetary_components""",
        )
        invoices = line.selectExpr(
            *fact,
            """case when l_linestatus = 'F' then 'INVOICED' when l_tax < 0.04 then 'READY_TO_BE_INVOICED'
              else 'DRAFT' end as state""",
            "l_shipdate + interval 20 hours as created_at",
            """to_json(named_struct('taxableAmount', case when l_quantity <> 1 then l_extendedprice - l_quantity end))
              as monetary_components""",
        )
        return KpiTables(items, rental_orders, recognitions, invoices, groups)
