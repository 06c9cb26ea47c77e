"""Input schemas (DDL text), enumerations and the JSON paths of the after-image."""

STATE_TRANSITIONS = (
    "id long, entity_type string, entity_id long, event_id long, from_state string, to_state string, "
    "snapshot string, created_at timestamp_ntz"
)
EVENTS = "id long, name string"
DELIVERY_ADDRESSES = "id long, city_id int"
_HOLDING = (
    "id long, name string, state string, vertical string, activation_date date, pickup_date date, "
    "tenure_start_date date, tenure_end_date date, tenure_in_months int, user_id long, "
    "renewal_overdue_cycle_start_date date, renewal_overdue_cycle_end_date date, payment_details string, "
)
ITEMS = _HOLDING + "current_pricing_details string, order_id long"
ATTACHMENTS = _HOLDING + "pricing_details string"
RENT_TO_PURCHASE_ITEMS = "id long, item_id long, rent_to_purchase_order_id long"
RENT_TO_PURCHASE_ATTACHMENTS = "id long, attachment_id long, rent_to_purchase_order_id long"
RENT_TO_PURCHASE_ORDERS = "id long, state string, created_at timestamp_ntz"
ORDERS = "id long, user_details string, vertical string"
REVENUE_RECOGNITIONS = (
    "customer_identifier string, city_id int, vertical string, state string, deleted_at timestamp_ntz, "
    "to_be_recognised_on date, monetary_components string"
)
INVOICE_CYCLES = (
    "customer_identifier string, city_id int, vertical string, state string, deleted_at timestamp_ntz, "
    "created_at timestamp_ntz, monetary_components string"
)
INVOICEABLE_GROUPS = "customer_identifier string, city_id int"
MONTH_SNAPSHOT = (
    "entity_id long, cycle_num long, period_start date, period_end date, activation_date date, pickup_date date, "
    "months int, cycle_amount double, period_type string, state_transition_id long, event_id long, days long, "
    "realised_revenue double"
)
# ---- fixed values of the domain -------------------------------------------------------------

TENURE = "TENURE"
PURE_OVERDUE = "PURE_OVERDUE"
PERIOD_TYPES = (PURE_OVERDUE, TENURE)

ITEM = "ITEM"
ATTACHMENT = "ATTACHMENT"

BILLABLE_STATES = (
    "ACTIVE",
    "AWAITING_RENEWAL_PAYMENT",
    "RENEWAL_OVERDUE",
    "RENT_TO_PURCHASE_IN_PROGRESS",
    "OUT_FOR_PICKUP",
    "PICKUP_SCHEDULED",
    "PICKUP_TO_BE_SCHEDULED",
    "REPLACEMENT_IN_PROGRESS",
    "SETTLEMENT_IN_PROGRESS",
    "SWAP_IN_PROGRESS",
    "SWAPPED",
    "PICKED_UP",
    "PURCHASED",
)
OVERDUE_STATE = "RENEWAL_OVERDUE"
CANCELLED_STATE = "CANCELLED"
PICKED_UP_STATE = "PICKED_UP"
KPI_EXCLUDED_STATES = ("CANCELLED", "SWAPPED", "PURCHASED")
RECOGNISED_STATES = ("PROCESSED", "FUTURE")
BILLED_STATES = ("INVOICED", "READY_TO_BE_INVOICED")

RENEWAL_APPLIED = "RENEWAL_APPLIED"
RENEWAL_OVERDUE = "RENEWAL_OVERDUE"
HISTORY_EVENTS = (
    "ORDER_SHIPMENT_DELIVERED",
    "ORDER_FULFILLMENT_FULFILLED",
    "RENEWAL_OVERDUE",
    "RENEWAL_APPLIED",
    "RENT_TO_PURCHASE_ORDER_PAYMENT_SUCCEEDED",
    "OUTSTANDING_PAYMENT_RECEIVED",
    "SWAP_SHIPMENT_DELIVERED",
)
STATE_EVENTS = (
    "ORDER_SHIPMENT_DELIVERED",
    "RENEWAL_OVERDUE",
    "RENEWAL_APPLIED",
    "RENT_TO_PURCHASE_ORDER_PAYMENT_SUCCEEDED",
    "OUTSTANDING_PAYMENT_RECEIVED",
)
EVENT_PRIORITY = {
    "RENEWAL_APPLIED": 1,
    "RENEWAL_OVERDUE": 2,
    "ORDER_SHIPMENT_DELIVERED": 3,
    "ORDER_FULFILLMENT_FULFILLED": 3,
}
OTHER_EVENT_PRIORITY = 9

# Stored timestamps are UTC, reports are in local time: +330 minutes.
LOCAL_OFFSET_MINUTES = 330

CITIES = {
    1: "Bengaluru",
    2: "Mumbai",
    4: "Delhi",
    5: "Gurugram",
    6: "Noida",
    7: "Hyderabad",
    8: "Chennai",
    9: "Pune",
    10: "Kolkata",
}
# Half-open month ranges [lo, hi).
TENURE_BUCKETS = {
    "0-3 months": (0, 3),
    "3-6 months": (3, 6),
    "6-12 months": (6, 12),
    "12+ months": (12, None),
}

# An exported transition history; the column order is the file's.
HISTORY_EXPORT = (
    "id long, entity_type string, entity_id long, from_state string, to_state string, event_id long, "
    "tenure_start_date date, tenure_end_date date, tenure_in_months int, "
    "renewal_overdue_cycle_start_date date, renewal_overdue_cycle_end_date date, "
    "effective_tenure_start date, effective_tenure_end date, entity_state string, pickup_date date, "
    "activation_date date, delivery_address_id long, city_id int, pre_tax_amount double, amount_paid double, "
    "base_price double, transition_created_at timestamp, event_name string"
)
# An exported event history with one line per side effect.
SIDE_EFFECT_EXPORT = (
    "event_name string, from_state string, to_state string, tsd date, ted date, ctd date, "
    "ro_start_date date, ro_end_date date, se_name string"
)

# JSON paths inside state_transitions.snapshot and the type each is read as.
SNAPSHOT_PATHS = {
    "vertical": ("vertical", "string"),
    "entity_state": ("state", "string"),
    "delivery_address_id": ("deliveryAddressId", "bigint"),
    "tenure_start_date": ("tenureStartDate", "date"),
    "tenure_end_date": ("tenureEndDate", "date"),
    "tenure_in_months": ("tenureInMonths", "int"),
    "renewal_overdue_cycle_start_date": ("renewalOverdueCycleStartDate", "date"),
    "renewal_overdue_cycle_end_date": ("renewalOverdueCycleEndDate", "date"),
    "activation_date": ("activationDate", "date"),
    "pickup_date": ("pickupDate", "date"),
    "pre_tax_amount": ("paymentDetails.payableAfterPaymentOffers.byCashPreTax", "double"),
    "amount_paid": ("paymentDetails.payableAfterPaymentOffers.byCashPostTax", "double"),
    "base_price": ("currentPricingDetails.basePrice", "double"),
}
PAYMENT_PATH = "payableAfterPaymentOffers.byCashPreTax"
PRICE_PATH = "basePrice"
DISPLAY_ID_PATH = "displayId"
TAXABLE_AMOUNT_PATH = "taxableAmount"
