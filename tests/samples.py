"""Hand-made rows: a real-life history of one item and builders for edge cases."""

from __future__ import annotations

import datetime as dt
import json

from billcycle import schemas

ITEM_ID = 96814

# fixed values: transition id, tenure start, end, months, overdue start, end, amount, event, time
HISTORY = [
    (635257, "2023-03-12", "2023-04-11", 1, None, None, 549.0, "RENEWAL_APPLIED", "2023-03-13 19:25:27"),
    (1504507, "2023-04-12", "2023-07-11", 3, None, None, 1152.9, "RENEWAL_APPLIED", "2023-04-12 00:31:08"),
    (4219100, "2023-07-12", "2023-10-11", 3, None, None, 1070.55, "RENEWAL_APPLIED", "2023-07-14 19:56:15"),
    (8286903, "2023-07-12", "2023-10-11", 3, "2023-10-12", "2023-11-11", 1070.55, "RETURN_PARTIAL_CANCELLATION", "2023-11-17 16:16:57"),
    (8287087, "2023-11-12", "2023-12-11", 1, None, None, 466.65, "RENEWAL_APPLIED", "2023-11-17 16:20:32"),
    (11137810, "2024-01-12", "2024-04-11", 3, None, None, 988.17, "RENEWAL_APPLIED", "2024-01-22 13:25:01"),
    (15473861, "2024-04-12", "2024-07-11", 3, None, None, 1152.9, "RENEWAL_APPLIED", "2024-04-21 11:59:18"),
    (23045357, "2024-07-12", "2024-10-11", 3, None, None, 1152.9, "RENEWAL_APPLIED", "2024-07-15 14:24:17"),
    (32930724, "2024-10-12", "2025-01-11", 3, None, None, 1152.9, "RENEWAL_APPLIED", "2024-10-14 11:33:18"),
    (41111370, "2024-10-12", "2025-01-11", 3, "2025-01-12", "2025-02-11", 1152.9, "RENEWAL_OVERDUE", "2025-01-12 00:11:29"),
    (41244216, "2025-01-12", "2025-07-11", 6, None, None, 1976.4, "RENEWAL_APPLIED", "2025-01-13 13:44:16"),
    (60856580, "2025-01-12", "2025-07-11", 6, "2025-07-12", "2025-08-11", 1976.4, "RENEWAL_OVERDUE", "2025-07-12 00:14:59"),
    (63282130, "2025-07-12", "2025-08-11", 1, None, None, 439.2, "RENEWAL_APPLIED", "2025-07-31 22:29:18"),
    (64881145, "2025-07-12", "2025-08-11", 1, "2025-08-12", "2025-09-11", 439.2, "RENEWAL_OVERDUE", "2025-08-12 00:18:02"),
    (66996880, "2025-07-12", "2025-08-11", 1, "2025-08-12", "2025-09-11", 439.2, "SETTLEMENT_PAYMENT_SUCCEEDED", "2025-08-29 12:54:05"),
    (66997752, "2025-08-12", "2025-11-11", 3, None, None, 1152.9, "RENEWAL_APPLIED", "2025-08-29 12:59:05"),
    (77714380, "2025-08-12", "2025-11-11", 3, "2025-11-12", "2025-12-11", 1152.9, "RENEWAL_OVERDUE", "2025-11-12 00:24:07"),
    (80030166, "2025-11-12", "2025-12-11", 1, None, None, 439.2, "RENEWAL_APPLIED", "2025-11-24 10:05:53"),
    (82979422, "2025-11-12", "2025-12-11", 1, "2025-12-12", "2026-01-11", 439.2, "RENEWAL_OVERDUE", "2025-12-12 00:25:37"),
    (87777197, "2025-11-12", "2025-12-11", 1, "2026-01-12", "2026-02-11", 439.2, "RENEWAL_OVERDUE", "2026-01-12 00:29:12"),
    (89043905, "2025-11-12", "2025-12-11", 1, "2026-01-12", "2026-02-11", 439.2, "SETTLEMENT_PAYMENT_SUCCEEDED", "2026-01-20 15:41:55"),
    (89044299, "2026-01-12", "2026-04-11", 3, None, None, 1152.9, "RENEWAL_APPLIED", "2026-01-20 15:44:07"),
    (102820848, "2026-01-12", "2026-04-11", 3, "2026-04-12", "2026-05-11", 1152.9, "RENEWAL_OVERDUE", "2026-04-12 00:31:19"),
    (102900034, "2026-04-12", "2026-05-11", 3, None, None, 549.0, "SETTLEMENT_PAYMENT_SUCCEEDED", "2026-04-12 12:05:08"),
    (103455553, "2026-04-12", "2026-05-11", 3, None, None, 549.0, "RETURN_FULFILLMENT_PICKED_UP", "2026-04-15 14:58:35"),
]
# fixed values: number, start, end, months, amount, type, transition id, days
GOLDEN_CYCLES = [
    (1, "2023-03-12", "2023-04-11", 1, 549.0, "TENURE", 635257, 31),
    (2, "2023-04-12", "2023-07-11", 3, 1152.9, "TENURE", 1504507, 91),
    (3, "2023-07-12", "2023-10-11", 3, 1070.55, "TENURE", 4219100, 92),
    (4, "2023-10-12", "2023-11-11", None, 549.0, "PURE_OVERDUE", 8286903, 31),
    (5, "2023-11-12", "2023-12-11", 1, 466.65, "TENURE", 8287087, 30),
    (6, "2024-01-12", "2024-04-11", 3, 988.17, "TENURE", 11137810, 91),
    (7, "2024-04-12", "2024-07-11", 3, 1152.9, "TENURE", 15473861, 91),
    (8, "2024-07-12", "2024-10-11", 3, 1152.9, "TENURE", 23045357, 92),
    (9, "2024-10-12", "2025-01-11", 3, 1152.9, "TENURE", 32930724, 92),
    (10, "2025-01-12", "2025-07-11", 6, 1976.4, "TENURE", 41244216, 181),
    (11, "2025-07-12", "2025-08-11", 1, 439.2, "TENURE", 63282130, 31),
    (12, "2025-08-12", "2025-11-11", 3, 1152.9, "TENURE", 66997752, 92),
    (13, "2025-11-12", "2025-12-11", 1, 439.2, "TENURE", 80030166, 30),
    (14, "2025-12-12", "2026-01-11", None, 549.0, "PURE_OVERDUE", 82979422, 31),
    (15, "2026-01-12", "2026-04-11", 3, 1152.9, "TENURE", 89044299, 90),
    (16, "2026-04-12", "2026-05-11", 3, 549.0, "TENURE", 102900034, 30),
]


def day(text: str | None) -> dt.date | None:
    return dt.date.fromisoformat(text) if text else None


def snapshot(tsd, ted, months=1, ro_start=None, ro_end=None, amount=100.0, base=50.0, **more) -> dict:
    document = {
        "vertical": "RENTAL",
        "state": "ACTIVE",
        "deliveryAddressId": 1,
        "tenureStartDate": tsd,
        "tenureEndDate": ted,
        "tenureInMonths": months,
        "activationDate": "2022-12-12",
        "renewalOverdueCycleStartDate": ro_start,
        "renewalOverdueCycleEndDate": ro_end,
        "paymentDetails": {"payableAfterPaymentOffers": {"byCashPreTax": amount, "byCashPostTax": amount}},
        "currentPricingDetails": {"basePrice": base},
    }
    return {**document, **more}


def transition(id_, entity_id, document, *, kind="ITEM", at="2024-01-01 00:00:00", state="ACTIVE"):
    text = document if isinstance(document, str) or document is None else json.dumps(document)
    return (id_, kind, entity_id, id_, "ACTIVE", state, text, dt.datetime.fromisoformat(at))


def log(spark, rows):
    return spark.createDataFrame(rows, schemas.STATE_TRANSITIONS)


def history_log(spark):
    rows = [
        transition(i, ITEM_ID, snapshot(a, b, m, c, d, amount, 549.0), at=at)
        for i, a, b, m, c, d, amount, _, at in HISTORY
    ]
    return log(spark, rows)


def history_events(spark):
    return spark.createDataFrame([(h[0], h[7]) for h in HISTORY], schemas.EVENTS)


def as_tuples(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]
