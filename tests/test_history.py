from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from billcycle import schemas
from billcycle.operators import base, history
from tests.samples import ITEM_ID, as_tuples, day, history_events, history_log, log, snapshot, transition


def test_final_state_history_of_the_sample(spark):
    rows = history.final_state_history(
        history_log(spark), history_events(spark), entity_types=["item"], entity_ids=[ITEM_ID], ordered=True, vertical="RENTAL").collect()
    assert len(rows) == 18  # 20 renewals, two overdue rows give way to the renewal of the same cycle
    assert [r.state_transition_id for r in rows] == sorted(r.state_transition_id for r in rows)
    assert {r.event_name for r in rows} == {"RENEWAL_APPLIED", "RENEWAL_OVERDUE"}
    assert rows[0].transition_created_at.isoformat() == "2023-03-14T00:55:27"  # +330 minutes


def test_entity_type_is_compared_without_case(spark):
    for kind in ("item", "ITEM"):
        found = history.final_state_history(history_log(spark), history_events(spark), entity_types=[kind], vertical="RENTAL")
        assert found.count() == 18
    none = history.final_state_history(history_log(spark), history_events(spark), entity_types=["attachment"], vertical="RENTAL")
    assert none.count() == 0


def named(spark, rows, names):
    events = spark.createDataFrame([(r[0], n) for r, n in zip(rows, names)], schemas.EVENTS)
    return base.billing_transitions(log(spark, rows), events, vertical="RENTAL")


def test_dedup_keeps_other_events_and_breaks_ties_by_id(spark):
    cycle = ("2024-01-01", "2024-01-31")
    rows = [
        transition(5, 1, snapshot(*cycle)),
        transition(4, 1, snapshot(*cycle)),
        transition(3, 1, snapshot(*cycle)),
        transition(2, 1, snapshot(*cycle)),
        transition(1, 1, snapshot(*cycle)),
        transition(6, 1, snapshot(*cycle), kind="ATTACHMENT"),
        transition(7, 1, snapshot("2024-02-01", None)),
        transition(8, 1, snapshot("2024-02-01", None)),
        transition(9, 1, snapshot(*cycle, activationDate=None)),
        transition(10, 1, snapshot(*cycle, vertical="FURNITURE")),
    ]
    names = ["RENEWAL_APPLIED", "RENEWAL_APPLIED", "RENEWAL_OVERDUE", "ORDER_SHIPMENT_DELIVERED",
             "ORDER_SHIPMENT_DELIVERED", "RENEWAL_OVERDUE", "RENEWAL_OVERDUE", "RENEWAL_OVERDUE",
             "RENEWAL_APPLIED", "RENEWAL_APPLIED"]
    kept = history.renewal_dedup(history.effective_tenure(named(spark, rows, names)))
    # 4 beats 5 (lower id) and 3 (overdue); 1 and 2 pass; the attachment has its own key; NULL ends are one cycle
    assert sorted(r.state_transition_id for r in kept.collect()) == [1, 2, 4, 6, 7]

    # carried as codes: the same rows, every column of them
    known = {"event_name": schemas.HISTORY_EVENTS, "from_state": ["ACTIVE", "NEW"], "to_state": ["ACTIVE", "NEW"]}
    told = history.effective_tenure(named(spark, rows, names)).withColumns(
        {
            "from_state": F.expr("case state_transition_id % 3 when 0 then 'NEW' when 1 then 'ACTIVE' end"),
            "to_state": F.lit("ACTIVE"),
            "state_transition_id": F.expr("case when state_transition_id <> 8 then state_transition_id end"),
        }
    )
    plain = history.renewal_dedup(told)
    coded = history.renewal_dedup(told, known=known)
    assert coded.schema.simpleString() == plain.schema.simpleString()
    assert sorted(map(repr, coded.collect())) == sorted(map(repr, plain.collect()))
    assert {r.state_transition_id for r in coded.collect()} == {1, 2, 4, 6, None}


def test_an_unknown_state_is_refused(spark):
    arguments = dict(entity_types=["item"], vertical="RENTAL")
    plain = history.final_state_history(history_log(spark), history_events(spark), **arguments)
    states = sorted({s for r in plain.collect() for s in (r.from_state, r.to_state) if s is not None})
    coded = history.final_state_history(history_log(spark), history_events(spark), states=states, **arguments)
    assert sorted(map(repr, coded.collect())) == sorted(map(repr, plain.collect()))
    short = history.final_state_history(history_log(spark), history_events(spark), states=states[1:], **arguments)
    with pytest.raises(PySparkException, match="a value other than"):
        short.collect()


def test_effective_tenure_amounts(spark):
    rows = [
        transition(1, 1, snapshot("2024-01-01", "2024-01-31", ro_start="2024-02-01", ro_end="2024-02-29", amount=10.0, base=7.0)),
        transition(2, 1, snapshot("2024-01-01", "2024-01-31", amount=10.0, base=None)),
        transition(3, 1, snapshot("2024-01-01", "2024-01-31", amount=10.0, base=7.0)),
    ]
    found = history.effective_tenure(named(spark, rows, ["RENEWAL_OVERDUE", "RENEWAL_OVERDUE", "RENEWAL_APPLIED"]))
    assert sorted(as_tuples(found, "state_transition_id", "effective_tenure_start", "pre_tax_amount")) == [
        (1, day("2024-02-01"), 7.0),
        (2, day("2024-01-01"), 10.0),
        (3, day("2024-01-01"), 10.0),
    ]


def test_state_event_history_uses_the_shorter_list(spark):
    rows = [transition(i, 1, snapshot("2024-01-01", "2024-01-31")) for i in (1, 2, 3)]
    events = spark.createDataFrame(
        [(1, "SWAP_SHIPMENT_DELIVERED"), (2, "RENEWAL_OVERDUE"), (3, "RENEWAL_OVERDUE")], schemas.EVENTS
    )
    found = history.state_event_history(log(spark, rows), events, entity_ids=[1], ordered=True, vertical="RENTAL")
    assert [r.state_transition_id for r in found.collect()] == [2, 3]  # nothing is de-duplicated here
