"""The maintained timeline against a full rebuild, after appends of every kind."""

from __future__ import annotations

import random

import pytest

from billcycle.operators import cycles
from billcycle.plans import maintained
from tests.samples import log, snapshot, transition
from tests.test_plans import plan_of, pushed

MONTHS = ("2024-01", "2024-02", "2024-04")


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def rebuilt(spark, rows, months=MONTHS, bounded=False):
    timeline = cycles.billing_timeline(cycles.snapshot_extract(log(spark, rows), vertical="RENTAL"))
    cut = cycles.with_realised_revenue(cycles.month_snapshots(timeline, months, bounded=bounded))
    return rows_of(timeline), rows_of(cut)


def kept(spark, path, months=None):
    return rows_of(maintained.read_timeline(spark, path)), rows_of(maintained.read_months(spark, path, months))


def random_rows(seed, first, n):
    pick = random.Random(seed)
    dates = ["2024-01-01", "2024-01-20", "2024-02-01", "2024-03-01", "2024-04-15", None]
    found = []
    for i in range(first, first + n):
        start, end, over = pick.choice(dates), pick.choice(dates), pick.choice([None, *dates])
        vertical = pick.choice(["RENTAL", "RENTAL", "RENTAL", "FURNITURE"])
        document = snapshot(start, end, ro_start=over, ro_end=over and pick.choice(dates), amount=float(i), vertical=vertical)
        entity = pick.choice([1, 1, 1, 2, 3, 4 + i % 5, None])  # a third and more under one entity
        found.append(transition(i, entity, document, kind=pick.choice(["ITEM", "ITEM", "ATTACHMENT"])))
    return found


@pytest.mark.parametrize("bounded", [False, True])
def test_random_appends_equal_a_rebuild(spark, tmp_path, bounded):
    path, rows = str(tmp_path / "kept"), []
    for seed, n in enumerate((40, 0, 1, 15)):
        rows += random_rows(seed, len(rows) + 1, n)
        done = maintained.update_timeline(spark, log(spark, rows), path, months=MONTHS, vertical="RENTAL", bounded=bounded)
        assert done.mark == len(rows)
        assert kept(spark, path) == rebuilt(spark, rows, bounded=bounded)
    before = kept(spark, path)
    folded = maintained.compact(spark, path)
    assert folded.first_run == folded.run and kept(spark, path) == before
    rows += random_rows(9, len(rows) + 1, 5)
    maintained.update_timeline(spark, log(spark, rows), path, vertical="RENTAL", bounded=bounded)
    assert kept(spark, path) == rebuilt(spark, rows, bounded=bounded)


def update(spark, rows, path, **options):
    return maintained.update_timeline(spark, log(spark, rows), path, **{"vertical": "RENTAL", "bounded": True, **options})


def test_only_months_that_differ_are_written_again(spark, tmp_path):
    path = str(tmp_path / "kept")
    rows = [
        transition(1, 1, snapshot("2024-01-01", "2024-01-31")),
        transition(2, 2, snapshot("2024-01-01", "2024-01-31", ro_start="2024-02-01", ro_end="2024-02-20")),
        transition(3, 3, snapshot("2024-04-01", "2024-04-30")),
    ]
    assert set(update(spark, rows, path, months=MONTHS).months.values()) == {1}
    # the tenure absorbs the only cycle of February, in which it has no day left
    rows.append(transition(4, 2, snapshot("2024-02-01", "2024-01-31")))
    done = update(spark, rows, path)
    assert {str(m): run for m, run in done.months.items()} == {"2024-01-01": 1, "2024-02-01": 2, "2024-04-01": 1}
    assert kept(spark, path) == rebuilt(spark, rows, bounded=True)
    assert maintained.read_months(spark, path, ["2024-02"]).count() == 0
    # the same cycle said again by a later transition changes no month
    rows.append(transition(5, 1, snapshot("2024-01-01", "2024-01-31", amount=7.0)))
    assert update(spark, rows, path).months == done.months
    # a month asked for later is built from the candidates of all entities
    update(spark, rows, path, months=["2023-12", "2024-03"])
    months = (*MONTHS, "2023-12", "2024-03")
    assert kept(spark, path) == rebuilt(spark, rows, months, bounded=True)
    # nothing new: no run
    assert update(spark, rows, path).run == maintained.last_run(spark, path).run == 4


def test_a_run_that_fails_leaves_the_former_state(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "kept"), random_rows(1, 1, 20)
    update(spark, rows, path, months=MONTHS)
    before = kept(spark, path)
    rows += random_rows(2, 21, 10)

    def lost(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as patched:
        patched.setattr(maintained, "_finish", lost)
        with pytest.raises(RuntimeError):
            update(spark, rows, path)
    assert kept(spark, path) == before
    rows += random_rows(3, 31, 10)
    update(spark, rows, path)
    assert kept(spark, path) == rebuilt(spark, rows, bounded=True)


def test_late_transitions_need_an_overlap(spark, tmp_path):
    path, rows = str(tmp_path / "kept"), random_rows(4, 1, 30)
    late, on_time = rows[20:24], rows[:20] + rows[24:]
    update(spark, on_time, path, months=MONTHS)
    assert update(spark, on_time + late, path).run == 1  # below the mark
    update(spark, on_time + late, path, overlap=10)
    assert kept(spark, path) == rebuilt(spark, rows, bounded=True)


def test_empty_log_and_other_scopes(spark, tmp_path):
    path = str(tmp_path / "kept")
    with pytest.raises(ValueError):
        maintained.read_timeline(spark, path)
    assert update(spark, [], path, months=MONTHS).mark is None
    assert kept(spark, path) == ([], [])
    with pytest.raises(ValueError):
        update(spark, [], path, vertical="FURNITURE")
    with pytest.raises(ValueError):
        maintained.read_months(spark, path, ["2025-01"])
    rows = random_rows(5, 1, 12)
    update(spark, rows, path)
    assert kept(spark, path) == rebuilt(spark, rows, bounded=True)


def test_the_log_is_pruned_by_the_mark(spark, tmp_path, monkeypatch):
    path, stored, rows = str(tmp_path / "kept"), str(tmp_path / "log"), random_rows(6, 1, 20)
    log(spark, rows).write.parquet(stored)
    update(spark, rows[:15], path)
    seen = []
    extract = cycles.snapshot_extract

    def watched(part, **options):
        seen.append(extract(part, **options))
        return seen[-1]

    monkeypatch.setattr(cycles, "snapshot_extract", watched)
    maintained.update_timeline(spark, spark.read.parquet(stored), path, vertical="RENTAL", bounded=True)
    assert "GreaterThan(id,15)" in pushed(plan_of(seen[0])) and "LessThanOrEqual(id,20)" in pushed(plan_of(seen[0]))
