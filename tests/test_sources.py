from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from billcycle import schemas
from billcycle.functions.dates import month_bounds
from billcycle.sources import dimensions, tables
from tests.samples import as_tuples, day


LINES = "id,amount,day\n1,2.5,2024-01-01\n2,abc,2024-01-02\n3,1.0\n4,1.0,2024-01-04,more\n5,1.0,2024-13-45\n6,null,null\n"
AMOUNTS = "id long, amount double, day date"


def test_csv_lines_that_do_not_fit_are_set_apart(spark, tmp_path):
    path = tmp_path / "export.csv"
    path.write_text(LINES)
    good, rejected = tables.split_csv_export(spark, str(path), AMOUNTS, null_text="null")
    assert as_tuples(good, "id", "amount", "day") == [(1, 2.5, day("2024-01-01")), (6, None, None)]
    assert good.select("id").count() == good.count() == 2
    assert sorted(as_tuples(rejected, "line", "reason")) == [
        ("2,abc,2024-01-02", "amount"),
        ("3,1.0", "number of fields"),
        ("4,1.0,2024-01-04,more", "number of fields"),
        ("5,1.0,2024-13-45", "day"),
    ]
    assert rejected.count() == 4


@pytest.mark.parametrize("line", LINES.splitlines()[2:6])
def test_a_csv_line_that_does_not_fit_fails(spark, tmp_path, line):
    path = tmp_path / "export.csv"
    path.write_text(f"id,amount,day\n1,2.5,2024-01-01\n{line}\n")
    with pytest.raises(Exception, match="does not fit"):
        tables.read_csv_export(spark, str(path), AMOUNTS).select("id").collect()


def test_a_csv_header_in_another_order_fails(spark, tmp_path):
    (tmp_path / "export.csv").write_text("amount,id,day\n1.0,7,2024-01-01\n")
    for read in (tables.read_csv_export, lambda *a: tables.split_csv_export(*a)[0]):
        with pytest.raises(Exception, match="(?i)header"):
            read(spark, str(tmp_path / "export.csv"), AMOUNTS).collect()


def test_csv_exports_spell_null_differently(spark, tmp_path):
    head = "event_name,from_state,to_state,tsd,ted,ctd,ro_start_date,ro_end_date,se_name\n"
    word, empty = tmp_path / "word.csv", tmp_path / "empty.csv"
    word.write_text(head + "RENEWAL_APPLIED,A,B,2024-01-01,2024-01-31,2024-01-31,null,null,null\n")
    empty.write_text(head + "RENEWAL_APPLIED,A,B,2024-01-01,2024-01-31,2024-01-31,,,\n")
    for path, null_text in ((word, "null"), (empty, "")):
        row = tables.read_csv_export(spark, str(path), schemas.SIDE_EFFECT_EXPORT, null_text=null_text).first()
        assert (row.tsd, row.ro_start_date, row.se_name) == (day("2024-01-01"), None, None)


def test_side_effect_export_has_an_event_once(spark, tmp_path):
    head = "event_name,from_state,to_state,tsd,ted,ctd,ro_start_date,ro_end_date,se_name\n"
    line = "RENTAL_PRODUCT_OVERDUE,ACTIVE,RENEWAL_OVERDUE,2024-01-01,2024-01-31,2024-01-31,2024-02-01,2024-02-29,"
    (tmp_path / "effects.csv").write_text(head + line + "ONE\n" + line + "TWO\n")
    export = tables.read_csv_export(spark, str(tmp_path / "effects.csv"), schemas.SIDE_EFFECT_EXPORT)
    assert export.count() == 2 and export.drop("se_name").distinct().count() == 1


def test_load_by_name_and_path(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    assert tables.load(spark, str(tmp_path / "t")).count() == 3
    spark.range(4).createOrReplaceTempView("four_rows")
    assert tables.load(spark, "four_rows").count() == 4


def test_sink_replaces_only_its_months(spark, tmp_path):
    path = str(tmp_path / "sink-test")
    feb, mar = dt.date(2024, 2, 1), dt.date(2024, 3, 1)

    def month(first, n):
        return spark.range(n).withColumn("snapshot_month", F.lit(first))

    tables.write_month_snapshots(month(feb, 5).unionByName(month(mar, 7)), path)
    tables.write_month_snapshots(month(mar, 2), path)
    assert tables.read_month_snapshot(spark, path, feb).count() == 5
    again = tables.read_month_snapshot(spark, path, "2024-03")
    assert again.count() == 2 and again.columns == ["id"]
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "snapshot_month" in plan.split("PartitionFilters: [")[1].split("]")[0]


@pytest.mark.parametrize("mode", ["static", "dynamic"])
def test_bucketed_months(spark, tmp_path, mode):
    """Only the written month is replaced, also in the mode that replaces all; another session finds what is there."""
    path, name = str(tmp_path / "it's here"), f"bucketed_{mode}"
    rows = spark.range(600).selectExpr("if(id % 3 = 0, 7, if(id % 5 = 0, null, id)) as entity_id", "id as v")
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
    try:
        tables.create_month_table(spark, name, path, rows.schema, buckets=4)
        tables.write_month(rows, name, "2024-02")
        tables.write_month(rows.where("v < 100").select("v", "entity_id"), name, "2024-03")
        tables.write_month(rows.where("v < 50").withColumn("more", F.lit(1)), name, dt.date(2024, 3, 9))
        tables.create_month_table(spark, f"{name}_again", path, rows.schema, buckets=4)
        for table in (name, f"{name}_again"):
            months = {m: tables.read_month_snapshot(spark, table, m) for m in ("2024-02", "2024-03")}
            assert sorted(map(repr, months["2024-02"].collect())) == sorted(map(repr, rows.collect()))
            assert sorted(map(repr, months["2024-03"].collect())) == sorted(map(repr, rows.where("v < 50").collect()))
        # an empty snapshot empties its month
        tables.write_month(rows.where("false"), name, "2024-03")
        assert spark.table(name).groupBy("snapshot_month").count().collect() == [(dt.date(2024, 2, 1), 600)]
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
        for table in (name, f"{name}_again"):
            spark.sql(f"DROP TABLE IF EXISTS {table}")


def test_dimensions(spark):
    assert dimensions.dim_city(spark).count() == 9
    named = dimensions.dim_city(spark, ["Noida", "Pune", "Atlantis"])
    assert sorted(as_tuples(named, "city_id", "city_name")) == [(6, "Noida"), (9, "Pune")]
    assert dimensions.city_ids(["Noida", "Pune"]) == [6, 9]
    facts = spark.createDataFrame([(6,), (3,)], "city_id int")
    assert sorted(as_tuples(dimensions.with_city_name(facts), "city_id", "city_name")) == [(3, None), (6, "Noida")]
    assert dimensions.dim_tenure_bucket(spark).count() == 4


def test_month_spine(spark):
    rows = [tuple(r) for r in dimensions.month_spine(spark, "2024-03-15", 15).collect()]
    assert rows[0] == ("2024-03", day("2024-03-01"), day("2024-04-01"), day("2024-03-31"))
    assert rows[1] == ("2024-02", day("2024-02-01"), day("2024-03-01"), day("2024-02-29"))
    assert rows[-1][0] == "2023-01" and len(rows) == 15


@pytest.mark.parametrize(
    "month, bounds",
    [("2024-12", ("2024-12-01", "2025-01-01", "2024-12-31")), ("2023-02", ("2023-02-01", "2023-03-01", "2023-02-28"))],
)
def test_month_bounds(month, bounds):
    assert month_bounds(month) == tuple(map(day, bounds))
