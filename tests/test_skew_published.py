"""Heavy-hitter joins, published table versions, rejected values and lines."""
import os

import pytest
from pyspark.sql import functions as F

from ratelens.functions.cleaning import MissingColumns
from ratelens.operators.skew import hot_keys, skew_join
from ratelens.plans import catalog as C
from ratelens.session import scratch_path
from ratelens.sources import published as PB
from ratelens.sources.readers import read_encounters_checked
from conftest import SF_SMALL


@pytest.fixture
def rows(spark):
    """Key 1 holds half of all rows, NULL some, the others a few each."""
    return spark.range(6000).select("id", F.when(F.col("id") % 2 == 0, 1).when(F.col("id") % 50 == 1, None)
                                    .otherwise(F.col("id") % 97 + 2).cast("long").alias("k"))


@pytest.fixture
def partners(spark):
    return spark.createDataFrame([(1, "a"), (1, "b"), (5, "c"), (5, "d"), (None, "n"), (2000, "z")], "k long, v string")


def test_only_hot_keys_are_spread(spark, rows, partners):
    hot = hot_keys(rows, "k", 500)
    assert [(r.k, r["__salts"]) for r in hot.collect()] == [(1, 6)]
    assert hot_keys(rows, "k", 10_000) is None and hot_keys(rows.limit(0), "k", 1) is None
    for how in ("inner", "left"):
        want = rows.join(partners, "k", how).select("id", "k", "v")
        got = skew_join(rows, partners, "k", "id", how, rows_per_task=500).select("id", "k", "v")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    with pytest.raises(ValueError):
        skew_join(rows, partners, "k", "id", "right")


def test_hot_rows_land_in_several_tasks_and_cold_ones_are_not_copied(spark, rows, partners):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = skew_join(rows, partners, "k", "id", rows_per_task=500)
        per_task = joined.where("k = 1").groupBy(F.spark_partition_id()).count().collect()
        assert len(per_task) > 2 and sum(r["count"] for r in per_task) == 6000
        cold = skew_join(rows, partners, "k", "id")
        assert "Generate" not in cold._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def _published(spark):
    root = scratch_path(spark, "published")
    return sorted(os.listdir(root)) if os.path.isdir(root) else []


def test_a_version_is_written_once_and_follows_its_inputs(spark, tmp_path):
    source = str(tmp_path / "source")
    spark.range(100).selectExpr("id", "id % 7 AS k").write.parquet(source)

    def table():
        return PB.publish(spark, "unit", lambda: spark.read.parquet(source), bucket_by="k", buckets=4)
    assert table().count() == 100
    before = _published(spark)
    assert table().count() == 100 and _published(spark) == before and len(PB.published_versions("unit")) == 1
    # another session that shares the folder finds the version and enters it in its catalog
    name = PB.published_versions("unit")[0]
    spark.sql(f"DROP TABLE {name}")
    joined = table().join(table().groupBy("k").count(), "k")
    assert joined.count() == 100 and _published(spark) == before
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:  # and it is still bucketed
        assert "Exchange" not in table().groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.range(50).selectExpr("id", "id % 7 AS k").write.mode("append").parquet(source)
    spark.catalog.refreshByPath(source)
    assert table().count() == 150 and len(PB.published_versions("unit")) == 2
    versions = PB.published_versions("unit")
    assert PB.drop_published(spark, "unit") == 2
    assert not any(spark.catalog.tableExists(v) for v in versions)
    assert not any(v in f for v in versions for f in _published(spark))


def test_the_first_of_two_writers_wins(spark, tmp_path):
    source = str(tmp_path / "source")
    spark.range(10).write.parquet(source)
    seen = []

    def build():
        df = spark.read.parquet(source)
        if not seen:  # another writer publishes while this one builds
            seen.append(1)
            PB.publish(spark, "race", build)
        return df
    assert PB.publish(spark, "race", build).count() == 10
    assert sum("ratelens_race" in f and not f.startswith(".") for f in _published(spark)) == 2  # pointer and data
    assert PB.drop_published(spark, "race") == 1


def test_join_queries_share_one_version(spark):
    C.QUERIES["e05_encounter_util_patients_join"](spark, SF_SMALL).count()
    before = _published(spark)
    tables = len(spark.catalog.listTables())
    for name in ("e05_encounter_util_patients_join", "d19_cohort_listing", "e01_encounter_patient_join"):
        assert C.QUERIES[name](spark, SF_SMALL).count() > 0
    assert _published(spark) == before and len(spark.catalog.listTables()) == tables


@pytest.mark.parametrize("name", ["e01_encounter_patient_join", "e02_encounter_utilization_join",
                                  "e03_three_way_join", "e04_encounter_patients_join",
                                  "e05_encounter_util_patients_join", "d19_cohort_listing"])
def test_no_side_of_a_table_join_is_broadcast(spark, name):
    # a row per encounter or patient: a small size estimate must not send it through the driver
    plan = C.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_rejected_values_and_lines(spark, tmp_path):
    full = C.raw(spark, SF_SMALL).limit(4).toPandas()
    columns = list(full.columns)[::-1] + ["note"]
    full["note"] = "n"
    lines = [",".join(columns)]
    for i, row in enumerate(full.astype(str).to_dict("records")):
        row["encounter_id"] = str(100 + i)
        if i == 0:
            row["num_medications"] = "2.5"
        if i == 1:
            row.update(num_medications="lots", admission_type_id="1.5", number_emergency="?")
        if i == 2:
            row["patient_nbr"] = "?"
        lines.append(",".join(f'"{row[c]}"' for c in columns))
    lines += ['"too","few"', lines[4] + ',"one more"']
    path = tmp_path / "e.csv"
    path.write_text("\n".join(lines) + "\n")
    rows, rejected = read_encounters_checked(spark, str(path))
    got = {r.encounter_id: r for r in rows.collect()}
    assert sorted(got) == [100, 101, 102, 103] and got[100].note == "n" and got[101].admission_type_id is None
    found = sorted((r.line, r.column, r.value, r.reason) for r in rejected.where("column IS NOT NULL").collect())
    assert found == [("101", "admission_type_id", "1.5", "type"), ("101", "num_medications", "lots", "number")]
    bad = rejected.where("column IS NULL").collect()
    assert sorted(r.line for r in bad) == sorted(lines[5:]) and {r.reason for r in bad} == {"line"}
    assert all(r.file.endswith("e.csv") for r in bad)
    # a pruned read judges lines alike
    assert rows.select("encounter_id").count() == 4 and rejected.select("reason").count() == 4
    (tmp_path / "short.csv").write_text("encounter_id,race\n1,x\n")
    with pytest.raises(MissingColumns):
        read_encounters_checked(spark, str(tmp_path / "short.csv"))
