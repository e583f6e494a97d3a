import importlib.util
import os

from pyspark.sql import functions as F

from conftest import SF_SMALL

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_contract(spark):
    mod = _entry_module()
    df = mod.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and df.columns == ["risk_score", "readmission_rate", "patient_count"]
    assert set(mod.oracle_sql()) <= set(mod.queries())


def test_csv_read_with_schema_and_clean(spark, tmp_path):
    from ratelens.plans.catalog import raw
    from ratelens.sources.readers import load_encounters
    path = str(tmp_path / "csv")
    raw(spark, SF_SMALL).write.option("header", True).csv(path)
    loaded = load_encounters(spark, path)
    expected = load_encounters(spark, sf_dir=SF_SMALL)
    # same names; counts read from text are double, as they may hold fractions
    assert loaded.columns == expected.columns
    loaded = loaded.select(*[F.col(f.name).cast(f.dataType) for f in expected.schema])
    assert loaded.exceptAll(expected).count() == 0 and expected.exceptAll(loaded).count() == 0


def test_bucketed_tables_join_without_shuffle(spark):
    from ratelens.operators import tables as T
    from ratelens.plans.catalog import clean
    from ratelens.sources.readers import read_saved, save_table
    c = clean(spark, SF_SMALL)
    save_table(T.encounter_fact(c), "rl_encounters", bucket_by="encounter_id", buckets=8)
    save_table(T.utilization_fact(c), "rl_utilization", bucket_by="encounter_id", buckets=8)
    joined = T.join_on_encounter(read_saved(spark, "rl_encounters"), read_saved(spark, "rl_utilization"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert joined.count() == c.count()


def test_sql_text_over_registered_tables(spark):
    """A-8: SQL over the registered views sees the cleaned rows."""
    from ratelens.operators.rates import event_rate
    from ratelens.plans.catalog import clean
    from ratelens.sources.readers import register_encounter_tables
    c = clean(spark, SF_SMALL)
    assert register_encounter_tables(c, prefix="t_") == [
        "t_patients", "t_patient_table", "t_encounters", "t_utilization"]
    asked = spark.sql("SELECT gender, avg(if(readmitted = '<30', 1, 0)) AS share, count(1) AS n "
                      "FROM t_patients WHERE weight IS NOT NULL GROUP BY gender")
    direct = event_rate(c.filter("weight IS NOT NULL"), ["gender"], count_name="n",
                        rate_name="share")
    assert sorted(map(tuple, asked.collect())) == sorted(map(tuple, direct.collect()))
    assert spark.table("t_encounters").count() == spark.table("t_utilization").count() == c.count()


def test_materialize_writes_and_drops(spark):
    import os
    from ratelens.session import _WRITTEN, drop_materialized, materialize
    df = spark.range(100).withColumn("y", F.col("id") % 3)
    m = materialize(df)
    path = _WRITTEN[-1]
    assert m.count() == 100 and os.path.isdir(path.replace("file:", ""))
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in plan  # lineage cut: reads the written files
    assert drop_materialized(spark) >= 1
    assert not os.path.exists(path.replace("file:", ""))


def test_checkpoint_root_fallback_without_setting():
    """With no spark.checkpoint.dir and no context folder, a scratch folder is
    created once, registered with the context, and the conf is left alone."""
    from ratelens.session import checkpoint_root

    class Ctx:
        master = "local[2]"

        def __init__(self):
            self.dir = None

        def getCheckpointDir(self):
            return self.dir

        def setCheckpointDir(self, d):
            self.dir = d

    class Conf:
        def get(self, key, default=None):
            return default

        def set(self, key, value):
            raise AssertionError("spark.checkpoint.dir cannot be set at runtime")

    class Session:
        sparkContext = Ctx()
        conf = Conf()

    s = Session()
    root = checkpoint_root(s)
    assert os.path.isdir(root) and s.sparkContext.dir == root
    assert checkpoint_root(s) == root


def test_checkpoint_root_raises_off_one_machine():
    import pytest
    from ratelens.session import checkpoint_root

    class Ctx:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Ctx()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(Session())


def test_get_session_keeps_the_running_session(spark):
    from ratelens.session import get_session
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert get_session().conf.get("spark.sql.session.timeZone") == "America/New_York"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


CSV_HEAD = ("encounter_id,patient_nbr,race,gender,age,weight,time_in_hospital,num_medications,"
            "number_outpatient,number_inpatient,number_emergency,number_diagnoses,insulin,metformin,"
            "chlorpropamide,repaglinide,nateglinide,glimepiride,glipizide,glyburide,pioglitazone,"
            "rosiglitazone,acarbose,admission_type_id,discharge_disposition_id,payer_code,"
            "medical_specialty,readmitted").split(",")
CSV_ROW = dict(zip(CSV_HEAD, "7,70,Asian,Male,[0-10),?,3,2.5,10000000000,?,1,9,No,No,No,No,No,No,"
                             "No,No,No,No,No,1,6,MC,?,<30".replace("[0-10)", "[0-10)").split(",")))


def _csv(tmp_path, columns):
    path = tmp_path / "in.csv"
    row = CSV_ROW | {"extra": "x"}
    path.write_text(",".join(columns) + "\n" + ",".join(row[c] for c in columns) + "\n")
    return str(path)


def test_csv_by_header_name(spark, tmp_path):
    """An extra column and another order: columns are taken by name."""
    from ratelens.sources.readers import load_encounters
    columns = ["extra"] + CSV_HEAD[::-1]
    got = load_encounters(spark, _csv(tmp_path, columns)).collect()[0].asDict()
    assert got["encounter_id"] == 7 and got["patient_nbr"] == 70 and got["extra"] == "x"
    assert got["num_medications"] == 2.5 and got["number_outpatient"] == 1e10
    assert got["number_inpatient"] is None and got["weight"] is None
    assert got["discharge_disposition_id"] == 6 and got["readmitted"] == "<30"


def test_csv_missing_column_raises(spark, tmp_path):
    import pytest
    from ratelens.functions.cleaning import MissingColumns
    from ratelens.sources.readers import read_encounters
    with pytest.raises(MissingColumns, match="race"):
        read_encounters(spark, _csv(tmp_path, [c for c in CSV_HEAD if c != "race"]))


def test_partial_stored_table_raises(spark, tmp_path):
    import pytest
    from ratelens.plans.catalog import QUERIES
    from ratelens.sources.fixture import STORED, store_encounters
    path = str(tmp_path / "stored")
    name = store_encounters(spark, SF_SMALL, path)
    assert QUERIES["b08_total_count"](spark, name).first()[0] == \
        QUERIES["b08_total_count"](spark, SF_SMALL).first()[0]
    os.remove(os.path.join(path, "_SUCCESS"))
    with pytest.raises(RuntimeError, match="not a completely written"):
        QUERIES["b09_avg_los"](spark, STORED + path + "/")


def test_written_copy_joins_without_shuffle(spark):
    """E-2 on the bucketed copy: no Exchange in the join."""
    from ratelens.plans.catalog import QUERIES
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("e02_encounter_utilization_join", "e04_encounter_patients_join",
                     "e05_encounter_util_patients_join"):
            plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan, name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_many_customers_are_not_broadcast_to_their_orders(spark, monkeypatch):
    """The size estimate of a compressed customer table is far below its rows."""
    from ratelens.sources import fixture
    from ratelens.sources.tables import checked_broadcast

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(fixture, "FEW_CUSTOMERS", 10)
    rows = fixture.derive_encounters(spark, SF_SMALL)
    assert "SortMergeJoin [o_custkey" in plan(rows) and "BroadcastHashJoin [o_custkey" not in plan(rows)
    few = spark.createDataFrame([(i, str(i)) for i in range(20)], "k long, v string")
    assert "BroadcastHashJoin" in plan(few.join(checked_broadcast(few.withColumnRenamed("v", "w"), 20), "k"))
    assert "SortMergeJoin" in plan(few.join(checked_broadcast(few.withColumnRenamed("v", "w"), 19), "k"))
