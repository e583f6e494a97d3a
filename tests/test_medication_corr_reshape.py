import math

import numpy as np
from pyspark.sql import functions as F

from ratelens.operators.correlation import correlation_matrix
from ratelens.operators.medication import dose_status_matrix, medication_impact, unpivot_medications
from ratelens.operators.reshape import kpi_long, pivot_table
from ratelens.operators.rates import kpi_summary


def test_medication_impact_min_n_and_missing_counts_as_prescribed(spark):
    rows = [("Steady", "No", "<30")] * 49 + [("No", "Up", "NO")] * 10 + [(None, None, "NO")]
    df = spark.createDataFrame(rows, "a string, b string, readmitted string")
    out = {r.medication: r for r in medication_impact(df, ["a", "b"], min_n=50).collect()}
    # a: 49 Steady + 1 missing = 50 prescribed -> kept; b: 10 Up + 1 missing -> skipped
    assert set(out) == {"a"}
    assert out["a"].n == 50 and out["a"].prescribed_pct == 98.0
    assert out["a"].not_prescribed_pct == 0.0 and out["a"].diff == 98.0


def test_dose_matrix_cells_and_threshold(spark):
    rows = [("Up", "<30")] * 31 + [("Down", "NO")] * 30
    df = spark.createDataFrame(rows, "m string, readmitted string")
    r = dose_status_matrix(df, ["m"]).first()
    assert r.Up == 100.0 and r.Down is None and r.No is None and r.Steady is None


def test_unpivot(spark):
    df = spark.createDataFrame([(1, "No", "Up")], "encounter_id long, a string, b string")
    got = sorted(tuple(r) for r in unpivot_medications(df, ["encounter_id"], ["a", "b"]).collect())
    assert got == [(1, "a", "No"), (1, "b", "Up")]


def test_correlation_constant_column_and_numpy(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=200), rng.normal(size=200)
    rows = [(float(a), float(a + b), 1.0) for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, "x double, y double, c double")
    out = {(r.var_x, r.var_y): r.r for r in correlation_matrix(df, ["x", "y", "c"], digits=None).collect()}
    assert math.isclose(out[("x", "y")], np.corrcoef(x, x + y)[0, 1], rel_tol=1e-9)
    assert out[("c", "x")] is None and out[("c", "c")] is None
    assert math.isclose(out[("x", "x")], 1.0, rel_tol=1e-12)


def test_correlation_pairwise_complete(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None), (None, 1.0), (4.0, 8.5)],
                               "x double, y double")
    out = {(r.var_x, r.var_y): r.r for r in correlation_matrix(df, ["x", "y"], digits=None).collect()}
    xs, ys = [1.0, 2.0, 4.0], [2.0, 4.0, 8.5]
    assert math.isclose(out[("x", "y")], np.corrcoef(xs, ys)[0, 1], rel_tol=1e-9)


def test_pivot_absent_category_and_row_domain(spark):
    long = spark.createDataFrame(
        [("[50-75)", "High Risk", 10.0), ("[0-25)", "High Risk", 5.0), ("[200-225)", "High Risk", 1.0)],
        "weight string, risk_group string, pct double")
    from ratelens.constants import WEIGHT_ORDER
    out = pivot_table(long, "weight", "risk_group", "pct", ["High Risk", "Standard Risk"],
                      row_domain=WEIGHT_ORDER)
    assert out.columns == ["weight", "High Risk", "Standard Risk"]
    assert [tuple(r) for r in out.collect()] == [("[0-25)", 5.0, None), ("[50-75)", 10.0, None)]
    dropped = pivot_table(long.withColumn("pct", F.lit(None).cast("double")), "weight",
                          "risk_group", "pct", ["High Risk"], drop_empty=True)
    assert dropped.count() == 0


def test_kpi_formatting(spark):
    rows = [(i, "<30" if i < 2 else "NO", 4, 10, 0, 0, 0) for i in range(1234)]
    df = spark.createDataFrame(rows, "encounter_id long, readmitted string, time_in_hospital int, "
                                     "num_medications int, number_outpatient int, number_inpatient int, "
                                     "number_emergency int")
    got = {r.KPI: r.Value for r in kpi_long(kpi_summary(df)).collect()}
    assert got["Total Encounters"] == "1,234"
    assert got["Readmission Rate"] == "0.2%"
    assert got["Avg Length of Stay (days)"] == "4.0"
