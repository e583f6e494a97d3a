import pytest
from ratelens.functions import flags as D
from ratelens.functions.cleaning import check_columns, clean_encounters


def _row(**kw):
    base = dict(readmitted="NO", time_in_hospital=1, num_medications=1, number_outpatient=0,
                number_inpatient=0, number_emergency=0, age="[50-60)", weight=None)
    base.update(kw)
    return base


SCHEMA = ("readmitted string, time_in_hospital int, num_medications int, number_outpatient int, "
          "number_inpatient int, number_emergency int, age string, weight string")


def _df(spark, rows):
    cols = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], SCHEMA)


def test_null_inputs_give_zero_flags(spark):
    rows = [_row(readmitted=None), _row(time_in_hospital=None), _row(num_medications=None),
            _row(number_emergency=None), _row(age=None)]
    out = D.engineer_features(_df(spark, rows)).collect()
    for r in out:
        for c in ("readmitted_flag", "long_stay", "high_med_burden", "high_utilizer",
                  "age_risk", "risk_score", "risk_score_v2"):
            assert r[c] is not None
    assert [r.long_stay for r in out] == [0, 0, 0, 0, 0]
    assert out[3].high_utilizer == 0


def test_threshold_bounds(spark):
    rows = [_row(time_in_hospital=t, num_medications=m, number_outpatient=v)
            for t, m, v in [(3, 10, 2), (4, 11, 3), (6, 14, 2), (7, 15, 3), (8, 15, 3)]]
    df = _df(spark, rows).select(
        D.long_stay().alias("ls"), D.high_med_burden().alias("hb"), D.high_utilizer().alias("hu"),
        D.los_category().alias("lc"), D.high_meds().alias("hm"), D.med_group().alias("mg"))
    got = [tuple(r) for r in df.collect()]
    assert got == [
        (0, 0, 0, "Short (<=3d)", 0, "Low Meds (<=10)"),
        (0, 0, 1, "Medium (4-7d)", 1, "High Meds (>10)"),
        (0, 0, 0, "Medium (4-7d)", 1, "High Meds (>10)"),
        (1, 1, 1, "Medium (4-7d)", 1, "High Meds (>10)"),
        (1, 1, 1, "Long (>7d)", 1, "High Meds (>10)"),
    ]


def test_two_and_three_column_utilizer(spark):
    df = _df(spark, [_row(number_outpatient=1, number_inpatient=1, number_emergency=1)])
    r = df.select(D.high_utilizer().alias("u3"),
                  D.high_utilizer(columns=("number_outpatient", "number_inpatient")).alias("u2")).first()
    assert (r.u3, r.u2) == (1, 0)


def test_age_risk_and_scores(spark):
    rows = [_row(age="[20-30)", time_in_hospital=7, num_medications=15, number_inpatient=3),
            _row(age="[30-40)")]
    out = D.engineer_features(_df(spark, rows)).collect()
    assert (out[0].risk_score, out[0].risk_score_v2, out[0].age_risk) == (3, 4, 1)
    assert (out[1].risk_score, out[1].risk_score_v2) == (0, 0)


def test_risk_group_and_null_stay_falls_to_long(spark):
    df = _df(spark, [_row(time_in_hospital=None, num_medications=None)])
    r = df.select(D.los_category().alias("lc"), D.med_group().alias("mg"),
                  D.risk_group().alias("rg")).first()
    assert (r.lc, r.mg, r.rg) == ("Long (>7d)", "Low Meds (<=10)", "Standard Risk")


def test_bracket_order_outside_domain_is_null(spark):
    from ratelens.constants import WEIGHT_ORDER
    df = spark.createDataFrame([("[0-25)",), (">200",), ("[200-225)",), (None,)], "weight string")
    got = [r[0] for r in df.select(D.bracket_order("weight", WEIGHT_ORDER)).collect()]
    assert got == [1, 9, None, None]


def test_missing_column_raises(spark):
    df = spark.createDataFrame([(1, 1)], "long_stay int, high_med_burden int")
    with pytest.raises(ValueError, match="high_utilizer"):
        D.risk_score_v1(df)
    with pytest.raises(ValueError):
        check_columns("caller", df, "nope")


def test_engineer_keeps_input_and_adds_seven(spark):
    df = _df(spark, [_row()])
    out = D.engineer_features(df)
    assert out.columns[:len(df.columns)] == df.columns
    assert len(out.columns) == len(df.columns) + 7


def test_clean_sentinels_and_numeric(spark):
    raw = spark.createDataFrame(
        [("?", "3", "x"), ("Caucasian", "3.0", "?"), ("Asian", "?", "y")],
        "race string, time_in_hospital string, other string")
    out = clean_encounters(raw, numeric_columns=("time_in_hospital",)).collect()
    assert [tuple(r) for r in out] == [(None, 3, "x"), ("Caucasian", 3, None), ("Asian", None, "y")]


def test_flags_are_pure_expressions(spark):
    df = _df(spark, [_row()])
    plan = D.engineer_features(df)._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan
