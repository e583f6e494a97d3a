from pyspark.sql import functions as F

from ratelens.operators import rates as R
from ratelens.operators import tables as T
from ratelens.plans.catalog import clean
from conftest import SF_SMALL


def _groups(spark, sizes, pos=1):
    rows = []
    for g, n in sizes.items():
        rows += [(g, "<30" if i < pos else "NO") for i in range(n)]
    return spark.createDataFrame(rows, "g string, readmitted string")


def test_min_n_and_more_than_bounds(spark):
    df = _groups(spark, {"a": 14, "b": 15, "c": 19, "d": 20, "e": 30, "f": 31})
    ge15 = {r.g for r in R.event_rate(df, ["g"], min_n=15).collect()}
    assert ge15 == {"b", "c", "d", "e", "f"}
    ge20 = {r.g for r in R.event_rate(df, ["g"], min_n=20).collect()}
    assert ge20 == {"d", "e", "f"}
    gt30 = {r.g for r in R.event_rate(df, ["g"], more_than=30).collect()}
    assert gt30 == {"f"}


def test_rate_scale_digits_count_order_limit(spark):
    df = _groups(spark, {"a": 3, "b": 8}, pos=1)
    out = R.event_rate(df, ["g"], scale=100.0, digits=1, count_name="n", order="desc",
                       rate_name="pct", limit=1).collect()
    assert [tuple(r) for r in out] == [("a", 33.3, 3)]


def test_drop_null_keys(spark):
    df = spark.createDataFrame([(None, "<30"), ("a", "NO")], "g string, readmitted string")
    assert R.event_rate(df, ["g"]).count() == 2
    assert R.event_rate(df, ["g"], drop_null_keys=True).count() == 1


def test_patient_fanout_equals_materialised_join(spark):
    c = clean(spark, SF_SMALL)
    e, dim, u = T.encounter_fact(c), T.patient_dim(c), T.utilization_fact(c)
    fast = R.patient_fanout_rate(c, dim, "age",
                                 measures={"avg_meds": "num_medications"}, order=None)
    joined = T.join_patient_dim(e, dim).join(u, "encounter_id")
    brute = (joined.groupBy("age").agg(
        F.avg("num_medications").alias("avg_meds"),
        F.avg(F.when(F.col("readmitted") == "<30", 1).otherwise(0)).alias("readmission_rate"),
        F.count(F.lit(1)).alias("patient_count")))
    a = sorted(tuple(r) for r in fast.collect())
    b = sorted(tuple(r) for r in brute.select(*fast.columns).collect())
    assert a == b
    # the fan-out really happens in this fixture
    assert joined.count() > e.count()


def test_fanout_plan_does_not_join_row_level_encounters(spark):
    c = clean(spark, SF_SMALL)
    plan = R.patient_fanout_rate(c, T.patient_dim(c), "age")
    txt = plan._jdf.queryExecution().optimizedPlan().toString()
    # the join input from the encounter side is the per-patient aggregate
    assert "Join" in txt and "Aggregate" in txt


def test_rate_vs_overall(spark):
    df = _groups(spark, {"a": 4, "b": 4}, pos=1)
    df = df.union(spark.createDataFrame([("b", "<30")], "g string, readmitted string"))
    rows = {r.g: r for r in R.rate_vs_overall(df, ["g"]).collect()}
    assert abs(rows["a"].overall_rate - 3 / 9) < 1e-12
    assert abs(rows["b"].lift - (2 / 5) / (3 / 9)) < 1e-12


def test_medication_gap(spark):
    rows = [(2, 12, "<30"), (2, 12, "NO"), (2, 5, "NO"), (3, None, "<30"), (20, 12, "<30")]
    df = spark.createDataFrame(rows, "time_in_hospital int, num_medications int, readmitted string")
    got = {r.los: r for r in R.medication_gap(df).collect()}
    assert set(got) == {2, 3}
    assert got[2].gap == 50.0 and got[3].low_meds_pct == 100.0 and got[3].high_meds_pct is None


def test_hot_patient_fanout_matches_brute_force(spark):
    """One patient holds a third of all encounters and several age rows."""
    rows = []
    for i in range(900):
        pid = 1 if i % 3 == 0 else 100 + i
        rows.append((i, pid, "<30" if i % 7 == 0 else "NO", i % 5 + 1))
    enc = spark.createDataFrame(rows, "encounter_id long, patient_nbr long, readmitted string, "
                                      "num_medications int")
    dim = spark.createDataFrame(
        [(1, "[70-80)", "Male"), (1, "[80-90)", "Male"), (1, "[80-90)", "Female")]
        + [(100 + i, "[50-60)", "Female") for i in range(900) if i % 3 != 0],
        "patient_nbr long, age string, gender string")
    fast = {r.age: r for r in R.patient_fanout_rate(
        enc, dim, "age", measures={"avg_meds": "num_medications"}, order=None).collect()}
    brute = {r.age: r for r in enc.join(dim, "patient_nbr").groupBy("age").agg(
        F.avg("num_medications").alias("avg_meds"),
        F.avg(F.when(F.col("readmitted") == "<30", 1).otherwise(0)).alias("readmission_rate"),
        F.count(F.lit(1)).alias("patient_count")).collect()}
    assert fast.keys() == brute.keys()
    for k in brute:
        assert tuple(fast[k]) == tuple(brute[k][c] for c in fast[k].__fields__)
    assert fast["[80-90)"].patient_count == 600  # 300 encounters x 2 patient rows


def test_hot_score_in_ranking_metrics(spark):
    """A third of the rows share one score; ties stay exact across bins."""
    from ratelens.ml import metrics as M
    rows = [(i, 1 if i % 4 == 0 else 0, 0.5 if i % 3 == 0 else (i % 97) / 97.0)
            for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, label int, score double")
    pos = [s for _, l, s in rows if l == 1]
    neg = [s for _, l, s in rows if l == 0]
    import bisect
    neg_sorted = sorted(neg)
    u = sum(bisect.bisect_left(neg_sorted, p) + 0.5 * (bisect.bisect_right(neg_sorted, p)
                                                      - bisect.bisect_left(neg_sorted, p))
            for p in pos)
    auc = M.roc_auc(df, n_bins=8).first()[0]
    assert abs(auc - u / (len(pos) * len(neg))) < 1e-12


def test_single_pass_fanout_equals_join_form(spark):
    """dim=None (patient table = distinct rows of the same frame) gives the same
    numbers as the explicit join, including a hot patient with several ages."""
    rows = []
    for i in range(600):
        pid = 7 if i % 3 == 0 else 1000 + i % 50
        age = ["[70-80)", "[80-90)", "[50-60)"][i % 3 if pid == 7 else i % 2]
        rows.append((i, pid, age, "Male" if i % 5 else "Female",
                     "<30" if i % 4 == 0 else "NO", i % 9))
    enc = spark.createDataFrame(rows, "encounter_id long, patient_nbr long, age string, "
                                      "gender string, readmitted string, num_medications int")
    one = R.patient_fanout_rate(enc, None, "age", measures={"avg_meds": "num_medications"},
                                order=None)
    two = R.patient_fanout_rate(enc, T.patient_dim(enc), "age",
                                measures={"avg_meds": "num_medications"}, order=None)
    assert sorted(tuple(r) for r in one.collect()) == sorted(tuple(r) for r in two.collect())
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
