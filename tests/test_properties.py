"""Property tests: operators against plain pandas/Python on random frames."""
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ratelens.ml.split import assign_parts
from ratelens.operators.rates import event_rate

SETTINGS = dict(max_examples=8, deadline=None,
                suppress_health_check=[HealthCheck.function_scoped_fixture])

rows_strategy = st.lists(
    st.tuples(st.sampled_from(["a", "b", "c", None]), st.sampled_from(["<30", ">30", "NO", None]),
              st.integers(min_value=0, max_value=20)),
    min_size=1, max_size=60)


@settings(**SETTINGS)
@given(rows=rows_strategy, min_n=st.integers(min_value=1, max_value=5))
def test_event_rate_matches_pandas(spark, rows, min_n):
    pdf = pd.DataFrame(rows, columns=["g", "readmitted", "m"])
    df = spark.createDataFrame(rows, "g string, readmitted string, m int")
    got = {r.g: (r.readmission_rate, r.avg_m, r.n)
           for r in event_rate(df, ["g"], measures=["m"], count_name="n", min_n=min_n).collect()}
    pdf["flag"] = (pdf["readmitted"] == "<30").astype(int)
    want = {}
    for g, part in pdf.groupby(pdf["g"].fillna("__null__")):
        if len(part) >= min_n:
            want[None if g == "__null__" else g] = (part["flag"].mean(), part["m"].mean(), len(part))
    assert got.keys() == want.keys()
    for k in want:
        assert abs(got[k][0] - want[k][0]) < 1e-12 and abs(got[k][1] - want[k][1]) < 1e-9
        assert got[k][2] == want[k][2]


@settings(**SETTINGS)
@given(n_pos=st.integers(min_value=1, max_value=300), n_neg=st.integers(min_value=1, max_value=600),
       frac=st.sampled_from([0.1, 0.2, 0.25, 0.5]), bits=st.sampled_from([1, 3, 16]))
def test_split_quotas_exact(spark, n_pos, n_neg, frac, bits):
    rows = [(i, 1 if i < n_pos else 0) for i in range(n_pos + n_neg)]
    df = spark.createDataFrame(rows, "id long, y int")
    out = assign_parts(df, "y", "id", [frac], out="p", bits=bits)
    counts = {(r.y, r.p): r["count"] for r in out.groupBy("y", "p").count().collect()}
    for cls, n in ((1, n_pos), (0, n_neg)):
        expect = int(n * frac + 0.5)  # round half up, as Spark's round
        assert counts.get((cls, 0), 0) == expect
        assert counts.get((cls, 0), 0) + counts.get((cls, 1), 0) == n
