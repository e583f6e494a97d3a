"""Row-wise flags, buckets and scores as Column expressions (D-1 .. D-15).

Every flag is ``when(cond, 1).otherwise(0)``: a NULL input gives 0, as a
comparison with a missing value is false in the analysed project. A plain
``cond.cast("int")`` would give NULL instead and change every mean.
All functions are lazy and action-free, so they apply to streaming frames too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (HIGH_MED_BURDEN, HIGH_MEDS_CUT, HIGH_RISK_AGES,
                         HIGH_RISK_SCORE, HIGH_UTILIZER_VISITS, LONG_STAY_DAYS,
                         LOS_LONG, LOS_MEDIUM, LOS_MEDIUM_MAX, LOS_SHORT,
                         LOS_SHORT_MAX, MEDS_HIGH, MEDS_LOW, POSITIVE_VALUE,
                         RISK_HIGH, RISK_STANDARD, TARGET_COLUMN,
                         VISIT_COLUMNS_2, VISIT_COLUMNS_3)
from .cleaning import check_columns


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def flag(cond: Column) -> Column:
    """0/1 int flag; NULL condition counts as 0."""
    return F.when(cond, 1).otherwise(0)


def event_flag(col: str | Column = TARGET_COLUMN, positive: str = POSITIVE_VALUE) -> Column:
    """D-1: 1 when the outcome equals the positive value."""
    return flag(_c(col) == positive)


def long_stay(threshold: int = LONG_STAY_DAYS, col: str | Column = "time_in_hospital") -> Column:
    """D-2: length of stay at or above ``threshold`` days."""
    return flag(_c(col) >= threshold)


def high_med_burden(threshold: int = HIGH_MED_BURDEN, col: str | Column = "num_medications") -> Column:
    """D-3: medication count at or above ``threshold``."""
    return flag(_c(col) >= threshold)


def prior_visits(columns: Sequence[str] = VISIT_COLUMNS_3) -> Column:
    total = None
    for c in columns:
        total = F.col(c) if total is None else total + F.col(c)
    return total


def high_utilizer(threshold: int = HIGH_UTILIZER_VISITS,
                  columns: Sequence[str] = VISIT_COLUMNS_3) -> Column:
    """D-4 (three visit columns) / D-5 (``columns=VISIT_COLUMNS_2``)."""
    return flag(prior_visits(columns) >= threshold)


def age_risk(ages: Sequence[str] = HIGH_RISK_AGES, col: str | Column = "age") -> Column:
    """D-6: age bracket in the elevated-risk set."""
    return flag(_c(col).isin(*ages))


def risk_score_sum(utilizer: Column | None = None) -> Column:
    """Score v1 written from raw columns (D-7 form; D-9 with the 2-column utilizer)."""
    util = high_utilizer() if utilizer is None else utilizer
    return util + long_stay() + high_med_burden()


def risk_score_v1(df: DataFrame) -> Column:
    """D-7: long_stay + high_med_burden + high_utilizer (checks the columns)."""
    check_columns("risk_score_v1", df, "long_stay", "high_med_burden", "high_utilizer")
    return F.col("long_stay") + F.col("high_med_burden") + F.col("high_utilizer")


def risk_score_v2(df: DataFrame) -> Column:
    """D-8: risk_score + age_risk (checks the columns)."""
    check_columns("risk_score_v2", df, "risk_score", "age_risk")
    return F.col("risk_score") + F.col("age_risk")


def sql_risk_score() -> Column:
    """D-9: score v1 with the two-column high-utilizer form."""
    return risk_score_sum(high_utilizer(columns=VISIT_COLUMNS_2))


FEATURE_INPUTS = ("readmitted", "time_in_hospital", "num_medications",
                  "number_outpatient", "number_inpatient", "number_emergency", "age")


def engineer_features(df: DataFrame) -> DataFrame:
    """D-10: add the seven engineered int columns; input columns unchanged.

    One projection: Catalyst collapses the derived columns, nothing is copied.
    """
    check_columns("engineer_features", df, *FEATURE_INPUTS)
    v1 = long_stay() + high_med_burden() + high_utilizer()
    return df.withColumns({
        "readmitted_flag": event_flag(),
        "long_stay": long_stay(),
        "high_med_burden": high_med_burden(),
        "high_utilizer": high_utilizer(),
        "age_risk": age_risk(),
        "risk_score": v1,
        "risk_score_v2": v1 + age_risk(),
    })


def high_risk(score: Column | None = None, cut: int = HIGH_RISK_SCORE) -> Column:
    """D-11 as 0/1: score v1 (three-column utilizer) at or above ``cut``."""
    return flag((risk_score_sum() if score is None else score) >= cut)


def risk_group(score: Column | None = None, cut: int = HIGH_RISK_SCORE) -> Column:
    """D-11 as a label."""
    s = risk_score_sum() if score is None else score
    return F.when(s >= cut, RISK_HIGH).otherwise(RISK_STANDARD)


def los_category(col: str | Column = "time_in_hospital", short_max: int = LOS_SHORT_MAX,
                 medium_max: int = LOS_MEDIUM_MAX) -> Column:
    """D-12: Short / Medium / Long. A NULL stay falls to Long (ELSE branch)."""
    c = _c(col)
    return (F.when(c <= short_max, LOS_SHORT).when(c <= medium_max, LOS_MEDIUM)
            .otherwise(LOS_LONG))


def high_meds(cut: int = HIGH_MEDS_CUT, col: str | Column = "num_medications") -> Column:
    """D-13: more than ``cut`` medications as 0/1."""
    return flag(_c(col) > cut)


def med_group(cut: int = HIGH_MEDS_CUT, col: str | Column = "num_medications") -> Column:
    """D-14: label form of D-13. A NULL count falls to the low group."""
    return F.when(_c(col) > cut, MEDS_HIGH).otherwise(MEDS_LOW)


def bracket_order(col: str | Column, domain: Sequence[str]) -> Column:
    """D-15: 1-based position of a bracket in an ordered domain; NULL outside it."""
    pos = F.array_position(F.array(*[F.lit(v) for v in domain]), _c(col))
    return F.when(pos > 0, pos.cast("int"))
