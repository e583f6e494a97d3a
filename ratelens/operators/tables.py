"""Normalised tables and their joins (A-4 .. A-6, E-1 .. E-5, D-16 .. D-19).

The three tables are projections of the encounter row, so joining them on
``encounter_id`` only rebuilds it. Cohort operators therefore accept the wide
frame directly; ``encounter_view`` exists for callers that hold separate
tables (for example tables written bucketed on ``encounter_id`` by
``save_table``, whose joins then need no shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import VISIT_COLUMNS_2
from ..functions.flags import (event_flag, high_med_burden, high_utilizer,
                               long_stay)
from .skew import ROWS_PER_TASK, skew_join

PATIENT_COLUMNS = ("patient_nbr", "age", "gender")
ENCOUNTER_COLUMNS = ("encounter_id", "patient_nbr", "time_in_hospital", "readmitted")
UTILIZATION_COLUMNS = ("encounter_id", "num_medications", "number_outpatient",
                       "number_inpatient", "number_emergency")


def patient_dim(raw: DataFrame) -> DataFrame:
    """A-4: distinct (patient_nbr, age, gender). Not unique on patient_nbr."""
    return raw.select(*PATIENT_COLUMNS).dropDuplicates()


def encounter_fact(raw: DataFrame) -> DataFrame:
    """A-5: encounter facts."""
    return raw.select(*ENCOUNTER_COLUMNS)


def utilization_fact(raw: DataFrame) -> DataFrame:
    """A-6: utilization facts."""
    return raw.select(*UTILIZATION_COLUMNS)


def join_patient_dim(enc: DataFrame, dim: DataFrame,
                     rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """E-1: encounters x patient table on patient_nbr (many-to-many).

    Each encounter appears once per (age, gender) row of its patient, so the
    output has at most (ages x genders) rows per encounter. A patient with
    very many encounters is a hot join key: a sketch finds those with more than
    ``rows_per_task`` encounters, whose rows are spread and whose few
    partner rows are copied (``skew_join``); other patients are joined as they are. For aggregates over
    this join use ``patient_fanout_rate``, which never materialises it.
    """
    return skew_join(enc, dim.select(*PATIENT_COLUMNS), "patient_nbr", "encounter_id",
                     rows_per_task=rows_per_task)


def join_on_encounter(left: DataFrame, right: DataFrame) -> DataFrame:
    """E-2 / E-4: 1:1 inner join on encounter_id; right-side duplicates of
    left columns are dropped so the result keeps one copy of each name.

    Always a merge join: the right side has a row per encounter, but a few columns of
    a compressed table are estimated small enough to be broadcast, which the driver
    then has to hold."""
    keep = [c for c in right.columns if c == "encounter_id" or c not in left.columns]
    return left.join(right.select(*keep).hint("merge"), "encounter_id")


def encounter_view(enc: DataFrame, util: DataFrame | None = None,
                   dim: DataFrame | None = None,
                   patients: DataFrame | None = None) -> DataFrame:
    """E-3 / E-5: encounters joined to utilization, then to the patient
    table (fan-out, E-3) or to the full patients table (1:1, E-5)."""
    out = enc
    if util is not None:
        out = join_on_encounter(out, util)
    if patients is not None:
        out = join_on_encounter(out, patients)
    if dim is not None:
        out = join_patient_dim(out, dim)
    return out


def list_high_utilizer(enc: DataFrame, limit: int = 10) -> DataFrame:
    """D-16: first ``limit`` encounters (by id) with the 2-column utilizer flag."""
    return (enc.select("encounter_id",
                       high_utilizer(columns=VISIT_COLUMNS_2).alias("high_utilizer"),
                       "readmitted")
            .orderBy("encounter_id").limit(limit))


def list_long_stay(enc: DataFrame) -> DataFrame:
    """D-17: long-stay flag per encounter."""
    return enc.select("encounter_id", long_stay().alias("long_stay"), "readmitted")


def list_high_med_burden(enc: DataFrame) -> DataFrame:
    """D-18: medication-burden flag per encounter."""
    return enc.select("encounter_id", high_med_burden().alias("high_med_burden"))


def cohort_listing(wide: DataFrame) -> DataFrame:
    """D-19: combined listing (age, LOS, meds, three flags, event).

    ``wide`` is the E-3 view (encounters x utilization x patient table).
    """
    return wide.select(
        "encounter_id", "age", "time_in_hospital", "num_medications",
        high_utilizer(columns=VISIT_COLUMNS_2).alias("high_utilizer"),
        long_stay().alias("long_stay"),
        high_med_burden().alias("high_med_burden"),
        event_flag().alias("readmitted_flag"))
