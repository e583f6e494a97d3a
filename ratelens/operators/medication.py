"""Medication analyses (G-30, G-31, H-8).

The analysed project loops over medications and filters the full frame
twice per medication (22 passes, then 32 for the dose matrix). Here each
analysis is one scan with one global aggregate holding a few conditional
aggregates per medication; the per-medication rows are unpacked from the
single aggregate row with ``inline``. No row is expanded or shuffled; only
one partial-aggregate row per task goes to the final aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (DOSE_CELL_MORE_THAN, DOSE_MATRIX_MEDICATIONS,
                         DOSE_STATUSES, MEDICATION_MIN_N, MEDICATIONS)
from ..functions.cleaning import check_columns
from ..functions.flags import event_flag


def unpivot_medications(df: DataFrame, ids: Sequence[str] = ("encounter_id",),
                        medications: Sequence[str] = MEDICATIONS) -> DataFrame:
    """H-8: wide medication columns to (ids..., medication, status) rows."""
    check_columns("unpivot_medications", df, *ids, *medications)
    return df.unpivot(list(ids), list(medications), "medication", "status")


def medication_impact(df: DataFrame, medications: Sequence[str] = MEDICATIONS,
                      min_n: int = MEDICATION_MIN_N, event: Column | None = None,
                      absent: str = "No") -> DataFrame:
    """G-30: per medication, n prescribed, rate (percent, 2 digits) when
    prescribed and when not, and ``diff`` of the two rounded rates.

    'Prescribed' is ``status != 'No'`` with a missing status counted as
    prescribed (the pandas meaning); 'not prescribed' is ``status == 'No'``.
    Medications with fewer than ``min_n`` prescribed rows are skipped.
    Sorted by ``diff`` ascending.
    """
    check_columns("medication_impact", df, *medications)
    ev = (event_flag() if event is None else event).cast("double")
    cells = []
    for i, m in enumerate(medications):
        is_no = F.col(m).eqNullSafe(absent)
        cells.append(F.struct(
            F.lit(i).alias("position"),
            F.lit(m).alias("medication"),
            F.count_if(~is_no).alias("n"),
            F.round(F.avg(F.when(~is_no, ev)) * 100.0, 2).alias("prescribed_pct"),
            F.round(F.avg(F.when(is_no, ev)) * 100.0, 2).alias("not_prescribed_pct")))
    return (df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
            .filter(F.col("n") >= min_n)
            .withColumn("diff", F.col("prescribed_pct") - F.col("not_prescribed_pct"))
            .select("medication", "n", "prescribed_pct", "not_prescribed_pct", "diff")
            .orderBy("diff", "medication"))


def dose_status_matrix(df: DataFrame, medications: Sequence[str] = DOSE_MATRIX_MEDICATIONS,
                       statuses: Sequence[str] = DOSE_STATUSES,
                       more_than: int = DOSE_CELL_MORE_THAN,
                       event: Column | None = None) -> DataFrame:
    """G-31: medication x dose-status matrix of rates (percent, 1 digit).

    A cell is NULL unless more than ``more_than`` rows have that status.
    Every medication row and every status column is present.
    """
    check_columns("dose_status_matrix", df, *medications)
    ev = (event_flag() if event is None else event).cast("double")
    rows = []
    for i, m in enumerate(medications):
        fields = [F.lit(i).alias("position"), F.lit(m).alias("medication")]
        for s in statuses:
            hit = F.col(m) == s
            fields.append(F.when(F.count_if(hit) > more_than,
                                 F.round(F.avg(F.when(hit, ev)) * 100.0, 1)).alias(s))
        rows.append(F.struct(*fields))
    return (df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
            .orderBy("position").drop("position"))
