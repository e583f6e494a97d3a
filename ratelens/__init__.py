"""ratelens: cohort and event-rate analytics on Spark DataFrames.

The most used entry points are re-exported here; everything else lives in
``ratelens.functions`` (Column expressions), ``ratelens.operators``
(DataFrame operators), ``ratelens.ml`` (split, models, metrics),
``ratelens.sources`` (inputs and sinks), ``ratelens.streaming`` and
``ratelens.plans`` (named queries and their DuckDB oracles).
"""

from .functions.cleaning import (clean_encounters, coerce_numeric,
                                 check_columns, null_sentinels)
from .functions.flags import engineer_features
from .ml.metrics import (average_precision, classification_report, confusion,
                         pr_curve, roc_auc, roc_curve, threshold_sweep)
from .ml.models import (compare_models, cross_validate, evaluate_best,
                        fit_forest, fit_logistic, model_frame, score)
from .ml.split import stratified_folds, stratified_split
from .operators.correlation import correlation_matrix
from .operators.medication import dose_status_matrix, medication_impact
from .operators.rates import (event_rate, kpi_summary, medication_gap,
                              patient_fanout_rate, rate_vs_overall)
from .operators.reshape import kpi_long, pivot_rate, pivot_table
from .session import (checkpoint_root, drop_materialized, get_session,
                      materialize)
from .sources.fixture import encounters_raw
from .sources.readers import (load_encounters, read_encounters,
                              register_encounter_tables, save_table)

__all__ = [
    "average_precision", "checkpoint_root", "classification_report", "clean_encounters",
    "coerce_numeric", "compare_models", "confusion", "correlation_matrix", "cross_validate",
    "dose_status_matrix", "drop_materialized", "encounters_raw", "engineer_features",
    "evaluate_best", "event_rate", "fit_forest", "fit_logistic", "get_session", "kpi_long",
    "kpi_summary", "load_encounters", "materialize", "medication_gap", "medication_impact",
    "model_frame", "null_sentinels", "patient_fanout_rate", "pivot_rate", "pivot_table",
    "pr_curve", "rate_vs_overall", "read_encounters", "register_encounter_tables",
    "check_columns", "roc_auc", "roc_curve", "save_table", "score", "stratified_folds",
    "stratified_split", "threshold_sweep",
]
