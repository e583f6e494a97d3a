"""Fixed values that must equal the analysed project's definitions.

These are domain definitions (category labels, bracket orders, thresholds and
medication lists), stated plainly in their natural order.
"""

# --- Fixed values: target and missing-value token ---------------------------
TARGET_COLUMN = "readmitted"
POSITIVE_VALUE = "<30"
SENTINEL = "?"
MISSING_TOKENS = ("?",)

# --- Fixed values: numeric columns forced to numbers on load ----------------
NUMERIC_COLUMNS = (
    "time_in_hospital",
    "num_medications",
    "number_outpatient",
    "number_inpatient",
    "number_emergency",
)

# --- Fixed values: sparse columns dropped by the exploration step -----------
SPARSE_COLUMNS = ("weight", "medical_specialty", "payer_code")

# --- Fixed values: flag thresholds ------------------------------------------
LONG_STAY_DAYS = 7            # long stay: time_in_hospital >= 7
HIGH_MED_BURDEN = 15          # high medication burden: num_medications >= 15
HIGH_UTILIZER_VISITS = 3      # prior visits sum >= 3
HIGH_MEDS_CUT = 10            # high meds / med group: num_medications > 10
HIGH_RISK_SCORE = 2           # high risk: score v1 >= 2
MAX_LOS_DAY = 14              # LOS day trend is limited to <= 14 days
VISIT_COLUMNS_3 = ("number_outpatient", "number_inpatient", "number_emergency")
VISIT_COLUMNS_2 = ("number_outpatient", "number_inpatient")

# --- Fixed values: age brackets with elevated risk --------------------------
HIGH_RISK_AGES = ("[20-30)", "[70-80)", "[80-90)", "[90-100)")

# --- Fixed values: ordered bracket domains ----------------------------------
AGE_ORDER = ("[0-10)", "[10-20)", "[20-30)", "[30-40)", "[40-50)",
             "[50-60)", "[60-70)", "[70-80)", "[80-90)", "[90-100)")
WEIGHT_ORDER = ("[0-25)", "[25-50)", "[50-75)", "[75-100)", "[100-125)",
                "[125-150)", "[150-175)", "[175-200)", ">200")
LOS_SHORT = "Short (<=3d)"
LOS_MEDIUM = "Medium (4-7d)"
LOS_LONG = "Long (>7d)"
LOS_ORDER = (LOS_SHORT, LOS_MEDIUM, LOS_LONG)
LOS_SHORT_MAX = 3
LOS_MEDIUM_MAX = 7
MEDS_HIGH = "High Meds (>10)"
MEDS_LOW = "Low Meds (<=10)"
MED_GROUPS = (MEDS_HIGH, MEDS_LOW)
RISK_HIGH = "High Risk"
RISK_STANDARD = "Standard Risk"
RISK_GROUPS = (RISK_HIGH, RISK_STANDARD)
DOSE_STATUSES = ("No", "Steady", "Up", "Down")
READMITTED_VALUES = ("<30", ">30", "NO")

# --- Fixed values: medication lists -----------------------------------------
MEDICATIONS = ("metformin", "repaglinide", "nateglinide", "chlorpropamide",
               "glimepiride", "glipizide", "glyburide", "pioglitazone",
               "rosiglitazone", "acarbose", "insulin")
DOSE_MATRIX_MEDICATIONS = ("insulin", "metformin", "glipizide", "glyburide",
                           "glimepiride", "pioglitazone", "rosiglitazone",
                           "repaglinide")
MEDICATION_MIN_N = 50         # medication impact skips n < 50
DOSE_CELL_MORE_THAN = 30      # dose matrix keeps a cell only when n > 30

# --- Fixed values: rate bands (percent) -------------------------------------
RATE_BAND_HIGH = 12.0
RATE_BAND_MEDIUM = 10.0

# --- Fixed values: modelling --------------------------------------------------
FEATURE_COLUMNS = ("long_stay", "high_med_burden", "high_utilizer", "age_risk",
                   "time_in_hospital", "num_medications", "number_outpatient",
                   "number_inpatient", "number_emergency")
LABEL_COLUMN = "readmitted_flag"
RANDOM_STATE = 42
TEST_FRACTION = 0.2
CV_FOLDS = 5
LR_MAX_ITER = 1000
RF_TREES = 100
DEFAULT_THRESHOLD = 0.5
# Threshold sweep: 0.10 to 0.85 in steps of 0.05 (16 values).
SWEEP_START = 0.10
SWEEP_STEP = 0.05
SWEEP_COUNT = 16
RANDOM_BASELINE_AUC = 0.5

# --- Fixed values: KPI labels -------------------------------------------------
KPI_LABELS = ("Total Encounters", "Readmission Rate", "Avg Length of Stay (days)",
              "Avg Medications", "High Risk Patient %")

# --- Fixed values: class names of the report, negative class first
CLASS_NAMES = ("Not Readmitted", "Readmitted")
