"""Column names, value domains and labels of the customer table.

Everything in this module is a fixed value that results depend on: the
column layout, the accepted value of every categorical field, request
defaults, label texts and threshold constants.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: raw customer layout (column order of the source table) ---
KEY = "customerID"
TARGET = "Churn"
ORDER_COL = "src_ord"  # row position in the source; gives "first" a meaning

RAW_COLUMNS = [
    "customerID", "gender", "SeniorCitizen", "Partner", "Dependents", "tenure",
    "PhoneService", "MultipleLines", "InternetService", "OnlineSecurity",
    "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV",
    "StreamingMovies", "Contract", "PaperlessBilling", "PaymentMethod",
    "MonthlyCharges", "TotalCharges", "Churn",
]

# --- fixed values: service columns counted by ServiceCount ---
SERVICE_COLUMNS = [
    "PhoneService", "MultipleLines", "InternetService", "OnlineSecurity",
    "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV",
    "StreamingMovies",
]
NO_SERVICE_VALUES = ["No", "No internet service", "No phone service"]

# --- fixed values: categorical columns one-hot encoded (TenureGroup is appended) ---
CATEGORICAL_COLUMNS = [
    "gender", "Partner", "Dependents", "PhoneService", "MultipleLines",
    "InternetService", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
    "TechSupport", "StreamingTV", "StreamingMovies", "Contract",
    "PaperlessBilling", "PaymentMethod",
]
ENCODED_COLUMNS = CATEGORICAL_COLUMNS + ["TenureGroup"]

NUMERIC_BASE = ["SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges"]
DERIVED_NUMERIC = [
    "AvgMonthlySpend", "ServiceCount", "HighValueCustomer", "EstimatedCLV",
    "HasNoAddOns", "IsFiberNoSupport",
]

# --- fixed values: tenure groups (upper bound inclusive, label) ---
TENURE_GROUPS = [
    (6, "new (0-6mo)"),
    (24, "established (6-24mo)"),
    (48, "loyal (24-48mo)"),
]
TENURE_GROUP_LAST = "veteran (48mo+)"

# --- fixed values: months of expected remaining value per contract ---
CONTRACT_MONTHS = {"Month-to-month": 1, "One year": 6, "Two year": 12}

# --- fixed values: accepted values of request fields, and their defaults ---
YES_NO = ["Yes", "No"]
INTERNET_ADDON = ["Yes", "No", "No internet service"]
DOMAINS = {
    "gender": ["Male", "Female"],
    "SeniorCitizen": [0, 1],
    "Partner": YES_NO,
    "Dependents": YES_NO,
    "PhoneService": YES_NO,
    "MultipleLines": ["Yes", "No", "No phone service"],
    "InternetService": ["DSL", "Fiber optic", "No"],
    "OnlineSecurity": INTERNET_ADDON,
    "OnlineBackup": INTERNET_ADDON,
    "DeviceProtection": INTERNET_ADDON,
    "TechSupport": INTERNET_ADDON,
    "StreamingTV": INTERNET_ADDON,
    "StreamingMovies": INTERNET_ADDON,
    "Contract": ["Month-to-month", "One year", "Two year"],
    "PaperlessBilling": YES_NO,
    "PaymentMethod": [
        "Electronic check", "Mailed check", "Bank transfer (automatic)", "Credit card (automatic)",
    ],
}
DEFAULTS = {
    "gender": "Male",
    "SeniorCitizen": 0,
    "Partner": "No",
    "Dependents": "No",
    "PhoneService": "Yes",
    "MultipleLines": "No",
    "InternetService": "Fiber optic",
    "OnlineSecurity": "No",
    "OnlineBackup": "No",
    "DeviceProtection": "No",
    "TechSupport": "No",
    "StreamingTV": "No",
    "StreamingMovies": "No",
    "Contract": "Month-to-month",
    "PaperlessBilling": "Yes",
    "PaymentMethod": "Electronic check",
    "TotalCharges": None,
}
TENURE_MIN, TENURE_MAX = 0, 100
REQUIRED_REQUEST_FIELDS = ["tenure", "MonthlyCharges"]
UPLOAD_REQUIRED = ["tenure", "MonthlyCharges", "Contract"]

# --- fixed values: labels and thresholds on the churn probability ---
CHURN_LABEL = "Likely to Churn"
STAY_LABEL = "Likely to Stay"
LABEL_THRESHOLD = 0.5
HIGH_RISK, MEDIUM_RISK = 0.7, 0.3
RISK_LEVELS = ["High", "Medium", "Low"]
HIGH_VALUE_QUANTILE = 0.75

# --- fixed values: report layout ---
BREAKDOWN_COLUMNS = [
    "Contract", "InternetService", "PaymentMethod", "PaperlessBilling",
    "SeniorCitizen", "gender", "TenureGroup",
]
DISPLAY_COLUMNS = [
    "customerID", "gender", "SeniorCitizen", "Partner", "Dependents",
    "tenure", "TenureGroup", "PhoneService", "MultipleLines", "InternetService",
    "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport",
    "StreamingTV", "StreamingMovies", "Contract", "PaperlessBilling",
    "PaymentMethod", "MonthlyCharges", "TotalCharges",
    "ChurnProbability", "Prediction", "RiskLevel",
]
EDA_RATE_COLUMNS = ["Contract", "InternetService", "PaymentMethod", "TechSupport"]
CORRELATION_COLUMNS = ["tenure", "MonthlyCharges", "TotalCharges", "SeniorCitizen", "Churn"]
SEARCH_COLUMNS = ["customerID", "Contract", "InternetService", "PaymentMethod"]
METRIC_NAMES = ["accuracy", "precision", "recall", "f1", "roc_auc"]
PAGE_SIZE = 25
METER_BARS = 5

# --- fixed values: text read as missing by the CSV reader (pandas defaults) ---
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# --- fixed values: number grammar accepted when text is coerced to a number ---
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI]nf(inity)?)\s*$"


def raw_text_schema(columns: list[str] | None = None) -> T.StructType:
    """All-text schema used to read raw files before NA tokens are mapped."""
    return T.StructType([T.StructField(c, T.StringType(), True) for c in (columns or RAW_COLUMNS)])


RAW_TYPES = {
    "SeniorCitizen": T.IntegerType(),
    "tenure": T.IntegerType(),
    "MonthlyCharges": T.DoubleType(),
}


def raw_schema() -> T.StructType:
    """Typed raw schema: TotalCharges and Churn stay text until cleaning."""
    return T.StructType(
        [T.StructField(c, RAW_TYPES.get(c, T.StringType()), True) for c in RAW_COLUMNS]
    )
