"""DuckDB oracle SQL for the registered queries.

Each oracle is plain SQL over the driver's pre-registered tables. It starts from
the same fixture derivation as the Spark side and then restates every operator
independently in SQL (windows, GROUP BY, CASE), so a match checks the Spark
plan's semantics rather than a shared code path.
"""

from __future__ import annotations

from .. import schema as S
from ..operators.features import CANONICAL_FEATURES, NUMERIC_FEATURES, OneHotVocabulary
from ..operators.linear import SCORECARD_INTERCEPT, SCORECARD_TERMS
from ..operators.report import HISTOGRAM_EDGES, HISTOGRAM_LABELS
from ..sources.fixture import fixture_cte


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def lit(v: str) -> str:
    return "'" + str(v).replace("'", "''") + "'"


def dbl(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def rnd(expr: str, digits: int) -> str:
    scale = dbl(10.0 ** digits)
    return f"(round_even(({expr}) * {scale}, 0) / {scale})"


NUM = S.NUMBER_PATTERN
RAW_COLS = ["src_ord"] + S.RAW_COLUMNS


def coerce(expr: str) -> str:
    return f"(CASE WHEN regexp_matches({expr}, {lit(NUM)}) THEN TRY_CAST(trim({expr}) AS DOUBLE) END)"


# ------------------------------------------------------------------------------------
# CTE chain: raw -> dd (dedup) -> cl (clean) -> ft (features) -> oh (one-hot) -> sc (scored)
# ------------------------------------------------------------------------------------
RAW = fixture_cte("raw")

DEDUP = (
    "dd AS (SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER "
    "(PARTITION BY customerID ORDER BY src_ord) AS _rn FROM raw) WHERE _rn = 1)"
)


def clean_select(src: str, with_target: bool = True) -> str:
    cols = []
    for col in RAW_COLS:
        if col == "TotalCharges":
            cols.append(f"coalesce({coerce('TotalCharges')}, MonthlyCharges * tenure) AS TotalCharges")
        elif col == "Churn":
            if with_target:
                cols.append("CAST(CASE Churn WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS INTEGER) AS Churn")
        elif col in ("SeniorCitizen", "tenure"):
            cols.append(f"CAST({col} AS INTEGER) AS {col}")
        elif col == "MonthlyCharges":
            cols.append("CAST(MonthlyCharges AS DOUBLE) AS MonthlyCharges")
        else:
            cols.append(col)
    return f"SELECT {', '.join(cols)} FROM {src}"


CLEAN = f"cl AS ({clean_select('dd')})"

NO_SVC = ", ".join(lit(v) for v in S.NO_SERVICE_VALUES)
SERVICE_COUNT = " + ".join(
    f"coalesce(CAST(NOT ({c} IN ({NO_SVC})) AS INTEGER), 1)" for c in S.SERVICE_COLUMNS
)
TENURE_GROUP = (
    "CASE " + " ".join(f"WHEN tenure <= {u} THEN {lit(l)}" for u, l in S.TENURE_GROUPS)
    + f" ELSE {lit(S.TENURE_GROUP_LAST)} END"
)
CONTRACT_MONTHS = "CASE " + " ".join(f"WHEN Contract = {lit(k)} THEN {v}" for k, v in S.CONTRACT_MONTHS.items()) + " END"


def features_cte(name: str, src: str, hv_source: str | None = None, hv_mode: str = "batch") -> str:
    """Derived columns over ``src``; the high-value quantile comes from ``hv_source`` (default: src)."""
    if hv_mode == "single":
        hv = "0"
    else:
        hv = (
            f"coalesce(CAST(MonthlyCharges > (SELECT quantile_cont(MonthlyCharges, {S.HIGH_VALUE_QUANTILE}) "
            f"FROM {hv_source or src}) AS INTEGER), 0)"
        )
    return (
        f"{name} AS (SELECT *, "
        f"{rnd('TotalCharges / CASE WHEN tenure = 0 THEN 1 ELSE tenure END', 2)} AS AvgMonthlySpend, "
        f"{TENURE_GROUP} AS TenureGroup, "
        f"({SERVICE_COUNT}) AS ServiceCount, "
        f"{hv} AS HighValueCustomer, "
        f"{rnd('TotalCharges + MonthlyCharges * ' + CONTRACT_MONTHS, 2)} AS EstimatedCLV, "
        f"CAST(({SERVICE_COUNT}) <= 1 AS INTEGER) AS HasNoAddOns, "
        f"CAST(coalesce(InternetService = 'Fiber optic' AND TechSupport = 'No', false) AS INTEGER) AS IsFiberNoSupport "
        f"FROM {src})"
    )


FEATURES = features_cte("ft", "cl")

VOCAB = OneHotVocabulary.from_domains()


def onehot_exprs(vocab: OneHotVocabulary = VOCAB) -> list[str]:
    return [
        f"CAST(coalesce({col} = {lit(lv)}, false) AS INTEGER) AS {q(col + '_' + lv)}"
        for col, lvs in vocab.levels.items()
        for lv in lvs
    ]


def onehot_cte(name: str, src: str, keep: list[str]) -> str:
    cols = keep + [x for x in NUMERIC_FEATURES] + onehot_exprs()
    return f"{name} AS (SELECT {', '.join(cols)} FROM {src})"


ONEHOT = onehot_cte("oh", "ft", ["customerID", "src_ord", "Churn"])


def scorecard_logit(prefix: str = "") -> str:
    z = dbl(SCORECARD_INTERCEPT)
    for feat, coef in SCORECARD_TERMS:
        z = f"({z} + {dbl(coef)} * CAST({prefix}{q(feat)} AS DOUBLE))"
    return z


def prob_expr(prefix: str = "") -> str:
    return f"({dbl(1.0)} / ({dbl(1.0)} + exp(-{scorecard_logit(prefix)})))"


def risk_expr(p: str, suffix: str = "") -> str:
    return (
        f"CASE WHEN {p} >= {dbl(S.HIGH_RISK)} THEN {lit('High' + suffix)} "
        f"WHEN {p} >= {dbl(S.MEDIUM_RISK)} THEN {lit('Medium' + suffix)} ELSE {lit('Low' + suffix)} END"
    )


def label_expr(p: str) -> str:
    return f"CASE WHEN {p} >= {dbl(0.5)} THEN {lit(S.CHURN_LABEL)} ELSE {lit(S.STAY_LABEL)} END"


# scored rows: clean columns (+ Churn when present in src) + probability columns
def scored_cte(name: str, src_clean: str, src_onehot: str, with_target: bool) -> str:
    clean_cols = [c for c in RAW_COLS if c != "Churn" or with_target]
    sel = ", ".join(clean_cols)
    return (
        f"{name}_p AS (SELECT c.*, {prob_expr('o.')} AS p_raw FROM {src_clean} c "
        f"JOIN {src_onehot} o ON o.src_ord = c.src_ord),\n"
        f"{name} AS (SELECT {sel}, {rnd('p_raw', 4)} AS ChurnProbability, {label_expr('p_raw')} AS Prediction, "
        f"{risk_expr('p_raw')} AS RiskLevel, {TENURE_GROUP} AS TenureGroup, p_raw FROM {name}_p)"
    )


SCORED_L = scored_cte("sl", "cl", "oh", True)  # labelled scored table (Churn kept)
# the scoring path drops the target before cleaning: same rows, no Churn column
SCORED = "sc AS (SELECT * EXCLUDE (Churn) FROM sl)"

BASE = [RAW, DEDUP, CLEAN, FEATURES, ONEHOT, SCORED_L, SCORED]


def with_ctes(body: str, *extra: str, upto: int = len(BASE)) -> str:
    return "WITH " + ",\n".join(BASE[:upto] + list(extra)) + "\n" + body


DISPLAY_SC = [c for c in S.DISPLAY_COLUMNS]


# ------------------------------------------------------------------------------------
# ranks by md5 order (split, folds, background samples)
# ------------------------------------------------------------------------------------
def md5_key(seed, key: str = "customerID") -> str:
    return f"md5({lit(str(seed) + ':')} || coalesce(CAST({key} AS VARCHAR), ''))"


SPLIT = (
    "sp_r AS (SELECT *, row_number() OVER (PARTITION BY Churn ORDER BY "
    + md5_key(42) + ", customerID) - 1 AS _r, count(*) OVER (PARTITION BY Churn) AS _n FROM cl),\n"
    "sp AS (SELECT * EXCLUDE (_r, _n), CASE WHEN _r < CAST(ceil(_n * 0.2) AS BIGINT) THEN 'test' ELSE 'train' END AS split FROM sp_r)"
)


def folds_cte(src: str = "sp", k: int = 3) -> str:
    # contiguous folds; the first n % k folds take one extra row
    return (
        f"fd_r AS (SELECT *, row_number() OVER (PARTITION BY Churn ORDER BY {md5_key('fold42')}, customerID) - 1 AS _r, "
        f"count(*) OVER (PARTITION BY Churn) AS _n FROM {src} WHERE split = 'train'),\n"
        f"fd AS (SELECT * EXCLUDE (_r, _n, _base, _extra), CAST(CASE WHEN _r < _extra * (_base + 1) THEN _r // (_base + 1) "
        f"ELSE _extra + (_r - _extra * (_base + 1)) // _base END AS INTEGER) AS fold FROM "
        f"(SELECT *, _n // {k} AS _base, _n % {k} AS _extra FROM fd_r))"
    )
