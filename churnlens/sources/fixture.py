"""Telco-shaped customer table derived from the driver's ``customer`` and ``orders`` tables.

The driver tables hold no telco data. A raw customer table is read out of what
customers did: tenure is the time from the first open order to the last order, charges come
from order values, services and contract from order priorities, statuses, nation
and market segment, and a customer counts as churned when the last order lies
far back. Customers without such a time have a blank total, very negative balances a
missing one, and the busiest customers
stand in the table twice. The same SQL text runs on Spark and on DuckDB, so
every downstream oracle starts from identical rows.

Scale: one grouped aggregate of orders by customer and one join by the same key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _yes(condition: str, otherwise: str = "'No'") -> str:
    return f"CASE WHEN {condition} THEN 'Yes' ELSE {otherwise} END"


#: Add-on services: a customer with internet has one if there are orders enough of one kind.
ADD_ONS = {
    "OnlineSecurity": "urgent >= 2",
    "OnlineBackup": "high >= 2",
    "DeviceProtection": "medium >= 3",
    "TechSupport": "low >= 3",
    "StreamingTV": "finished >= 4",
    "StreamingMovies": "pending >= 4",
}

_ADD_ON_SQL = ",\n ".join(
    f"CASE WHEN n_nation IN (4, 9, 14, 19, 24) THEN 'No internet service' WHEN {cond} THEN 'Yes' ELSE 'No' END {name}"
    for name, cond in ADD_ONS.items()
)

# One SQL text for both engines: counts, minima, maxima and integer arithmetic only.
FIXTURE_CTES = f"""o AS (SELECT o_custkey, count(*) n_orders,
 min(CASE WHEN o_orderstatus = 'P' THEN year(o_orderdate) * 12 + month(o_orderdate) END) first_month, max(year(o_orderdate) * 12 + month(o_orderdate)) last_month,
 min(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) least_cents, max(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) most_cents,
 sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) urgent, sum(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) high,
 sum(CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END) medium, sum(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) low,
 sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) finished, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) pending
 FROM {{orders}} GROUP BY o_custkey),
k AS (SELECT c_custkey AS id, c_nationkey AS n_nation, c_mktsegment AS seg, c_acctbal AS bal, coalesce(n_orders, 0) n_orders,
 least(72, coalesce(last_month - first_month, 0)) AS active_months, coalesce(last_month, 0) last_month,
 coalesce(least_cents, 0) least_cents, coalesce(most_cents, 0) most_cents,
 coalesce(urgent, 0) urgent, coalesce(high, 0) high, coalesce(medium, 0) medium, coalesce(low, 0) low,
 coalesce(finished, 0) finished, coalesce(pending, 0) pending
 FROM {{customer}} LEFT JOIN o ON c_custkey = o_custkey),
s AS (SELECT id, bal, n_orders, last_month, least_cents, 1825 + most_cents % 10051 AS cents,
 CASE WHEN n_nation % 2 = 0 THEN 'Male' ELSE 'Female' END gender,
 CASE WHEN bal < 500 THEN 1 ELSE 0 END SeniorCitizen,
 {_yes("finished > pending")} Partner,
 {_yes("urgent > low")} Dependents,
 CAST(active_months AS INT) tenure,
 {_yes("seg <> 'MACHINERY'")} PhoneService,
 CASE WHEN seg = 'MACHINERY' THEN 'No phone service' WHEN high >= 2 THEN 'Yes' ELSE 'No' END MultipleLines,
 CASE n_nation % 5 WHEN 4 THEN 'No' WHEN 0 THEN 'DSL' WHEN 2 THEN 'DSL' ELSE 'Fiber optic' END InternetService,
 {_ADD_ON_SQL},
 CASE seg WHEN 'AUTOMOBILE' THEN 'One year' WHEN 'FURNITURE' THEN 'Two year' ELSE 'Month-to-month' END Contract,
 {_yes("bal >= 3000")} PaperlessBilling,
 CASE n_orders % 4 WHEN 0 THEN 'Electronic check' WHEN 1 THEN 'Mailed check' WHEN 2 THEN 'Bank transfer (automatic)' ELSE 'Credit card (automatic)' END PaymentMethod
 FROM k),
b AS (SELECT 2 * id AS src_ord, concat('C-', lpad(CAST(id AS VARCHAR(20)), 9, '0')) customerID, gender, SeniorCitizen, Partner, Dependents, tenure,
 PhoneService, MultipleLines, InternetService, OnlineSecurity, OnlineBackup, DeviceProtection, TechSupport, StreamingTV, StreamingMovies,
 Contract, PaperlessBilling, PaymentMethod, cents / CAST(100 AS DOUBLE) MonthlyCharges,
 CASE WHEN tenure = 0 THEN ' ' WHEN bal < -900 THEN NULL
  ELSE CAST(CAST(greatest(0, cents * tenure + least_cents % 4001 - 2000) / 100.0 AS DECIMAL(12, 2)) AS VARCHAR(20)) END TotalCharges,
 {_yes("last_month < 24008")} Churn, n_orders FROM s)"""

FIXTURE_COLUMNS = (
    "src_ord,customerID,gender,SeniorCitizen,Partner,Dependents,tenure,PhoneService,MultipleLines,"
    "InternetService,OnlineSecurity,OnlineBackup,DeviceProtection,TechSupport,StreamingTV,StreamingMovies,"
    "Contract,PaperlessBilling,PaymentMethod,MonthlyCharges,TotalCharges,Churn"
)

FIXTURE_BODY = (
    f"SELECT {FIXTURE_COLUMNS} FROM b\n"
    f"UNION ALL SELECT src_ord+1,{FIXTURE_COLUMNS.split(',', 1)[1]} FROM b WHERE n_orders >= 17"
)


def fixture_sql(customer: str = "customer", orders: str = "orders") -> str:
    """Full SELECT text of the raw telco table."""
    return "WITH " + FIXTURE_CTES.format(customer=customer, orders=orders) + "\n" + FIXTURE_BODY


def fixture_cte(name: str = "raw", customer: str = "customer", orders: str = "orders") -> str:
    """The fixture as CTE fragments ending in a CTE called ``name`` (for oracle SQL)."""
    return FIXTURE_CTES.format(customer=customer, orders=orders) + f",\n{name} AS ({FIXTURE_BODY})"


def telco_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw telco table (22 columns incl. ``src_ord``) derived from ``customer`` and ``orders``."""
    base = sf_dir.rstrip("/")
    customer, orders = (spark.read.parquet(f"{base}/{name}.parquet") for name in ("customer", "orders"))
    return spark.sql(fixture_sql("{customer}", "{orders}"), customer=customer, orders=orders)
