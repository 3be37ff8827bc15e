"""Unit tests on the reference's 3-row fixture plus the edge cases it leaves untested."""

import math

import pytest
from pyspark.sql import functions as F

from churnlens import schema as S
from churnlens.operators import clean as CL
from churnlens.operators import features as FE
from churnlens.operators import validate as VA


def _row(**kw):
    base = {
        "src_ord": 0, "customerID": "1001-AAA", "gender": "Male", "SeniorCitizen": 0, "Partner": "Yes",
        "Dependents": "No", "tenure": 3, "PhoneService": "Yes", "MultipleLines": "No",
        "InternetService": "Fiber optic", "OnlineSecurity": "No", "OnlineBackup": "No",
        "DeviceProtection": "No", "TechSupport": "No", "StreamingTV": "Yes", "StreamingMovies": "No",
        "Contract": "Month-to-month", "PaperlessBilling": "Yes", "PaymentMethod": "Electronic check",
        "MonthlyCharges": 95.0, "TotalCharges": "285.0", "Churn": "Yes",
    }
    base.update(kw)
    return base


SCHEMA = (
    "src_ord bigint, customerID string, gender string, SeniorCitizen int, Partner string, Dependents string, "
    "tenure int, PhoneService string, MultipleLines string, InternetService string, OnlineSecurity string, "
    "OnlineBackup string, DeviceProtection string, TechSupport string, StreamingTV string, StreamingMovies string, "
    "Contract string, PaperlessBilling string, PaymentMethod string, MonthlyCharges double, TotalCharges string, Churn string"
)


def frame(spark, rows):
    cols = ["src_ord"] + S.RAW_COLUMNS
    return spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], SCHEMA)


@pytest.fixture
def raw_sample(spark):
    rows = [
        _row(src_ord=0),
        _row(src_ord=1, customerID="1002-BBB", gender="Female", Dependents="Yes", tenure=48, MultipleLines="Yes",
             InternetService="DSL", OnlineSecurity="Yes", OnlineBackup="Yes", DeviceProtection="Yes",
             TechSupport="Yes", StreamingTV="No", Contract="Two year", PaperlessBilling="No",
             PaymentMethod="Mailed check", MonthlyCharges=55.0, TotalCharges=" ", Churn="No"),
        _row(src_ord=2),
    ]
    return frame(spark, rows)


def test_clean_drops_duplicates(raw_sample):
    cleaned = CL.clean(raw_sample).collect()
    assert len(cleaned) == 2
    assert len({r["customerID"] for r in cleaned}) == 2


def test_dedup_keeps_first_row(spark):
    rows = [_row(src_ord=5, tenure=10), _row(src_ord=3, tenure=20)]
    out = CL.dedup_keep_first(frame(spark, rows)).collect()
    assert len(out) == 1 and out[0]["tenure"] == 20 and out[0]["src_ord"] == 3


def test_clean_handles_blank_total_charges(raw_sample):
    cleaned = {r["customerID"]: r for r in CL.clean(raw_sample).collect()}
    assert all(r["TotalCharges"] is not None for r in cleaned.values())
    assert cleaned["1002-BBB"]["TotalCharges"] == pytest.approx(48 * 55.0)


def test_clean_encodes_target_as_binary(raw_sample):
    assert {r["Churn"] for r in CL.clean(raw_sample).collect()} <= {0, 1}


def test_invalid_target_raises(spark):
    bad = frame(spark, [_row(Churn="Maybe")])
    with pytest.raises(Exception, match="Churn"):
        CL.clean(bad).collect()


def test_add_features_creates_expected_columns(raw_sample):
    featured = FE.add_features(CL.clean(raw_sample))
    for col in ["AvgMonthlySpend", "TenureGroup", "ServiceCount", "HighValueCustomer", "EstimatedCLV"]:
        assert col in featured.columns


def test_add_features_handles_zero_tenure(spark):
    df = frame(spark, [_row(tenure=0, TotalCharges="0.0", MonthlyCharges=40.0, InternetService="DSL")])
    featured = FE.add_features(CL.clean(df)).collect()
    assert featured[0]["AvgMonthlySpend"] == 0.0


def test_build_feature_table_output_is_all_numeric(raw_sample):
    table = FE.build_feature_table(CL.clean(raw_sample).drop("src_ord"))
    assert "customerID" not in table.columns
    non_numeric = [n for n, t in table.dtypes if t not in ("int", "bigint", "double")]
    assert non_numeric == []


def test_feature_count_is_55():
    assert len(FE.CANONICAL_FEATURES) == 55


@pytest.mark.parametrize(
    "text,expected",
    [("12d", None), ("12.5F", None), ("0x1p3", None), ("1_000", None), ("1,000", None), ("NaN", None),
     (" ", None), ("inf", math.inf), (" 12.5 ", 12.5), ("1e3", 1000.0), ("-3", -3.0), (".5", 0.5)],
)
def test_numeric_coercion_grammar(spark, text, expected):
    df = frame(spark, [_row(TotalCharges=text)])
    got = CL.coerce_total(df).first()["TotalCharges"]
    assert got == expected


def test_null_service_counts_as_service(spark):
    df = frame(spark, [_row(StreamingTV=None, StreamingMovies="No", MultipleLines="No", OnlineSecurity="No",
                            OnlineBackup="No", DeviceProtection="No", TechSupport="No")])
    # PhoneService Yes, InternetService Fiber optic, StreamingTV null -> 3
    assert FE.add_features(CL.clean(df)).first()["ServiceCount"] == 3


def test_unknown_contract_gives_null_clv(spark):
    df = frame(spark, [_row(Contract="Weekly")])
    assert FE.add_features(CL.clean(df)).first()["EstimatedCLV"] is None


def test_rounding_is_half_even(spark):
    # 0.125 -> 0.12 (numpy), where Spark's round would give 0.13
    df = frame(spark, [_row(tenure=1, TotalCharges="0.125")])
    assert FE.add_features(CL.clean(df)).first()["AvgMonthlySpend"] == 0.12


def test_high_value_modes(spark):
    rows = [_row(src_ord=i, customerID=f"c{i}", MonthlyCharges=float(m)) for i, m in enumerate([1, 2, 3, 10])]
    cl = CL.clean(frame(spark, rows))
    batch = {r["customerID"]: r["HighValueCustomer"] for r in FE.add_features(cl, "batch").collect()}
    assert batch == {"c0": 0, "c1": 0, "c2": 0, "c3": 1}  # 0.75 quantile 4.75 (interpolated)
    assert {r["HighValueCustomer"] for r in FE.add_features(cl, "single").collect()} == {0}
    fitted = FE.HighValueThreshold.fit(cl)
    assert fitted.threshold == pytest.approx(4.75)


def test_one_hot_null_is_all_zero(spark):
    df = frame(spark, [_row(src_ord=0, customerID="a"), _row(src_ord=1, customerID="b", gender=None)])
    featured = FE.add_features(CL.clean(df))
    enc = FE.OneHotVocabulary.fit(featured).transform(featured)
    row = enc.where("customerID = 'b'").first()
    assert row["gender_Male"] == 0 and "gender_Female" not in enc.columns


def test_align_adds_missing_and_drops_unseen(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, extra int")
    out = FE.align_features(df, ["b", "a", "zzz"])
    assert out.columns == ["b", "a", "zzz"] and out.first()["zzz"] == 0


def test_validation_and_defaults(spark):
    df = spark.createDataFrame([("x", 5, 10.0), ("y", 150, -1.0), ("z", None, 3.0)], "customerID string, tenure int, MonthlyCharges double")
    filled = VA.apply_defaults(df)
    assert filled.first()["InternetService"] == "Fiber optic"
    checked = {r["customerID"]: r["errors"] for r in VA.validate_customers(filled).collect()}
    assert checked["x"] == []
    assert "tenure: must be between 0 and 100" in checked["y"] and "MonthlyCharges: must be >= 0" in checked["y"]
    assert checked["z"] == ["tenure: field required"]


def test_read_customers_reports_missing_columns(spark, tmp_path):
    from churnlens.sources.files import MissingColumnsError, read_customers

    p = tmp_path / "up.csv"
    p.write_text("customerID,tenure\nA,3\n")
    with pytest.raises(MissingColumnsError, match="Contract, MonthlyCharges"):
        read_customers(spark, str(p), required=S.UPLOAD_REQUIRED)


def test_read_customers_na_tokens(spark, tmp_path):
    from churnlens.sources.files import read_customers

    p = tmp_path / "na.csv"
    p.write_text("customerID,tenure,MonthlyCharges,Contract,TotalCharges\nA,3,9.5,One year,NA\nB,n/a,1.0,Two year, \n")
    rows = {r["customerID"]: r for r in read_customers(spark, str(p), required=S.UPLOAD_REQUIRED).collect()}
    assert rows["A"]["TotalCharges"] is None and rows["A"]["tenure"] == 3
    assert rows["B"]["tenure"] is None and rows["B"]["TotalCharges"] == " "
