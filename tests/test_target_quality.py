import pytest
from conftest import keyed

from plumbline.dataset import Dataset
from plumbline.operators import quality, summary, target
from plumbline.plans import eda


def task(ds, name):
    row = target.detect_task(ds, name).first()
    return row["task_type"], row["confidence"], row["status"]


def test_tasks(make):
    ds = make(
        [(float(i * 1000 + i * i), ["Yes", "No"][i % 2], "abc"[i % 3], i % 5 + 1, None, 1) for i in range(20)],
        "Salary double, Churn string, Segment string, Rating int, Nothing string, One int",
    )
    assert task(ds, "Salary") == ("regression", 0.95, "detected")
    assert task(ds, "Churn") == ("binary_classification", 0.98, "detected")
    assert task(ds, "Segment") == ("multiclass_classification", 0.95, "detected")
    assert task(ds, "Rating") == ("multiclass_classification", 0.75, "detected")
    assert task(ds, "One") == ("binary_classification", 0.98, "detected")
    assert task(ds, "Nothing") == (None, 0.0, "invalid_target")
    assert task(ds, "absent") == (None, 0.0, "invalid_target")
    assert task(ds, None)[2] == task(ds, "  ")[2] == "target_required"


def test_two_dates_are_binary_and_more_are_unsupported(spark):
    two = Dataset(spark.sql("SELECT DATE'2024-01-01' AS d UNION ALL SELECT DATE'2024-01-02'"))
    assert task(two, "d")[0] == "binary_classification"
    many = Dataset(spark.sql("SELECT date_add(DATE'2024-01-01', cast(id AS int)) AS d FROM range(5)"))
    assert task(many, "d")[2] == "unsupported"


@pytest.mark.parametrize(
    "yes, warning",
    [(1, target.WARN_HIGH), (4, target.WARN_SOME), (8, None)],
)
def test_imbalance(make, yes, warning):
    ds = make([("Yes" if i < yes else "No",) for i in range(20)], "Purchased string")
    row = target.target_analysis(ds, "Purchased").first()
    assert row["num_classes"] == 2 and row["warning"] == warning
    assert keyed(target.class_distribution(ds, "Purchased"), "label", "count")["Yes"] == yes


def test_target_errors(make):
    ds = make([(1.0,), (2.0,)], "x double")
    assert "not found" in target.target_analysis(ds, "y").first()["error"]
    assert target.target_analysis(ds, "x").first()["mean"] == 1.5


# -- quality -----------------------------------------------------------------


def score(ds):
    row = quality.quality_score(ds).first()
    return row["score"], row["grade"]


def test_scores(make):
    clean = make([(20, "a"), (35, "b"), (25, "c"), (41, "d")], "Age int, Name string")
    assert score(clean) == (100.0, "Excellent")
    pair = make([(20, 41.0), (35, 71.0), (25, 51.0), (41, 83.0)], "Age int, Twice double")
    assert score(pair) == (95.0, "Excellent")
    constant = make([(20, "x"), (35, "x"), (25, "x"), (41, "x")], "Age int, Country string")
    assert score(constant) == (90.0, "Excellent")


def test_empty_table_is_critical(spark):
    row = quality.quality_score(Dataset(spark.createDataFrame([], "a int"))).first()
    assert (row["score"], row["grade"], row["issues"]) == (0.0, "Critical", [quality.EMPTY_ISSUE])
    assert row["strengths"] == [] and row["recommendations"] == [quality.EMPTY_ADVICE]


def test_one_missing_value_does_not_make_a_column_constant(make):
    ds = make([("x",), ("x",), (None,)], "s string")
    assert quality.quality_score(ds).first()["constant_penalty"] == 0.0
    assert quality.constant_columns(ds).count() == 1


@pytest.fixture(scope="module")
def mixed(make):
    rows = [(float(i), 2.0 * i, "ab"[i % 2], None if i == 3 else i % 2, 7 if i < 19 else 500) for i in range(20)]
    return make(rows, "x double, twice double, kind string, flag int, spiky int")


def test_feature_summary(mixed):
    found = keyed(summary.feature_summary(mixed, "x"), "column_name", "column_type", "outlier_count", "target_correlation")
    assert found["x"] == ("numeric", 0, 1.0)
    assert found["twice"] == ("numeric", 0, 1.0)
    assert found["spiky"][1] == 1
    assert found["kind"] == ("categorical", 0, None)


def test_insights_in_order(mixed):
    texts = [r["message"] for r in summary.insights(mixed).collect()]
    assert texts[0] == "Dataset contains 20 rows and 5 columns."
    assert texts[1] == "1 column(s) contain missing values (1 cells affected)."
    assert texts[2] == "No duplicate rows were detected."
    assert texts[3] == "x and twice have a very strong positive correlation (1.0000)."
    assert texts[-1].startswith("Dataset quality score is ")
    assert set(keyed(summary.insight_severity(mixed), "message", "severity").values()) <= {"warning", "success", "info"}


def test_preprocessing(mixed):
    found = {(r["column_name"], r["type"], r["priority"], r["action"]) for r in summary.preprocessing(mixed, "x").collect()}
    assert ("flag", "missing_values", "high", "imputation") in found
    assert ("kind", "categorical_encoding", "medium", "encoding") in found
    assert ("spiky", "feature_outliers", "medium", "investigate_or_transform") in found
    assert (None, "target_correlation", "medium", "investigate") in found
    no_target = {r["type"] for r in summary.preprocessing(mixed).collect()}
    assert "multicollinearity" in no_target and "target_correlation" not in no_target
    as_target = {(r["column_name"], r["type"]) for r in summary.preprocessing(mixed, "spiky").collect()}
    assert ("spiky", "target_outliers") in as_target


def test_models(mixed):
    row = summary.model_recommendation(mixed, "x").first()
    assert row["status"] == "available" and row["models"][0] == "Linear Regression" and len(row["models"]) == 3
    assert "Review detected outliers before model training." in row["preprocessing"]
    none = summary.model_recommendation(mixed).first()
    assert (none["status"], none["models"], none["reasoning"]) == ("unavailable", [], [summary.NO_TASK])


def test_report_and_sections(mixed):
    row = summary.report(mixed, "kind").first()
    assert (row["rows"], row["columns"], row["task_type"]) == (20, 5, "binary_classification")
    assert len(row["key_findings"]) == summary.insights(mixed).count()
    sections = eda.run_eda(mixed, "kind")
    assert sections["importance_status"].first()["status"] == "available"
    assert {r["method"] for r in sections["feature_importance"].collect()} == {"random_forest", "mutual_information"}


def test_sections_without_target(mixed):
    sections = eda.run_eda(mixed)
    assert "feature_importance" not in sections
    assert sections["importance_status"].first()["error"] == "No target column provided."


def test_evidence_is_compact(mixed):
    rows = eda.evidence(mixed).collect()
    assert sum(r["section"] == "insights" for r in rows) == 5
    assert {r["item"] for r in rows if r["section"] == "missing"} == {"flag"}


def test_own_narrative(mixed):
    row = eda.own_narrative(mixed, "x").first()
    assert row["narrative"].startswith("The dataset contains 20 observations across 5 features, identified for a regression task")
    assert row["key_risks"][0] == "Missing values detected in 'flag' (5.0% missing)."
    assert row["recommendations"][0].startswith("Apply imputation")


def test_readiness(mixed):
    row = quality.ml_readiness(mixed, "x").first()
    parts = [row[c] for c in ("data_quality", "feature_completeness", "class_balance", "feature_diversity", "outlier_risk")]
    assert row["overall"] == round(sum(parts) / 5)
    assert row["feature_diversity"] == 80.0 and row["class_balance"] == 75.0
