import numpy as np
import pandas as pd
import pytest
from conftest import keyed, table

from plumbline.operators import association, numeric, outliers


def test_simple_means(make):
    ds = make([(20, 30000), (30, 40000), (40, 50000), (50, 60000)], "Age int, Salary int")
    assert keyed(numeric.numeric_stats(ds), "column_name", "mean", "min", "max")["Age"] == (35.0, 20.0, 50.0)


def test_moments_match_pandas(make):
    values = np.random.default_rng(0).gamma(2.0, 3.0, 200) + 1e6
    row = numeric.raw_stats(make([(float(v),) for v in values], "x double")).first()
    series = pd.Series(values)
    assert row["std"] == pytest.approx(series.std())
    assert row["skewness"] == pytest.approx(series.skew())
    assert row["kurtosis"] == pytest.approx(series.kurt())
    assert (row["q1"], row["median"], row["q3"]) == pytest.approx(tuple(series.quantile([0.25, 0.5, 0.75])))


def test_short_and_constant_columns(make):
    one = numeric.numeric_stats(make([(7.0,)], "x double")).first()
    assert (one["std"], one["skewness"], one["kurtosis"]) == (0.0, 0.0, 0.0)
    flat = numeric.numeric_stats(make([(5.0,)] * 50, "x double")).first()
    assert (flat["std"], flat["skewness"], flat["kurtosis"]) == (0.0, 0.0, 0.0)


def test_histogram_counts_every_value_once(make):
    rows = [(float(i),) for i in range(101)] + [(None,)] * 9
    bins = numeric.histogram(make(rows, "x double")).collect()
    assert len(bins) == 20 and sum(b["cnt"] for b in bins) == 101
    assert sum(b["is_median"] for b in bins) <= 2
    assert numeric.histogram(make([(5.0,)] * 4, "x double")).count() == 0


def test_box_positions(make):
    row = numeric.box_plot(make([(float(i),) for i in range(2, 103)], "x double")).first()
    assert (row["min_position"], row["median_position"], row["max_position"]) == (0.0, 50.0, 100.0)


# -- association -------------------------------------------------------------


def test_perfect_pair(make):
    ds = make([(float(i), 2.0 * i) for i in range(1, 6)], "A double, B double")
    assert table(association.associated_pairs(ds), "column_a", "column_b", "correlation", "method") == [("A", "B", 1.0, "pearson")]


def test_single_column_has_no_matrix(make):
    assert association.pearson_matrix(make([(20,), (30,), (40,)], "Age int")).count() == 0


def frame_with_gaps(n=300):
    rng = np.random.default_rng(5)
    data = pd.DataFrame(rng.normal(size=(n, 5)) + [0, 1e4, -3, 0, 2], columns=list("abcde"))
    data["b"] += data["a"] * 2
    data = data.mask(rng.random((n, 5)) < 0.2)
    data["flat"] = 5.0
    return data


@pytest.mark.parametrize("wide", [24, 2])
def test_pearson_on_pairwise_complete_rows(spark, make, wide):
    data = frame_with_gaps()
    rows = [tuple(None if v != v else float(v) for v in r) for r in data.itertuples(index=False)]
    ds = make(rows, ", ".join(f"{c} double" for c in data.columns))
    expected = data.corr()
    for r in association.pearson_pairs(ds, wide).collect():
        want = expected.loc[r["column_a"], r["column_b"]]
        assert r["r"] is None if want != want else r["r"] == pytest.approx(want, abs=1e-9)


def test_cramers_v(make):
    rows = [("x", "p", "k"), ("x", "p", "k"), ("y", "q", "k"), ("y", "q", "k"), (None, "q", "k")]
    found = table(association.cramers_v(make(rows, "a string, b string, c string")), "column_a", "column_b", "n", "value")
    assert found == [("a", "b", 4, 1.0)]


def test_cramers_v_of_identifiers_equals_the_counted_value(make):
    rows = [(f"id{i}", "ab"[i % 2], None if i % 5 == 0 else "pqr"[i % 3]) for i in range(30)]
    ds = make(rows, "id string, two string, three string")
    quick = set(table(association.cramers_v(ds), "column_a", "column_b", "n", "value"))
    pairs = [(a, b) for i, a in enumerate(ds.fields) for b in ds.fields[i + 1 :]]
    assert quick == set(table(association._counted_v(ds, pairs), "column_a", "column_b", "n", "value"))


@pytest.mark.parametrize("wide", [24, 1])
def test_point_biserial(make, wide):
    rows = [(i % 2, float(i % 2) * 10 + i * 0.01, 1) for i in range(40)]
    found = table(association.point_biserial(make(rows, "flag int, x double, one int"), wide), "binary_column", "numeric_column", "value")
    assert len(found) == 1 and found[0][:2] == ("flag", "x") and found[0][2] > 0.99


def test_point_biserial_needs_four_rows(make):
    assert association.point_biserial(make([(0, 1.0), (1, 2.0), (1, 3.0)], "f int, x double")).count() == 0


def test_bands(make):
    ds = make([(float(i), float(i), float((i * 7) % 5)) for i in range(20)], "a double, b double, c double")
    assert keyed(association.correlation_bands(ds), "column_b", "band")["b"] == "strong"


# -- outliers ----------------------------------------------------------------


@pytest.mark.parametrize("last, count", [(200, 1), (25, 0)])
def test_iqr_count(make, last, count):
    ds = make([(v,) for v in (20, 21, 22, 23, 24, last)], "Age int")
    assert outliers.outliers_iqr(ds).first()["iqr_count"] == count


def test_short_column_has_no_entry(make):
    assert outliers.outlier_summary(make([(20,), (30,), (40,)], "Age int")).count() == 0


@pytest.fixture(scope="module")
def planted(make):
    return make([(float(v),) for v in [*range(1, 101), 1000, -1000]], "x double")


def test_planted_outliers_are_found_by_all_methods(planted):
    row = outliers.outlier_summary(planted).first()
    assert row["iqr_count"] >= 2 and row["z_count"] >= 2 and row["if_count"] >= 1
    counts = sorted([row["iqr_count"], row["z_count"], row["if_count"]])
    assert row["consensus_count"] == counts[1] and row["row_consensus"] >= 2


def test_forest_repeats(planted, make):
    again = make([(float(v),) for v in [*range(1, 101), 1000, -1000]], "x double")
    assert outliers.isolation_forest(planted).first() == outliers.isolation_forest(again).first()


def test_constant_column_has_no_outliers(make):
    row = outliers.outlier_summary(make([(5.0,)] * 50, "x double")).first()
    assert (row["z_count"], row["if_count"], row["iqr_count"]) == (0, 0, 0)


def test_threshold_is_monotone(planted):
    counts = [outliers.outliers_zscore(planted, t).first()["z_count"] for t in (1.0, 2.0, 3.0)]
    assert counts == sorted(counts, reverse=True)


def test_flagged_rows_match_the_counts(planted):
    flagged = outliers.flag_rows(planted)
    assert flagged.where("x_iqr_outlier").count() == outliers.outliers_iqr(planted).first()["iqr_count"]
    assert flagged.where("x_z_outlier").count() == outliers.outliers_zscore(planted).first()["z_count"]


def test_missing_values_are_not_outliers(make):
    ds = make([(float(v),) for v in range(20)] + [(None,), (500.0,)], "x double")
    row = outliers.outliers_iqr(ds).first()
    assert (row["n"], row["iqr_count"], row["iqr_pct"]) == (21, 1, 4.76)


def _far(n, offset):
    return [(float(i % 7) + (offset if i % 3 == 0 else 0.0), float(i % 7) if i % 3 == 0 else None, float(-i)) for i in range(n)]


@pytest.mark.parametrize("wide", [24, 1])
def test_pairs_far_from_the_column_mean(make, wide):
    ds = make(_far(300, 1e12), "x double, y double, z double")
    r = {(p["column_a"], p["column_b"]): p["r"] for p in association.pearson_pairs(ds, wide).collect()}
    assert r["x", "y"] == pytest.approx(1.0, abs=1e-6)


@pytest.mark.parametrize("wide", [24, 1])
def test_infinite_values_have_no_pair(make, wide):
    rows = [(float(i), float(i * 2 % 5), i % 2) for i in range(20)] + [(float("inf"), 3.0, 1)]
    ds = make(rows, "x double, y double, b int")
    assert all(p["r"] is None for p in association.pearson_pairs(ds, wide).collect())
    assert not [p for p in association.point_biserial(ds, wide).collect() if p["numeric_column"] == "x"]


def test_histogram_edges_round_as_sql_does(make):
    # 20 * 69.24 / 461.6 falls just short of the third edge, 69.24 / 461.6 * 20 does not.
    low, high, edges = 0.0, 461.6, (69.24, 138.48, 161.56)
    found = keyed(numeric.histogram(make([(low,), (high,), *[(e,) for e in edges]], "x double")), "bin", "cnt")
    for edge in edges:
        assert found[min(int((edge - low) / (high - low) * 20) + 1, 20)] == 1
    assert sum(found.values()) == 5


def test_cells_are_counted_once_for_all_marginals(spark, make):
    ds = make([(f"a{i % 3}", f"b{i % 4}") for i in range(60)], "a string, b string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        frame = association.cramers_v(ds)
        plan = frame._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("MapInArrow") == 1 and plan.count("ReusedExchange") == 2
    assert frame.first()["value"] == 0.0
