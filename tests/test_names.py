"""Users' column names never meet the operators' own."""

import pytest

from plumbline.dataset import Dataset
from plumbline.operators import isolation, missingness, outliers, summary
from plumbline.plans import eda
from plumbline.sources import readers


def test_rank_sums_beside_generated_names(make):
    rows = [(float(i), None if i % 3 else 1.0, float(i % 5), f"t{i}") for i in range(30)]
    ds = make(rows, "m0 double, m1 double, `x.y` double, v0 string")
    plain = make(rows, "a double, b double, c double, d string")
    shown = [tuple(r)[2:] for r in missingness.missing_columns(ds).collect()]
    assert len(shown) == len(missingness.missing_columns(plain).collect())


def test_forest_is_the_same_for_any_split_and_name(spark):
    rows = [(float(i % 50), 900.0 if i == 7 else float(i % 11)) for i in range(300)]
    counts = set()
    for names in ("u double, v double", "`__u` double, v0 double"):
        table = spark.createDataFrame(rows, names)
        for parts in (1, 3, 7):
            found = outliers.isolation_forest(Dataset(table.repartition(parts))).orderBy("ordinal").collect()
            counts.add(tuple(r["if_count"] for r in found))
    assert len(counts) == 1


def test_forest_with_infinite_and_repeated_values(make):
    ds = make([(5.0, 1.0)] * 200 + [(6.0, float("inf"))], "x double, y double")
    assert outliers.isolation_forest(ds).count() >= 1


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_forest_samples_values_by_their_share(spark, monkeypatch, seed):
    monkeypatch.setattr(isolation, "SEED", seed)
    n = isolation.SAMPLE_ROWS * 6
    hot = "IF(id % 3 = 0, 5.0D, CAST(id % 10000 AS DOUBLE) + 1000) AS v"
    few = "CAST(id % 4 AS DOUBLE) AS v"
    for column, value, share in ((hot, 5.0, 1 / 3), (few, 2.0, 1 / 4)):
        drawn = []
        for parts in (2, 5):
            ds = Dataset(spark.range(n).selectExpr(column).repartition(parts))
            sample = isolation._sampled(ds, outliers._checked(ds))
            drawn.append(sorted(r["v"] for r in sample.collect()))
        assert drawn[0] == drawn[1] and len(drawn[0]) == isolation.SAMPLE_ROWS
        assert abs(drawn[0].count(value) / isolation.SAMPLE_ROWS - share) < 0.01


def test_names_that_differ_in_case_alone(spark):
    """Every section works on `A, a`, and the columns keep their names."""
    rows = [(float(i), float(i * i % 13), "xy"[i % 2], f"t{i}") for i in range(30)]
    ds = Dataset(spark.createDataFrame(rows, "A double, a double, `a#2` string, B string"))
    assert [r["column_name"] for r in summary.feature_summary(ds, "a").collect()] == ["A", "a", "a#2", "B"]
    assert ds.field("a").n == 30 and outliers.flag_rows(ds).columns[:2] == ["A", "a"]
    plain = Dataset(spark.createDataFrame(rows, "p double, q double, r string, s string"))
    shown = [[tuple(r)[2:] for r in summary.feature_summary(d, t).orderBy("ordinal").collect()] for d, t in ((ds, "a"), (plain, "q"))]
    assert shown[0] == shown[1]
    assert readers.table_fingerprint(ds.source).first() == readers.table_fingerprint(plain.source).first()
    assert sum(r["rows"] for r in eda.section_sizes(ds, "a#2").collect()) == sum(r["rows"] for r in eda.section_sizes(plain, "r").collect())
