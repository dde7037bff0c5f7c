import numpy as np
import pandas as pd
import pytest
from conftest import keyed

from plumbline.operators import missingness


def test_complete_columns(make):
    found = missingness.missing_columns(make([(float(i), 10.0 * i) for i in range(1, 6)], "a double, b double")).collect()
    assert {(r["indicator"], r["max_spearman_correlation"]) for r in found} == {("complete", None)}


def test_gap_that_follows_a_column(make):
    ds = make([(None if b > 70 else float(b), b) for b in range(100)], "a double, b int")
    found = keyed(missingness.missing_columns(ds), "column_name", "indicator", "max_spearman_correlation", "missing_count")
    assert found["a"][0] == "likely_mar" and found["a"][1] >= 0.2 and found["a"][2] == 29
    summary = missingness.missing_summary(ds).first()
    assert summary["total_missing_cells"] == 29 and summary["likely_mar_columns"] == ["a"] and summary["complete_columns"] == 1


def test_unknown_without_numbers_or_rows(make):
    few = make([(None if i == 0 else "x", float(i)) for i in range(5)], "s string, x double")
    assert keyed(missingness.missing_columns(few), "column_name", "indicator")["s"] == "unknown"
    texts = make([(None if i == 0 else "x", "y") for i in range(20)], "s string, t string")
    assert keyed(missingness.missing_columns(texts), "column_name", "indicator")["s"] == "unknown"


def test_rank_correlation_matches_pandas_with_ties(make):
    rng = np.random.default_rng(9)
    data = pd.DataFrame({"x": rng.integers(0, 6, 400).astype(float), "y": rng.lognormal(0, 2, 400), "one": rng.integers(0, 2, 400)})
    data.loc[rng.random(400) < 0.3, "y"] = np.nan
    data.loc[data["x"] > 3, "one"] = 1
    data["gap"] = np.where(data["x"] + rng.normal(0, 2, 400) > 3, np.nan, 1.5 + data["x"])
    rows = [tuple(None if v != v else v for v in r) for r in data.itertuples(index=False)]
    ds = make([(a, b, int(c), d) for a, b, c, d in rows], "x double, y double, one int, gap double")
    names = [f.name for f in ds.fields]
    for r in missingness.indicator_correlations(ds).collect():
        flag, other = data[names[r["ordinal"]]].isna().astype(float), data[names[r["x"]]]
        keep = other.notna()
        want = flag[keep].corr(other[keep].rank())
        assert r["n"] == keep.sum()
        assert r["r"] is None if want != want else r["r"] == pytest.approx(want, abs=1e-9)


def test_threshold(make):
    ds = make([(None if b > 70 else float(b), b) for b in range(100)], "a double, b int")
    assert keyed(missingness.missing_columns(ds, 0.99), "column_name", "indicator")["a"] == "likely_mcar"
