import datetime

import pytest
from pyspark.sql import functions as F
from conftest import keyed, table

from plumbline.dataset import Dataset
from plumbline.functions import columns
from plumbline.operators import profile


def codes(ds):
    return {(r["column_name"], r["code"]) for r in profile.profile_warnings(ds).collect()}


def test_types_cover_every_kind(make):
    ds = make(
        [
            (1, 0, 1.5, True, "a", datetime.date(2024, 1, 1), None, [1], {"k": 1}),
            (2, 1, 2.5, False, "b", datetime.date(2024, 1, 2), None, [2], {"k": 2}),
            (3, 1, 3.5, None, None, None, None, None, None),
        ],
        "n int, flag int, x double, b boolean, s string, d date, nothing double, arr array<int>, m map<string,int>",
    )
    assert keyed(profile.column_types(ds), "column_name", "column_type") == {
        "n": "numeric",
        "flag": "binary",
        "x": "numeric",
        "b": "binary",
        "s": "categorical",
        "d": "datetime",
        "nothing": "unknown",
        "arr": "categorical",
        "m": "categorical",
    }
    assert keyed(profile.distinct_counts(ds), "ordinal", "unique_count")[8] == 2


def test_constant_zero_or_one_is_binary(make):
    ds = make([(1, 0.0), (1, 0.0)], "one int, zero double")
    assert set(keyed(profile.column_types(ds), "column_name", "column_type").values()) == {"binary"}


def test_nan_is_missing(make):
    ds = make([(float("nan"),), (2.0,), (None,)], "x double")
    row = profile.column_profile(ds).first()
    assert (row["missing_count"], row["missing_percentage"], row["unique_count"]) == (2, 66.67, 1)


def test_missing_percentage(make):
    row = profile.column_profile(make([(20,), (None,), (40,)], "Age int")).first()
    assert (row["missing_count"], row["missing_percentage"]) == (1, 33.33)


def test_mode_and_frequency(make):
    ds = make([("Delhi",), ("Delhi",), ("Noida",), ("Delhi",)], "City string")
    row = profile.column_profile(ds).first()
    assert (row["most_frequent"], row["frequency"], row["unique_count"]) == ("Delhi", 3, 2)


def test_mode_ties_take_the_smallest(make):
    assert profile.mode_frequency(make([("b",), ("a",), ("b",), ("a",), ("c",)], "s string")).first()["most_frequent"] == "a"


def test_long_text_mode_is_the_text_itself(make):
    long_a, long_b = "a" * 100, "b" * 100
    ds = make([(long_b,), (long_b,), (long_a,), (long_a,), ("c" * 90,)], "s string")
    row = profile.mode_frequency(ds).first()
    assert (row["most_frequent"], row["frequency"]) == (long_a, 2)


def test_duplicates_count_null_as_equal(make):
    ds = make([(20, 30000), (20, 30000), (None, 1), (None, 1)], "Age int, Salary int")
    assert profile.duplicate_rows(ds).first()["duplicate_rows"] == 2


def test_duplicates_with_long_texts_and_maps(make):
    text = "x" * 500
    ds = make([(text, {"a": 1, "b": 2}), (text, {"b": 2, "a": 1}), (text + "y", {"a": 1})], "t string, m map<string,int>")
    assert profile.duplicate_rows(ds).first()["duplicate_rows"] == 1


def test_empty_table(spark):
    ds = Dataset(spark.createDataFrame([], "a int, b string"))
    assert table(profile.shape(ds), "rows", "columns", "duplicate_rows") == [(0, 2, 0)]
    assert profile.column_profile(ds).first()["column_type"] == "unknown"


def test_no_columns(spark):
    ds = Dataset(spark.range(3).select())
    assert profile.shape(ds).first()["columns"] == 0
    assert profile.column_profile(ds).count() == 0


def test_warnings(make):
    rows = [("IN", f"A{i}", f"u{i}@x.org", 1 if i == 0 else 0) for i in range(20)]
    found = codes(make(rows, "Country string, UserID string, Email string, Rare int"))
    assert ("Country", "constant") in found
    assert ("UserID", "identifier") in found
    assert ("Email", "high_cardinality") in found
    assert ("Rare", "imbalanced") in found


@pytest.mark.parametrize("bad, expected", [(1, True), (3, False)])
def test_date_like_needs_four_fifths(make, bad, expected):
    rows = [("x/y" if i < bad else f"2024-01-{i + 1:02d}",) for i in range(10)]
    assert (("d", "datetime") in codes(make(rows, "d string"))) is expected


def test_times_are_not_dates(make):
    assert codes(make([("12:30",), ("09:15",)] * 5, "t string")) & {("t", "datetime")} == set()


def test_missing_values_count_against_dates(make):
    rows = [("2024-01-01",)] * 7 + [(None,)] * 3
    assert ("d", "datetime") not in codes(make(rows, "d string"))


def test_names_with_any_characters(make):
    ds = make([(1.0, "a"), (2.0, "b")], "`sepal length (cm)` double, `od280/od315.of` string")
    assert profile.column_profile(ds).count() == 2
    assert profile.duplicate_rows(ds).first()["rows"] == 2


def test_approximate_profile_has_no_modes(make):
    row = profile.column_profile(make([("a",), ("b",), ("b",)], "s string"), 0.05).first()
    assert row["unique_count"] == 2 and row["most_frequent"] is None


def test_large_integers_stay_distinct(make):
    base = 2**53
    ds = make([(base,), (base + 1,), (base + 2,)], "k bigint")
    assert profile.distinct_counts(ds).first()["unique_count"] == 3


def test_common_stamps_are_dates(make):
    stamps = ["2024-01-05T10:00:00Z", "2024-01-05 10:00:00.123", "25/01/2024", "2024-01-05T10:00:00+02:00"]
    ds = make([(s,) for s in stamps], "t string")
    assert profile.date_like_columns(ds).first()["date_share"] == 1.0


def test_month_names_are_dates(make):
    stamps = ["05-Jan-2024", "5/Feb/2024", "March 5, 2024 10:30", "Tue, 5 Nov 2024 10:30:00 +02:00", "2024-Dec-05", "Sept. 5 2024 10:30:00", "5-may-2024 07:08"]
    assert profile.date_like_columns(make([(s,) for s in stamps], "t string")).first()["date_share"] == 1.0
    others = ["mar-9", "May-be 5", "31-Feb-2024", "1-2", "decide - later", "Jan"]
    assert profile.date_like_columns(make([(s,) for s in others], "t string")).first()["date_share"] == 0.0


ODD_DATES = [
    "2024-02-30", "2024-02-29", "0000-01-01", "13/01/2024", "01/13/2024", "13/13/2024", "2024-1-5", "2024/12/31", "31-12-2024", "2024-01-05T24:00:00",
    "2024-01-05 23:59", "2024-01-05 23:60:00", "5-05-2024", "05-05-2024 07:08", "005-05-2024", "05-05--2024", "05-05-+12345", "05-05-12345", "2024-05-5",
    "05 05 2024 10:30:59", "05-00-2024", "0-05-2024", "", "-", "2024-05-", "05/05/2024", "05/05/2024 1:00:00",
]


@pytest.mark.parametrize("layouts", [profile.DATE_LAYOUTS, [x.replace("MMM", "MM") for x in profile.NAMED_LAYOUTS]])
def test_layouts_are_tried_on_their_shape_only(spark, layouts):
    texts = spark.createDataFrame([(s,) for s in ODD_DATES], "t string")
    every = F.coalesce(*[F.try_to_timestamp("t", F.lit(x)) for x in layouts])
    rows = texts.select("t", every.cast("long").alias("every"), profile._first_parsed(F.col("t"), layouts).cast("long").alias("shaped")).collect()
    assert [r["t"] for r in rows if r["every"] != r["shaped"]] == []


def test_date_texts_are_cleaned_once_per_value(make):
    ds = make([("5-Jan-2024",), ("2024-01-05",)], "t string")
    plan = profile.date_like_columns(ds)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 4 and plan.lower().count("rlike") >= len(profile.DATE_LAYOUTS + profile.NAMED_LAYOUTS)


@pytest.mark.parametrize("operator", [lambda ds: profile.distinct_counts(ds), profile.duplicate_rows])
def test_groupings_of_many_cells_use_more_tasks(spark, make, monkeypatch, operator):
    ds = make([(i, f"t{i % 7}") for i in range(50)], "a int, b string")
    before, seen = operator(ds).collect(), []
    monkeypatch.setattr(columns, "CELLS_PER_TASK", 9)

    def pin(frame):
        seen.append(int(spark.conf.get("spark.sql.shuffle.partitions")))
        return columns.pin(frame)

    monkeypatch.setattr(profile, "pin", pin)
    assert sorted(operator(ds).collect()) == sorted(before) and seen == [12]
    assert spark.conf.get("spark.sql.shuffle.partitions") == "2"
