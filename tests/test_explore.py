from conftest import table

from plumbline.operators import explore


def test_top_categories_ties_by_value(make):
    ds = make([(w,) for w in "ccbbaad"], "s string")
    assert table(explore.top_categories(ds, "s", 3), "value", "count", "rank") == [("a", 2, 1), ("b", 2, 2), ("c", 2, 3)]


def test_top_categories_of_long_texts(make):
    words = ["x" * 100, "y" * 100, "z" * 100]
    ds = make([(w,) for w in [words[2], words[2], words[1], words[0], None]], "s string")
    assert table(explore.top_categories(ds, "s", 2), "value", "count") == [(words[2], 2), (words[0], 1)]


def test_scatter_is_repeatable_and_complete(make):
    rows = [(float(i), None if i % 5 == 0 else float(-i)) for i in range(400)]
    first = set(table(explore.scatter_sample(make(rows, "a double, b double"), "a", "b"), "x", "y"))
    again = set(table(explore.scatter_sample(make(rows[::-1], "a double, b double"), "a", "b"), "x", "y"))
    assert first == again and len(first) == 60 and all(y is not None for _, y in first)


def test_feature_table_sorts_and_filters(make):
    ds = make([(float(i), i % 7 + 0.5, "ab"[i % 2]) for i in range(20)], "big double, small double, kind string")
    names = [r["column_name"] for r in explore.feature_table(ds, sort_by="mean", descending=True).collect()]
    assert names == ["big", "small", "kind"]
    assert explore.feature_table(ds, column_type="categorical").count() == 1
    assert explore.feature_table(ds, search="BIG").count() == 1


def test_schema_overview(make):
    ds = make([(1.5, None), (2.5, "x"), (None, "y"), (4.5, "z")] * 5, "a double, b string")
    rows = {r["column_name"]: r["quality"] for r in explore.schema_overview(ds).collect()}
    assert rows == {"a": "critical", "b": "critical"}
    assert explore.schema_totals(ds).first()["total_missing"] == 10
