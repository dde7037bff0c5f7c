import random

import numpy as np
import pytest
from conftest import table

from plumbline.operators import importance


@pytest.fixture(scope="module")
def planted(make):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b), "uvw"[i % 3], "hi" if a > 0 else "lo") for i, (a, b) in enumerate(rng.normal(size=(200, 2)))]
    return make(rows, "signal double, noise double, kind string, label string")


def test_both_rankings_find_the_signal(planted):
    rows = importance.feature_importance(planted, "label").collect()
    for method in ("random_forest", "mutual_information"):
        ranked = sorted((r for r in rows if r["method"] == method), key=lambda r: r["rank"])
        assert [r["rank"] for r in ranked] == [1, 2, 3]
        assert ranked[0]["feature"] == "signal"
        assert [r["score"] for r in ranked] == sorted((r["score"] for r in ranked), reverse=True)
        assert sum(r["normalized_score"] for r in ranked) == pytest.approx(1.0, abs=1e-4)


def test_regression(make):
    rng = np.random.default_rng(4)
    rows = [(float(a), float(b), float(2 * a + rng.normal() * 0.01)) for a, b in rng.normal(size=(120, 2))]
    frame = importance.feature_importance(make(rows, "x1 double, x2 double, y double"), "y")
    assert {r["feature"] for r in frame.where("rank = 1").collect()} == {"x1"}


def test_status(make):
    small = make([(1.0, 2.0)] * 3, "x double, y double")
    assert importance.importance_status(small, "y").first()["status"] == "insufficient_data"
    assert importance.forest_importance(small, "y").count() == 0
    assert importance.importance_status(small, "z").first()["status"] == "error"
    assert importance.importance_status(small, None).first()["status"] == "unavailable"
    alone = make([(1.0,)] * 9, "y double")
    assert importance.importance_status(alone, "y").first()["error"] == "No feature columns found."


@pytest.mark.parametrize("limit", [importance.BROADCAST_CHARS, 0])
def test_codes_follow_code_point_order(make, limit):
    words = ["b", "B", "a", "é", "", "Z", "aa", "z" * 80]
    rows = [(w, None if i % 2 else "x") for i, w in enumerate(words * 3)]
    found = importance.label_codes(make(rows, "s string, t string"), make(rows, "s string, t string").fields, limit)
    codes = {r["label"]: r["code"] for r in found.where("ordinal = 0").collect()}
    assert codes == {w: i for i, w in enumerate(sorted(words))}
    assert table(found.where("ordinal = 1"), "label", "code") == [("x", 0)]


def test_encoding_of_gaps(make, monkeypatch):
    rows = [("b", 1.0, "y"), (None, None, "n"), ("a", 3.0, None), ("b", 4.0, "y"), ("a", 8.0, "n")]
    schema = "s string, x double, label string"
    want = {(1.0, 1.0, "y"), (-1.0, 3.5, "n"), (0.0, 3.0, "__missing__"), (1.0, 4.0, "y"), (0.0, 8.0, "n")}
    assert set(table(importance.encoded(make(rows, schema), "label"), "code0", "x1", importance.TARGET)) == want
    # The shuffled dictionary gives the same codes as the broadcast one.
    monkeypatch.setattr(importance, "BROADCAST_CHARS", 0)
    assert set(table(importance.encoded(make(rows, schema), "label"), "code0", "x1", importance.TARGET)) == want


def test_numeric_class_target_is_filled_and_truncated(make):
    ds = make([(float(i), v) for i, v in enumerate([1.9, 2.2, None, 2.2, 5.0])], "x double, y double")
    values = [r[0] for r in importance.encoded(ds, "y", "classification").select(importance.TARGET).collect()]
    assert values == [1, 2, 2, 2, 5]


def test_mutual_information_against_brute_force(make):
    random.seed(1)
    rows = [("abc"[i % 3], "pq"[(i % 3 > 0) ^ (random.random() < 0.2)]) for i in range(150)]
    score = importance.mutual_information(make(rows, "x string, y string"), "y").first()["score"]
    n = len(rows)
    joint = {c: rows.count(c) for c in set(rows)}
    xs, ys = [r[0] for r in rows], [r[1] for r in rows]
    want = sum(c / n * np.log(c * n / (xs.count(x) * ys.count(y))) for (x, y), c in joint.items())
    assert score == pytest.approx(want, abs=1e-6)


def test_a_label_that_fixes_the_target_has_its_entropy(make):
    import math

    ds = make([(f"label{i % 40:02d}", float(i * 37 % 101), (i % 40) % 2) for i in range(400)], "tag string, noise double, y int")
    scores = {r["feature"]: r["score"] for r in importance.mutual_information(ds, "y", "classification").collect()}
    assert scores["tag"] == pytest.approx(math.log(2), abs=1e-6) and scores["noise"] < scores["tag"]


def test_training_rows_are_dealt_over_all_cores(spark):
    rows, cores = spark.range(300, numPartitions=1), spark.sparkContext.defaultParallelism
    assert importance._dealt(rows, 300).rdd.getNumPartitions() == 1
    dealt = importance._dealt(rows, importance.DEALT_ROWS + 1)
    assert dealt.rdd.getNumPartitions() == cores > 1 and dealt.count() == 300
    assert importance._dealt(rows, cores * importance.ROWS_PER_TASK + 1).rdd.getNumPartitions() == 2 * cores
