"""Heavy values by summary against plain counts."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.dataset import Dataset
from plumbline.functions import heavy
from plumbline.operators import explore, profile


def test_counters_never_overstate_and_bound_their_error():
    rng = np.random.default_rng(1)
    for size in (1, 5, 40):
        counters, true = heavy.Counters(size), Counter()
        for _ in range(50):
            part = Counter(map(str, (rng.zipf(1.3, 200) % 500).tolist()))
            true.update(part)
            counters.add(part)
        counters.shrink()
        assert len(counters.kept) <= size and counters.error <= sum(true.values()) / size
        assert all(0 <= n - counters.kept[key] <= counters.error for key, n in true.items())


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_heavy_and_top_keys(spark, parts):
    rng = np.random.default_rng(2)
    values = [f"v{i}" for i in (rng.zipf(1.4, 4000) % 3000).tolist()] + [None] * 50
    frame = spark.createDataFrame([(v,) for v in values], "s string").repartition(parts)
    true = Counter(v for v in values if v is not None)
    ranked = sorted(true.items(), key=lambda pair: (-pair[1], pair[0]))
    for size in (30, 5000):
        assert heavy.heavy_keys(frame, F.col("s"), 150, size) == [(k, n) for k, n in ranked if n >= 150]
        for n in (1, 3):
            want = [(k, c) for k, c in ranked if c >= ranked[n - 1][1]]
            assert heavy.top_keys(frame, F.col("s"), n, size) in ([want] if size == 5000 else [want, None])
    assert heavy.top_keys(frame, F.col("s"), 10_000, 5000) == ranked


def test_flat_values_are_left_to_the_caller(spark):
    frame = spark.range(3000).select(F.col("id").cast("string").alias("s"))
    assert heavy.top_keys(frame, F.col("s"), 2, 50) is None


def test_top_categories_of_long_and_flat_texts(make, monkeypatch):
    long = ["x" * 80 + "b", "x" * 80 + "a", "short"]
    ds = make([(long[0],)] * 4 + [(long[1],)] * 4 + [(long[2],)] * 5 + [(f"u{i}",) for i in range(30)] + [(None,)], "s string")
    want = [("short", 5, 1), (long[1], 4, 2), (long[0], 4, 3), ("u0", 1, 4)]
    assert sorted(map(tuple, explore.top_categories(ds, "s", 4).collect()), key=lambda r: r[2]) == want
    monkeypatch.setattr(explore, "top_keys", lambda *a: None)
    assert sorted(map(tuple, explore.top_categories(ds, "s", 4).collect()), key=lambda r: r[2]) == want


def test_mode_of_a_long_text(make, monkeypatch):
    texts = ["y" * 70 + c for c in "bcabcaq"]
    ds = make([(t,) for t in texts], "s string")
    want = ("y" * 70 + "a", 2)
    assert tuple(profile.mode_frequency(ds).select("most_frequent", "frequency").first()) == want
    monkeypatch.setattr(profile, "top_keys", lambda *a: None)
    assert tuple(profile.mode_frequency(ds).select("most_frequent", "frequency").first()) == want
