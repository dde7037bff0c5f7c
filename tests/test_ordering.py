import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.ordering import exact_quantiles

PROBS = (0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0)


def hot(n):
    """A third of the rows share one value."""
    rng = np.random.default_rng(1)
    return np.where(np.arange(n) % 3 == 0, 7.0, rng.lognormal(0, 3, n))


SHAPES = {
    "uniform": lambda n: np.random.default_rng(2).random(n),
    "skewed": lambda n: np.random.default_rng(3).lognormal(0, 4, n),
    "hot": hot,
    "constant": lambda n: np.full(n, 5.0),
    "few": lambda n: (np.arange(n) % 4).astype(float),
    "sorted": lambda n: np.arange(n).astype(float),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_selection_matches_numpy(spark, shape):
    values = SHAPES[shape](20_000)
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(4)
    found = exact_quantiles(df, {"x": (F.col("x"), len(values))}, PROBS, direct_cells=0, bracket_rows=3000, sample_rows=400)
    assert found["x"] == pytest.approx(list(np.quantile(values, PROBS)), rel=1e-12, abs=1e-12)


def test_selection_skips_missing_values(spark):
    rows = [(None if i % 4 == 0 else float(i), float(-i)) for i in range(5000)]
    df = spark.createDataFrame(rows, "x double, y double")
    present = [x for x, _ in rows if x is not None]
    found = exact_quantiles(df, {"x": (F.col("x"), len(present)), "y": (F.col("y"), 5000)}, PROBS, 0, 200, 100)
    assert found["x"] == pytest.approx(list(np.quantile(present, PROBS)))
    assert found["y"] == pytest.approx(list(np.quantile([y for _, y in rows], PROBS)))


def test_builtin_path_agrees(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("x"))
    assert exact_quantiles(df, {"x": (F.col("x"), 1001)}, (0.25, 0.5))["x"] == [250.0, 500.0]
