"""plumbline: dataset understanding on Spark.

Point it at any DataFrame and get back, as DataFrames, the facts you want
before modelling: column types, profile, distributions, missing values,
outliers, associations, target and task detection, feature importance, a
quality score, rule-based advice, and a batch scorer for written analyses.
"""

import sys

from pyspark import cloudpickle

# Ship the package's functions with the job, so that executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from plumbline.dataset import Dataset  # noqa: E402
from plumbline.plans.eda import run_eda  # noqa: E402

__all__ = ["Dataset", "run_eda"]
